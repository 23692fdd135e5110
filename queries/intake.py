"""IO1-IO7 and the streaming forms."""

from pyspark.sql import functions as F

from brightledger.session import load_table, work_folder
from brightledger.sources.datasets import incremental_ingest, plan_sync, read_dataset, sample_rows, write_dataset
from brightledger.sources.delimited import duplicate_headers, read_delimited, rename_headers
from brightledger.sources.files import validate_files
from brightledger.streaming.ingest import file_stream, ingest_new_files, keep_totals, monthly_stream, months_of
from queries import query


@query(
    "io1_read_delimited",
    """SELECT o_orderstatus AS status, count(*) AS row_count, round(sum(o_totalprice), 2) AS total, ';' AS sep, 'ISO-8859-1' AS encoding
       FROM orders GROUP BY 1""",
)
def io1_read_delimited(spark, d):
    """A Latin-1 file with semicolons, found out from the file itself."""
    path = work_folder(spark, "delimited")
    orders = load_table(spark, d, "orders").withColumn("note", F.lit("Größe; geprüft"))
    orders.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    table = read_delimited(spark, path)
    groups = table.frame.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return groups.withColumn("sep", F.lit(table.separator)).withColumn("encoding", F.lit(table.encoding))


@query(
    "io1_mixed_files",
    """SELECT o_orderstatus AS status, note, count(*) AS row_count, round(sum(o_totalprice), 2) AS total FROM
       (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'Größe' ELSE 'plain, x' END AS note FROM orders) GROUP BY 1, 2""",
)
def io1_mixed_files(spark, d):
    """Files with two encodings, two separators and their columns in two orders."""
    path = work_folder(spark, "delimited")
    note = F.when(F.col("o_orderstatus") == "F", "Größe").otherwise("plain, x")
    orders = load_table(spark, d, "orders").select("o_orderstatus", "o_totalprice", note.alias("note"))
    one, other = orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'").select("note", "o_orderstatus", "o_totalprice")
    one.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(f"{path}/a")
    other.write.option("header", True).csv(f"{path}/b")
    frame = read_delimited(spark, f"{path}/*").frame
    return frame.groupBy(F.col("o_orderstatus").alias("status"), "note").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "io1_quoted_line_breaks",
    """SELECT lang, count(*) AS row_count, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(n) AS BIGINT) AS characters, CAST(sum(breaks) AS BIGINT) AS breaks FROM
       (SELECT lang, doc_id, length(t) AS n, length(t) - length(replace(t, chr(10), '')) AS breaks
        FROM (SELECT lang, doc_id, regexp_replace(coalesce(text, ''), '\\s+$', '') AS t FROM documents)) GROUP BY 1""",
)
def io1_quoted_line_breaks(spark, d):
    """All documents as quoted cells with their line breaks, a file for each
    task that reads them; files longer than a split are cut."""
    path = work_folder(spark, "delimited")
    docs = load_table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+$", "").alias("text"), "lang")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return read_delimited(spark, path, multiline=True).frame.groupBy("lang").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("characters"), F.sum(breaks).alias("breaks")
    )


_FIRST = "string_split(string_split(text, chr(10))[1], ' ')"
_CELLS = f"cells AS (SELECT doc_id AS file, i, trim({_FIRST}[i]) AS name FROM (SELECT *, unnest(range(1, len({_FIRST}) + 1)) AS i FROM documents))"


def _headers(spark, d):
    """The first line of every document as a header row separated by blanks."""
    first = F.split("text", "\n")[0]
    return load_table(spark, d, "documents").select(F.col("doc_id").alias("file"), first.alias("header"), F.lit(" ").alias("sep"))


@query("io2_duplicate_headers", f"WITH {_CELLS} SELECT file, name, count(*) AS times FROM cells WHERE name <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def io2_duplicate_headers(spark, d):
    return duplicate_headers(_headers(spark, d))


@query(
    "io2_renamed_headers",
    f"""WITH {_CELLS}, s AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY i) - 1 AS seen FROM cells)
        SELECT file, CAST(i - 1 AS INTEGER) AS position, name, CASE WHEN seen > 0 THEN name || '.' || seen ELSE name END AS new_name FROM s""",
)
def io2_renamed_headers(spark, d):
    return rename_headers(_headers(spark, d))


@query("io3_read_dataset", "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def io3_read_dataset(spark, d):
    root = work_folder(spark, "datasets")
    write_dataset(load_table(spark, d, "customer"), root, "customers")
    return read_dataset(spark, root, "customers").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 2).alias("balance"))


@query("io4_write_dataset", "SELECT event_id, CAST(NULL AS VARCHAR) AS nothing, event_type FROM events")
def io4_write_dataset(spark, d):
    """A column without a type is written as text."""
    root = work_folder(spark, "datasets")
    write_dataset(load_table(spark, d, "events").select("event_id", F.lit(None).alias("nothing"), "event_type"), root, "events")
    return read_dataset(spark, root, "events")


_ENDING = "CASE lang WHEN 'en' THEN '.CSV' WHEN 'de' THEN '.xls' WHEN 'fr' THEN '.txt' ELSE '' END"
_SIZE = "CASE WHEN n_chars < 100 THEN 0 ELSE n_chars * 1000 END"


@query(
    "io5_validate_files",
    f"""SELECT doc_id, CASE lang WHEN 'de' THEN 'legacy_format' WHEN 'fr' THEN 'unsupported_type' WHEN 'en' THEN
          CASE WHEN {_SIZE} = 0 THEN 'empty' WHEN {_SIZE} > 2 * 1048576 THEN 'too_big' END ELSE 'no_extension' END AS reason,
          lang = 'en' AND {_SIZE} BETWEEN 1 AND 2 * 1048576 AS accepted FROM documents""",
)
def io5_validate_files(spark, d):
    files = load_table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("/in.box/"), "source", F.expr(_ENDING)).alias("path"), F.expr(_SIZE).alias("length")
    )
    return validate_files(files, 2).select("doc_id", "reason", "accepted")


@query("io6_sample_rows", "SELECT least(500, count(*)) AS n, true AS known FROM lineitem")
def io6_sample_rows(spark, d):
    """At most 500 rows, all from the table."""
    lines = load_table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    sample = sample_rows(lines, 9999).select(*keys)
    found = sample.join(lines.select(*keys).distinct(), keys, "left_semi")
    same = sample.agg(F.count(F.lit(1)).alias("n")).join(found.agg(F.count(F.lit(1)).alias("m")))
    return same.select("n", (F.col("n") == F.col("m")).alias("known"))


_LISTED = "SELECT o_custkey AS item_id, max(o_orderdate) AS modified_at, max(o_orderdate) FILTER (o_orderstatus = 'F') AS synced FROM orders GROUP BY 1"


def _listing(spark, d):
    orders = load_table(spark, d, "orders")
    listed = orders.groupBy(F.col("o_custkey").alias("item_id")).agg(F.max("o_orderdate").alias("modified_at"))
    state = orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("item_id"))
    return listed, state.agg(F.max("o_orderdate").alias("synced_modified_at"))


@query(
    "io7_sync_plan",
    f"SELECT item_id, CASE WHEN synced IS NULL OR modified_at > synced THEN 'sync' ELSE 'skip' END AS action FROM ({_LISTED})",
)
def io7_sync_plan(spark, d):
    return plan_sync(*_listing(spark, d)).select("item_id", "action")


@query(
    "io7_incremental_ingest",
    f"""SELECT item_id, strftime(CASE WHEN due AND NOT bad THEN modified_at ELSE synced END, '%Y-%m-%d') AS synced_on, CASE WHEN due AND bad THEN 'error' ELSE 'synced' END AS status
        FROM (SELECT *, synced IS NULL OR modified_at > synced AS due, modified_at >= TIMESTAMP '2001-07-01' AS bad FROM ({_LISTED}))""",
)
def io7_incremental_ingest(spark, d):
    """Items changed after June 2001 fail here; all others are taken in."""

    def take_in(items):
        return items.select("item_id", F.when(F.col("modified_at") >= F.lit("2001-07-01").cast("timestamp_ntz"), "unreadable").alias("error"))

    out = incremental_ingest(*_listing(spark, d), take_in)
    return out.select("item_id", F.date_format("synced_modified_at", "yyyy-MM-dd").alias("synced_on"), "status")


@query("io7_stream_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def io7_stream_ingest(spark, d):
    """The file stream takes in what is new and stops; a second run adds nothing."""
    schema = load_table(spark, d, "events").schema
    target, checkpoint = work_folder(spark, "stream"), work_folder(spark, "progress")
    for _ in range(2):
        ingest_new_files(file_stream(spark, d, schema, "events.parquet"), target, checkpoint).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "a4_stream_months",
    "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS row_count, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1",
)
def a4_stream_months(spark, d):
    """Monthly sums kept by a stream with a watermark."""
    schema = load_table(spark, d, "orders").schema
    stream = file_stream(spark, d, schema, "orders.parquet")
    days = monthly_stream(stream, "o_orderdate", "o_totalprice")
    target = work_folder(spark, "days")
    keep_totals(days, target, work_folder(spark, "progress")).awaitTermination()
    return months_of(spark.read.parquet(target)).select("period", "row_count", F.round("value", 2).alias("value"))
