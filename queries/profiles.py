"""P1-P11, IO8."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.functions.exprs import ends_like_key, name_parts, names_a_key
from brightledger.operators.profile import (
    batch_reprofile,
    date_layouts,
    date_ranges,
    duplicate_rows,
    infer_types,
    numeric_stats,
    profile_counts,
    profile_frame,
    profile_table,
    quality_flags,
    quality_summary,
    table_rows,
    top_values,
    typed_columns,
)
from brightledger.operators.states import batch_states, load_states, profile_states, save_states
from brightledger.session import load_table, work_folder
from queries import query

COLUMNS = {
    "nation": "n_nationkey n_name n_regionkey",
    "region": "r_regionkey r_name",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
}


def _union(table: str, template: str, columns: str | None = None) -> str:
    """One SELECT per column of a table."""
    return " UNION ALL ".join(template.format(t=table, c=c) for c in (columns or COLUMNS[table]).split())


_COUNTS = (
    "SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null_count, count(*) - count({c}) AS missing_count,"
    " round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percentage, count(DISTINCT {c}) AS unique_count FROM {t}"
)


@query("p1_profile_counts", _union("lineitem", _COUNTS))
def p1_profile_counts(spark, d):
    return profile_counts(load_table(spark, d, "lineitem")).drop("position")


_GAPS = "SELECT *, CASE WHEN n_chars > 2000 THEN lang END AS sparse FROM documents"


@query(
    "p1_missing_values",
    f"WITH gaps AS ({_GAPS}) " + _union("gaps", _COUNTS, COLUMNS["documents"] + " sparse"),
)
def p1_missing_values(spark, d):
    docs = load_table(spark, d, "documents").withColumn("sparse", F.when(F.col("n_chars") > 2000, F.col("lang")))
    return profile_counts(docs).drop("position")


# Name facts of the columns below: strong ending, or a key word among the parts.
_KIND = {
    "o_totalprice": "number", "o_orderdate": "time", "l_linenumber": "number", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_shipdate": "time", "ts": "time",
    "value": "number", "n_chars": "number",
}


def _type_sql(table: str) -> str:
    parts = []
    for c in COLUMNS[table].split():
        strong = c.endswith(("key", "id"))
        weak = c.endswith("_id")
        ratio = f"count(DISTINCT {c}) / count({c})"
        kind = _KIND.get(c, "number" if strong else "text")
        key = "true" if strong else f"({'true' if weak else 'false'} AND {ratio} > 0.95 AND count({c}) > 5)"
        numeric = f"CASE WHEN {key} THEN 'identifier' ELSE 'numeric' END"
        rule = {
            "number": numeric,
            "time": "'date'",
            "text": f"""CASE WHEN avg(CASE WHEN TRY_CAST(regexp_replace(CAST({c} AS VARCHAR), '[,$€£₦\\s]', '', 'g') AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) >= 0.9
              THEN {numeric} WHEN {ratio} > 0.9 AND count({c}) > 20 THEN 'text' ELSE 'categorical' END""",
        }[kind]
        parts.append(f"SELECT '{table}' AS dataset_id, '{c}' AS column_name, CASE WHEN count(*) > 0 THEN {rule} END AS inferred_type FROM {table}")
    return " UNION ALL ".join(parts)


@query("p2_semantic_types", " UNION ALL ".join(_type_sql(t) for t in ("orders", "events", "documents")))
def p2_semantic_types(spark, d):
    tables = ("orders", "events", "documents")
    parts = [infer_types(load_table(spark, d, t)).select(F.lit(t).alias("dataset_id"), "column_name", "inferred_type") for t in tables]
    return reduce(DataFrame.unionAll, parts)


@query(
    "p2_text_typed_columns",
    """SELECT * FROM (VALUES ('amount', 'numeric', true), ('placed', 'date', false), ('order_code', 'identifier', false), ('status', 'categorical', false),
         ('filled', 'boolean', false), ('nothing', 'unknown', false)) AS t(column_name, inferred_type, numeric_stored_as_text)""",
)
def p2_text_typed_columns(spark, d):
    """Numbers, dates and codes that arrive as text."""
    orders = load_table(spark, d, "orders").select(
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("amount"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("placed"),
        F.concat(F.lit("SO-"), F.col("o_orderkey"), F.lit("x")).alias("order_code"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") == "F").alias("filled"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return infer_types(orders).select("column_name", "inferred_type", "numeric_stored_as_text")


@query(
    "p3_key_names",
    """SELECT p_name, string_split(p_name, ' ')[1] || '_' || string_split(p_name, ' ')[2] AS snake, false AS key_word, true AS ends_as_key
       FROM (SELECT DISTINCT p_name FROM part)""",
)
def p3_key_names(spark, d):
    """Name words and key endings of column names built from part names."""
    names = load_table(spark, d, "part").select("p_name").distinct()
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return names.select(
        "p_name",
        F.array_join(name_parts(camel), "_").alias("snake"),
        names_a_key(camel).alias("key_word"),
        ends_like_key(F.concat(camel, F.lit("Key"))).alias("ends_as_key"),
    )


@query(
    "p4_date_layouts",
    "SELECT * FROM (VALUES ('iso', 'yyyy-M-d'), ('us', 'M/d/yyyy'), ('eu', 'd.M.yyyy'), ('named', 'MMM d, yyyy')) AS t(column_name, date_layout)",
)
def p4_date_layouts(spark, d):
    orders = load_table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("us"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("eu"),
        F.date_format("o_orderdate", "MMM d, yyyy").alias("named"),
        F.col("o_orderstatus").alias("status"),
    )
    found = date_layouts(orders, orders.columns)
    return spark.createDataFrame(list(found.items()), "column_name string, date_layout string")


@query(
    "p4_late_days",
    """SELECT 'day' AS column_name, CASE WHEN max(day(o_orderdate)) > 12 THEN 'd/M/yyyy' ELSE 'M/d/yyyy' END AS date_layout, count(*) AS row_count FROM orders""",
)
def p4_late_days(spark, d):
    """The first thousands of values fit two layouts; only later ones tell."""
    orders = load_table(spark, d, "orders").orderBy(F.dayofmonth("o_orderdate")).select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    layout = F.lit(date_layouts(orders, ["day"])["day"])
    return orders.agg(F.count("day").alias("row_count")).select(F.lit("day").alias("column_name"), layout.alias("date_layout"), "row_count")


@query(
    "p5_numeric_stats",
    _union(
        "lineitem",
        "SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 4) AS mean_value,"
        " round(stddev_samp({c}), 4) AS std_value, round(CAST(median({c}) AS DOUBLE), 4) AS median_value FROM {t}",
        "l_linenumber l_quantity l_extendedprice l_discount l_tax",
    ),
)
def p5_numeric_stats(spark, d):
    names = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return numeric_stats(load_table(spark, d, "lineitem"), names).withColumn("median_value", F.round("median_value", 4))


@query(
    "p6_top_values",
    "SELECT * FROM ("
    + _union(
        "events",
        "(SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, {c} AS value, count(*) AS count,"
        " round(100.0 * count(*) / (SELECT count({c}) FROM {t}), 2) AS percentage FROM {t} GROUP BY {c})",
        "event_type props",
    )
    + ") WHERE rank <= 5",
)
def p6_top_values(spark, d):
    return top_values(load_table(spark, d, "events"), ["event_type", "props"])


@query(
    "p7_date_range",
    """SELECT 'ts' AS column_name, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS min_date, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS max_date,
       CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS INTEGER) AS date_coverage_days FROM events""",
)
def p7_date_range(spark, d):
    return date_ranges(load_table(spark, d, "events"), {"ts": None})


@query(
    "p8_duplicate_rows",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count, round(100.0 * sum(n - 1) / sum(n), 2) AS duplicate_row_percentage
       FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""",
)
def p8_duplicate_rows(spark, d):
    """Copies among whole texts."""
    return duplicate_rows(load_table(spark, d, "documents").select("text", "lang"))


@query(
    "p9_quality_flags",
    """SELECT column_name, CASE WHEN missing > 50 THEN 'high_missing' ELSE '' END AS flags FROM (
         SELECT 'urgent' AS column_name, round(100.0 * (count(*) - count(*) FILTER (o_orderpriority = '1-URGENT')) / count(*), 2) AS missing FROM orders
         UNION ALL SELECT 'open', round(100.0 * (count(*) - count(*) FILTER (o_orderstatus <> 'F')) / count(*), 2) FROM orders)
       UNION ALL SELECT 'price', 'numeric_stored_as_text' FROM (SELECT 1)""",
)
def p9_quality_flags(spark, d):
    return quality_flags(infer_types(_flawed(spark, d))).select("column_name", F.array_join("quality_flags", ",").alias("flags"))


def _flawed(spark, d):
    return load_table(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("urgent"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("open"),
        F.concat(F.lit("€"), F.floor("o_totalprice")).alias("price"),
    )


@query(
    "p10_quality_score",
    """WITH dup AS (SELECT round(100.0 * sum(n - 1) / sum(n), 2) AS pct, CAST(sum(n - 1) AS BIGINT) AS extra, CAST(sum(n) AS BIGINT) AS rows FROM (
         SELECT count(*) AS n FROM orders GROUP BY CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END, floor(o_totalprice)))
       SELECT 'flawed' AS dataset_id, rows AS row_count, extra AS duplicate_row_count, pct AS duplicate_row_percentage,
         round(100 - least(pct, 30) - 15 - 5 - 5, 2) AS score, CASE WHEN 75 - least(pct, 30) >= 60 THEN 'fair' ELSE 'poor' END AS rating FROM dup""",
)
def p10_quality_score(spark, d):
    profile = profile_table(_flawed(spark, d), "flawed", duplicate_headers=["price"])
    return quality_summary(profile_frame(spark, [profile]), table_rows(spark, [profile])).drop("notes")


@query(
    "p11_typed_columns",
    """SELECT 'orders' AS dataset_id, 'o_totalprice' AS numeric_columns, 'o_orderstatus,o_orderpriority' AS categorical_columns,
       'o_orderdate' AS date_columns, 'o_orderkey,o_custkey' AS identifier_columns, '' AS text_columns""",
)
def p11_typed_columns(spark, d):
    lists = typed_columns(infer_types(load_table(spark, d, "orders")).withColumn("dataset_id", F.lit("orders")))
    return lists.select("dataset_id", *[F.array_join(n, ",").alias(n) for n in lists.columns if n != "dataset_id"])


_LINE_KINDS = [
    ("l_orderkey", "identifier"), ("l_partkey", "identifier"), ("l_suppkey", "identifier"), ("l_linenumber", "numeric"), ("l_quantity", "numeric"),
    ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"), ("l_linestatus", "categorical"),
    ("l_shipdate", "date"),
]


def _profile_sql(position, column, kind):
    """The profile row of one lineitem column."""
    figures = "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean_value, NULL::DOUBLE AS median_value, NULL::DOUBLE AS std_value"
    if kind == "numeric":
        figures = f"""min({column})::DOUBLE AS min_value, max({column})::DOUBLE AS max_value, round(avg({column}), 4) AS mean_value,
            median({column})::DOUBLE AS median_value, round(stddev_samp({column}), 4) AS std_value"""
    groups = "NULL::BIGINT AS cardinality, NULL::VARCHAR AS top_values"
    if kind == "categorical":
        groups = f"""count(DISTINCT {column}) AS cardinality, (SELECT string_agg(v || ':' || n || ':' || CAST(round(10000.0 * n / t) AS BIGINT), ',' ORDER BY n DESC, v)
            FROM (SELECT {column} AS v, count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_values"""
    span = "NULL::VARCHAR AS min_date, NULL::VARCHAR AS max_date, NULL::INTEGER AS date_coverage_days"
    if kind == "date":
        stamp = "%Y-%m-%dT%H:%M:%S"
        span = f"""strftime(min({column}), '{stamp}') AS min_date, strftime(max({column}), '{stamp}') AS max_date,
            CAST(datesub('day', min({column}), max({column})) AS INTEGER) AS date_coverage_days"""
    return f"""SELECT 'lineitem' AS dataset_id, {position}::INTEGER AS position, '{column}' AS column_name, '{kind}' AS inferred_type, count(*) AS row_count,
        count({column}) AS non_null_count, count(*) - count({column}) AS missing_count, round(100.0 * (count(*) - count({column})) / count(*), 2) AS missing_percentage,
        count(DISTINCT {column}) AS unique_count, '' AS quality_flags, {figures}, {groups}, {span}, NULL::VARCHAR AS date_layout FROM lineitem"""


@query("p_full_profile", " UNION ALL ".join(_profile_sql(i, column, kind) for i, (column, kind) in enumerate(_LINE_KINDS)))
def p_full_profile(spark, d):
    """P1-P9 together for one wide table; top values as value:count:hundredths of a percent."""
    return _whole_profile(spark, profile_table(load_table(spark, d, "lineitem"), "lineitem"))


def _whole_profile(spark, profile):
    rows = profile_frame(spark, [profile])
    share = lambda t: F.round(t["percentage"] * 100).cast("bigint").cast("string")
    tops = F.array_join(F.transform("top_values", lambda t: F.concat_ws(":", t["value"], t["count"].cast("string"), share(t))), ",")
    return rows.withColumn("top_values", tops).withColumn("quality_flags", F.array_join("quality_flags", ","))


@query("io8_incremental_profile", " UNION ALL ".join(_profile_sql(i, column, kind) for i, (column, kind) in enumerate(_LINE_KINDS)))
def io8_incremental_profile(spark, d):
    """The profile of a table that came in three batches, from their states alone."""
    root, lines = work_folder(spark, "states"), load_table(spark, d, "lineitem")
    for flag in ("A", "N", "R"):
        save_states(batch_states(lines.filter(F.col("l_returnflag") == flag)), root, "lineitem", f"flag {flag}")
    return _whole_profile(spark, profile_states(load_states(spark, root, "lineitem"), "lineitem"))


@query(
    "io8_batch_reprofile",
    " UNION ALL ".join(
        _union(
            t,
            "SELECT '{t}' AS dataset_id, '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_count FROM {t}",
        )
        for t in ("nation", "region", "customer", "supplier")
    ),
)
def io8_batch_reprofile(spark, d):
    profiles = batch_reprofile({t: load_table(spark, d, t) for t in ("nation", "region", "customer", "supplier")})
    return profile_frame(spark, profiles).select("dataset_id", "column_name", "row_count", "non_null_count", "unique_count")
