"""A1-A8, T1-T7 and the flagship query."""

from functools import reduce

from pyspark.sql import functions as F

from brightledger.operators.aggregate import (
    AGGREGATIONS,
    breakdown,
    breakdown2,
    categorical_distribution,
    chart_rows,
    compare_periods,
    correlation,
    numeric_distribution,
    scalar,
    scalars,
    trend,
)
from brightledger.operators.filters import Condition
from brightledger.operators.joins import JoinSpec, joined, key_difference, key_intersection
from brightledger.operators.quantiles import exact_quantiles
from brightledger.operators.ranges import Span, interval_join
from brightledger.operators.sql import SqlRefused, sql_frame, sql_query, view_names
from brightledger.operators.versions import next_versions, recent_turns
from brightledger.plans.insights import last_change
from brightledger.session import load_table
from queries import query


def _rounded(df, *names, digits=2):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


@query(
    "top_segments",
    """SELECT c_mktsegment, sum_o_totalprice, round(100 * sum_o_totalprice / sum(sum_o_totalprice) OVER (), 2) AS percentage_of_total
       FROM (SELECT c_mktsegment, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
             WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY 2 DESC LIMIT 3)""",
)
def top_segments(spark, d):
    wide = joined(load_table(spark, d, "orders"), load_table(spark, d, "customer"), JoinSpec("o_custkey", "c_custkey"))
    out = breakdown(wide, "c_mktsegment", "sum", "o_totalprice", [Condition("o_orderstatus", "ne", "P")], top_n=3)
    return _rounded(out, "sum_o_totalprice")


@query(
    "a1_scalars",
    """WITH s AS (SELECT count(*) AS row_count, sum(l_extendedprice) AS s, avg(l_extendedprice) AS a, median(l_extendedprice) AS md,
         min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, count(l_extendedprice) AS c, count(DISTINCT l_extendedprice) AS n FROM lineitem)
       SELECT agg AS aggregation, round(CAST(v AS DOUBLE), 2) AS value, row_count, 'ok' AS status FROM s,
         LATERAL (VALUES ('sum', s), ('mean', a), ('median', md), ('min', mn), ('max', mx), ('count', CAST(c AS DOUBLE)), ('nunique', CAST(n AS DOUBLE))) AS x(agg, v)""",
)
def a1_scalars(spark, d):
    lines = load_table(spark, d, "lineitem")
    return _rounded(scalars(lines, [(agg, "l_extendedprice") for agg in AGGREGATIONS]).drop("metric"), "value")


@query(
    "a1_no_numbers",
    "SELECT CAST(NULL AS DOUBLE) AS value, count(*) AS row_count, 'insufficient_data' AS status FROM customer",
)
def a1_no_numbers(spark, d):
    """A text column without numbers gives no sum rather than 0."""
    return scalar(load_table(spark, d, "customer"), "sum", "c_name")


@query(
    "a2_breakdown",
    """SELECT o_orderpriority, count_records, round(100.0 * count_records / sum(count_records) OVER (), 2) AS percentage_of_total
       FROM (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS count_records FROM orders GROUP BY 1)""",
)
def a2_breakdown(spark, d):
    return breakdown(load_table(spark, d, "orders"), "o_orderpriority", "count")


@query(
    "a2_breakdown_customers",
    """SELECT o_custkey, v AS sum_o_totalprice, round(100 * v / (SELECT sum(o_totalprice) FROM orders), 2) AS percentage_of_total
       FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) ORDER BY v DESC LIMIT 25""",
)
def a2_breakdown_customers(spark, d):
    """Shares of the whole, though only 25 of many groups are shown."""
    out = breakdown(load_table(spark, d, "orders"), "o_custkey", "sum", "o_totalprice", top_n=25, pct_base="all")
    return _rounded(out, "sum_o_totalprice")


@query(
    "a2_median",
    "SELECT p_brand, round(median(l_extendedprice), 2) AS median_l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def a2_median(spark, d):
    wide = joined(load_table(spark, d, "lineitem"), load_table(spark, d, "part"), JoinSpec("l_partkey", "p_partkey"))
    return _rounded(breakdown(wide, "p_brand", "median", "l_extendedprice"), "median_l_extendedprice")


@query(
    "a2_nulls",
    """SELECT status, round(coalesce(sum(v), 0), 2) AS sum_v, round(100 * coalesce(sum(v), 0) / (SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'O'), 2) AS percentage_of_total
       FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS v FROM orders)
       WHERE status IS NOT NULL GROUP BY 1""",
)
def a2_nulls(spark, d):
    """Null keys are dropped; a group of nulls sums to 0 and stays."""
    orders = load_table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("v"),
    )
    return _rounded(breakdown(orders, "status", "sum", "v"), "sum_v")


@query(
    "a3_two_dimensions",
    """SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 2) AS mean_o_totalprice FROM orders
       GROUP BY 1, 2 ORDER BY avg(o_totalprice) DESC LIMIT 7""",
)
def a3_two_dimensions(spark, d):
    out = breakdown2(load_table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "mean", "o_totalprice", top_n=7)
    return _rounded(out, "mean_o_totalprice")


@query(
    "a4_trend",
    "SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1",
)
def a4_trend(spark, d):
    return _rounded(trend(load_table(spark, d, "orders"), "o_orderdate", "sum", "o_totalprice"), "value")


@query(
    "a4_trend_dimension",
    """SELECT strftime(l_shipdate, '%Y-%m') AS period, l_returnflag, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS value
       FROM lineitem GROUP BY 1, 2""",
)
def a4_trend_dimension(spark, d):
    return trend(load_table(spark, d, "lineitem"), "l_shipdate", "nunique", "l_partkey", "l_returnflag")


@query(
    "a4_trend_text_dates",
    "SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1",
)
def a4_trend_text_dates(spark, d):
    """Dates kept as text, in a layout that has to be found first."""
    from brightledger.operators.profile import date_layouts

    orders = load_table(spark, d, "orders").select(F.date_format("o_orderdate", "d MMM yyyy").alias("day"))
    return trend(orders, "day", "count", date_layout=date_layouts(orders, ["day"])["day"])


@query(
    "a5_compare_periods",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1)
       SELECT '1996-03' AS period_a, round(a.v, 2) AS value_a, '1997-03' AS period_b, round(b.v, 2) AS value_b,
         round(b.v - a.v, 2) AS absolute_change, round((b.v - a.v) / a.v * 100, 2) AS percentage_change, 'ok' AS status
       FROM m a, m b WHERE a.p = '1996-03' AND b.p = '1997-03'""",
)
def a5_compare_periods(spark, d):
    out = compare_periods(load_table(spark, d, "orders"), "o_orderdate", "1996-03", "1997-03", "sum", "o_totalprice")
    return _rounded(out, "value_a", "value_b")


@query(
    "a6_correlation",
    "SELECT round(corr(l_quantity, l_extendedprice), 4) AS coefficient, count(*) AS pairs_considered FROM lineitem",
)
def a6_correlation(spark, d):
    return correlation(load_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("a6_constant", "SELECT CAST(NULL AS DOUBLE) AS coefficient, count(*) AS pairs_considered FROM orders")
def a6_constant(spark, d):
    orders = load_table(spark, d, "orders").withColumn("one", F.lit(1))
    return correlation(orders, "one", "o_totalprice")


@query(
    "a7_histogram",
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
       b AS (SELECT greatest(1, least(10, CAST(ceil((value - lo) / ((hi - lo) / 10)) AS INTEGER))) AS bin FROM events, s),
       n AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
       SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) / 10 * (i - 1), 4) AS from_value, round(lo + (hi - lo) / 10 * i, 4) AS to_value,
         coalesce(n, 0) AS row_count FROM s, range(1, 11) AS r(i) LEFT JOIN n ON n.bin = r.i""",
)
def a7_histogram(spark, d):
    return _rounded(numeric_distribution(load_table(spark, d, "events"), "value"), "from_value", "to_value", digits=4)


@query(
    "a8_categories",
    "SELECT props AS value, count(*) AS row_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def a8_categories(spark, d):
    return categorical_distribution(load_table(spark, d, "events"), "props")


@query(
    "a_quantiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2,
         round(quantile_cont(l_extendedprice, 0.999), 4) AS q999 FROM lineitem GROUP BY 1""",
)
def a_quantiles(spark, d):
    """The exact quantiles that spread one group over all tasks."""
    q = exact_quantiles(load_table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.999])
    return q.select("l_returnflag", *[F.round(F.col("quantiles")[i], 4).alias(n) for i, n in enumerate(("q1", "q2", "q999"))])


@query(
    "a_quantiles_narrow",
    """SELECT l_returnflag, round(quantile_cont(v, 0.25) - 1.7e9, 5) AS q1, round(quantile_cont(v, 0.5) - 1.7e9, 5) AS q2 FROM
         (SELECT l_returnflag, 1.7e9 + l_extendedprice / 1e6 AS v FROM lineitem) GROUP BY 1""",
)
def a_quantiles_narrow(spark, d):
    """Values within a tenth of a second of 1.7 billion."""
    near = load_table(spark, d, "lineitem").select("l_returnflag", (F.lit(1.7e9) + F.col("l_extendedprice") / 1e6).alias("v"))
    q = exact_quantiles(near, ["l_returnflag"], "v", [0.25, 0.5])
    return q.select("l_returnflag", *[F.round(F.col("quantiles")[i] - 1.7e9, 5).alias(n) for i, n in enumerate(("q1", "q2"))])


@query(
    "t1_bottom_n",
    """SELECT p_brand, v AS sum_l_quantity, round(100 * v / sum(v) OVER (), 2) AS percentage_of_total FROM (
         SELECT p_brand, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2, 1 LIMIT 3)""",
)
def t1_bottom_n(spark, d):
    wide = joined(load_table(spark, d, "lineitem"), load_table(spark, d, "part"), JoinSpec("l_partkey", "p_partkey"))
    return breakdown(wide, "p_brand", "sum", "l_quantity", top_n=3, sort="asc")


@query(
    "t2_chart_rows",
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority, CAST(count(*) AS DOUBLE) AS value FROM orders
       GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100""",
)
def t2_chart_rows(spark, d):
    points = trend(load_table(spark, d, "orders"), "o_orderdate", "count", dimension="o_orderpriority")
    return chart_rows(points, [F.col("period"), F.col("o_orderpriority")])


@query("t3_result_cap", "SELECT 500 AS shown, count(*) > 500 AS truncated FROM orders")
def t3_result_cap(spark, d):
    result = sql_query({"orders": load_table(spark, d, "orders")}, "SELECT o_orderkey FROM orders")
    return spark.createDataFrame([(len(result.rows), result.truncated)], "shown int, truncated boolean")


@query(
    "t4_last_change",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1),
       l AS (SELECT p AS last_period, v AS last_value, lag(p) OVER (ORDER BY p) AS prior_period, lag(v) OVER (ORDER BY p) AS prior_value FROM m)
       SELECT prior_period, round(prior_value, 2) AS prior_value, last_period, round(last_value, 2) AS last_value,
         round((last_value - prior_value) / prior_value * 100, 2) AS pct_change FROM l ORDER BY last_period DESC LIMIT 1""",
)
def t4_last_change(spark, d):
    return _rounded(last_change(load_table(spark, d, "orders"), "o_orderdate", "o_totalprice"), "prior_value", "last_value")


@query(
    "t5_recent_turns",
    """SELECT conv_id, turn, role, recency FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS recency
       FROM conversations) WHERE recency <= 6""",
)
def t5_recent_turns(spark, d):
    return recent_turns(load_table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "recency")


@query(
    "t6_next_version",
    "SELECT lang AS user_id, source AS filename, max(doc_id) + 1 AS next_version FROM documents GROUP BY 1, 2",
)
def t6_next_version(spark, d):
    versions = load_table(spark, d, "documents").select(
        F.col("lang").alias("user_id"), F.col("source").alias("filename"), F.col("doc_id").alias("version")
    )
    return next_versions(versions)


@query("t7_key_intersection", "SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def t7_key_intersection(spark, d):
    return key_intersection(load_table(spark, d, "documents"), load_table(spark, d, "labels"), "doc_id", "doc_id")


@query("t7_key_difference", "SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def t7_key_difference(spark, d):
    return key_difference(load_table(spark, d, "orders"), load_table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


_JOIN_SQL = """
    SELECT r_name, n_name, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderpriority <> '5-LOW; none' GROUP BY r_name, n_name"""


@query("q1_sql_query", _JOIN_SQL)
def q1_sql_query(spark, d):
    names = ["lineitem", "orders", "customer", "nation", "region"]
    return sql_frame({n: load_table(spark, d, n) for n in names}, _JOIN_SQL + ";")


@query(
    "q2_view_names",
    """SELECT n_name || '.csv' AS dataset, regexp_replace(n_name || '.csv', '[^A-Za-z0-9]+', '_', 'g') AS view_name, count(c_custkey) AS row_count
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def q2_view_names(spark, d):
    """A dataset per nation under the name of its file, each asked by its view."""
    customers = load_table(spark, d, "customer")
    tables = {f"{r.n_name}.csv": customers.filter(F.col("c_nationkey") == r.n_nationkey) for r in load_table(spark, d, "nation").collect()}
    views = view_names(list(tables))
    text = " UNION ALL ".join(f"SELECT '{n}' AS dataset, '{v}' AS view_name, count(*) AS row_count FROM {v}" for n, v in views.items())
    return sql_frame(tables, text)


# Label, text, and whether it is allowed.
_TEXTS = [
    ("plain", "SELECT * FROM orders", True),
    ("literal", "SELECT * FROM orders WHERE o_orderstatus <> 'reflect(;)'", True),
    ("with", "WITH a AS (SELECT * FROM orders) SELECT * FROM a", True),
    ("delete", "DELETE FROM orders", False),
    ("insert after with", "WITH a AS (SELECT 1) INSERT INTO orders SELECT * FROM a", False),
    ("two statements", "SELECT * FROM orders; SELECT 1", False),
    ("file", "SELECT * FROM parquet.`/tmp/x`", False),
    ("foreign call", "SELECT reflect('java.lang.System', 'getProperty', 'java.version') FROM orders", False),
    ("backquoted", "SELECT `reflect`('java.lang.System', 'getProperty', 'java.version') FROM orders", False),
    ("commented", "SELECT java_method /* x */ ('java.lang.System', 'getProperty', 'java.version') FROM orders", False),
    ("other table", "SELECT * FROM customer", False),
    ("other table inside", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", False),
]


@query(
    "q3_refused",
    "SELECT label, allowed, CASE WHEN allowed THEN n END AS row_count FROM (VALUES "
    + ", ".join(f"('{label}', {str(allowed).lower()})" for label, _, allowed in _TEXTS)
    + ") AS t(label, allowed), (SELECT count(*) AS n FROM orders)",
)
def q3_refused(spark, d):
    """What is taken as one read-only query over orders, and its rows."""
    tables, parts = {"orders": load_table(spark, d, "orders")}, []
    for label, text, _ in _TEXTS:
        try:
            count = sql_frame(tables, text).agg(F.count(F.lit(1)).alias("n")).select(F.lit(True).alias("allowed"), F.col("n").alias("row_count"))
        except SqlRefused:
            count = spark.range(1).select(F.lit(False).alias("allowed"), F.lit(None).cast("long").alias("row_count"))
        parts.append(count.select(F.lit(label).alias("label"), "allowed", "row_count"))
    return reduce(lambda a, b: a.unionAll(b), parts)


_RANGE_SQL = """
    SELECT a.p_brand AS brand, count(*) AS dearer_pairs FROM brands a JOIN brands b ON a.avg_price > b.avg_price GROUP BY a.p_brand"""


@query(
    "j12_non_equi_join",
    "WITH brands AS (SELECT p_brand, avg(p_retailprice) AS avg_price FROM part GROUP BY 1)" + _RANGE_SQL,
)
def j12_non_equi_join(spark, d):
    """Tables of any number and any join condition, as SQL over named frames."""
    parts = load_table(spark, d, "part")
    return sql_frame({"brands": breakdown(parts, "p_brand", "mean", "p_retailprice").withColumnRenamed("mean_p_retailprice", "avg_price")}, _RANGE_SQL)


@query(
    "j12_interval_join",
    """WITH w AS (SELECT event_id, ts AS opened, ts + to_seconds(value * 60) AS closed FROM events WHERE event_type = 'purchase'),
         e AS (SELECT event_id AS error_id, ts, value FROM events WHERE event_type = 'error')
       SELECT w.event_id, count(*) AS errors, round(sum(e.value), 2) AS cost, max(error_id) AS last_error
       FROM w JOIN e ON e.ts >= w.opened AND e.ts <= w.closed GROUP BY 1""",
)
def j12_interval_join(spark, d):
    """Errors in the minutes after each purchase, as many as its value says."""
    events = load_table(spark, d, "events")
    closed = F.timestamp_add("MICROSECOND", F.round(F.col("value") * 60_000_000).cast("bigint"), F.col("ts"))
    windows = events.filter("event_type = 'purchase'").select("event_id", F.col("ts").alias("opened"), closed.alias("closed"))
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "ts", "value")
    pairs = interval_join(windows, errors, Span("opened", "closed"), Span("ts"), unit=60)
    return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("errors"), F.round(F.sum("value"), 2).alias("cost"), F.max("error_id").alias("last_error"))


@query(
    "j12_overlapping_intervals",
    """WITH v AS (SELECT user_id, event_id, ts AS opened, ts + to_seconds(value * 600) AS closed FROM events)
       SELECT a.event_id, count(*) AS overlaps, min(b.event_id) AS first_other FROM v AS a JOIN v AS b
         ON a.user_id = b.user_id AND b.opened < a.closed AND a.opened < b.closed AND a.event_id <> b.event_id GROUP BY 1""",
)
def j12_overlapping_intervals(spark, d):
    """Intervals of one user that overlap, lengths from seconds to days."""
    closed = F.timestamp_add("MICROSECOND", F.round(F.col("value") * 600_000_000).cast("bigint"), F.col("ts"))
    spans = load_table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("opened"), closed.alias("closed"))
    others = spans.select(F.col("user_id").alias("other_user"), F.col("event_id").alias("other"), F.col("opened").alias("from"), F.col("closed").alias("to"))
    pairs = interval_join(spans, others, Span("opened", "closed"), Span("from", "to"), [("user_id", "other_user")], unit=3600, open_end=True)
    return pairs.filter("event_id <> other").groupBy("event_id").agg(F.count(F.lit(1)).alias("overlaps"), F.min("other").alias("first_other"))
