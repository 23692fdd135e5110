"""F1-F11 and P12."""

from pyspark.sql import functions as F

from brightledger.functions.exprs import to_number_lenient
from brightledger.operators.aggregate import breakdown, scalar
from brightledger.operators.filters import Condition, DrillStep, UnknownColumn, apply_filters, drill_filters, next_dimension, result_status
from brightledger.session import load_table
from queries import query


def _kept(spark, d, table, columns, *conditions):
    return apply_filters(load_table(spark, d, table), conditions, table).select(*columns)


@query("f1_eq", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def f1_eq(spark, d):
    return _kept(spark, d, "orders", ["o_orderkey", "o_custkey"], Condition("o_orderstatus", "eq", "F"))


@query(
    "f2_ne",
    """SELECT l_orderkey, l_linenumber, flag FROM (SELECT *, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag FROM lineitem)
       WHERE flag IS DISTINCT FROM 'R'""",
)
def f2_ne(spark, d):
    lines = load_table(spark, d, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")))
    return apply_filters(lines, [Condition("flag", "ne", "R")]).select("l_orderkey", "l_linenumber", "flag")


@query("f3_gt", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def f3_gt(spark, d):
    return _kept(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], Condition("l_quantity", "gt", 45))


@query("f4_gte", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 5.5")
def f4_gte(spark, d):
    return _kept(spark, d, "lineitem", ["l_orderkey", "l_linenumber"], Condition("l_linenumber", "gte", 5.5))


@query("f5_lt", "SELECT event_id, user_id FROM events WHERE value < 10 AND event_type = 'click'")
def f5_lt(spark, d):
    return _kept(
        spark, d, "events", ["event_id", "user_id"], Condition("value", "lt", 10), Condition("event_type", "eq", "click")
    )


@query(
    "f6_lte",
    "SELECT c_custkey, '$ ' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) || ',0' AS balance FROM customer WHERE round(c_acctbal * 100) * 10 <= 500000",
)
def f6_lte(spark, d):
    """Amounts kept as text compare as numbers."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string")
    customers = load_table(spark, d, "customer").withColumn("balance", F.concat(F.lit("$ "), cents, F.lit(",0")))
    return apply_filters(customers, [Condition("balance", "lte", 500000)]).select("c_custkey", "balance")


@query("f7_contains", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED|r.ng')")
def f7_contains(spark, d):
    return _kept(spark, d, "part", ["p_partkey", "p_name"], Condition("p_name", "contains", "RED|r.ng"))


@query("f8_in", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#17', 'Brand#99')")
def f8_in(spark, d):
    return _kept(spark, d, "part", ["p_partkey", "p_brand"], Condition("p_brand", "in", ["Brand#2", "Brand#17", "Brand#99", 7]))


@query(
    "f10_empty_result",
    """SELECT count(*) AS row_count, CASE WHEN count(*) = 0 THEN 'insufficient_data' ELSE 'ok' END AS status
       FROM orders WHERE o_totalprice > 900000""",
)
def f10_empty_result(spark, d):
    return result_status(apply_filters(load_table(spark, d, "orders"), [Condition("o_totalprice", "gt", 900000)]))


@query(
    "f11_drill_down",
    """SELECT l_returnflag, v AS sum_l_extendedprice, round(100 * v / sum(v) OVER (), 2) AS percentage_of_total FROM (
         SELECT l_returnflag, round(sum(l_extendedprice), 2) AS v FROM lineitem
         WHERE l_linestatus = 'O' AND l_linenumber = 3 GROUP BY 1)""",
)
def f11_drill_down(spark, d):
    path = [DrillStep("l_linestatus", "O"), DrillStep("l_linenumber", 3)]
    dimension = next_dimension(["l_linestatus", "l_returnflag"], path)
    out = breakdown(load_table(spark, d, "lineitem"), dimension, "sum", "l_extendedprice", drill_filters(path))
    return out.withColumn("sum_l_extendedprice", F.round("sum_l_extendedprice", 2))


@query(
    "p12_lenient_number",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN round(floor(o_totalprice), 2) END AS amount FROM orders""",
)
def p12_lenient_number(spark, d):
    """Currency text parses, junk such as a trailing letter does not."""
    whole = F.floor("o_totalprice").cast("string")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("€ "), whole, F.lit(".00")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("$"), whole))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(whole, F.lit("d")))
        .otherwise(F.lit("n/a"))
    )
    orders = load_table(spark, d, "orders").withColumn("price_text", text)
    return orders.select("o_orderkey", to_number_lenient(orders, "price_text").alias("amount"))


@query(
    "f_all_operators",
    """SELECT round(sum(o_totalprice), 2) AS value, count(*) AS row_count, 'ok' AS status FROM orders
       WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 AND o_totalprice <= 400000 AND o_custkey >= 10
         AND regexp_matches(o_orderpriority, '(?i)high|low') AND o_orderstatus IN ('F', 'O')""",
)
def f_all_operators(spark, d):
    conditions = [
        Condition("o_orderstatus", "ne", "P"),
        Condition("o_totalprice", "gt", 1000),
        Condition("o_totalprice", "lte", 400000),
        Condition("o_custkey", "gte", 9.5),
        Condition("o_orderpriority", "contains", "high|low"),
        Condition("o_orderstatus", "in", ["F", "O"]),
    ]
    return scalar(load_table(spark, d, "orders"), "sum", "o_totalprice", conditions).withColumn("value", F.round("value", 2))


@query(
    "f9_unknown_column",
    "SELECT 'o_orderstatus' AS asked, count(*) FILTER (o_orderstatus = 'F') AS row_count, CAST(NULL AS VARCHAR) AS refusal FROM orders"
    " UNION ALL SELECT 'nope', NULL, 'no column ''nope'' in dataset ''orders' || chr(39)",
)
def f9_unknown_column(spark, d):
    """Rows kept, or the refusal naming column and dataset."""
    orders, parts = load_table(spark, d, "orders"), []
    for asked in ("o_orderstatus", "nope"):
        try:
            rows = apply_filters(orders, [Condition(asked, "eq", "F")], "orders").agg(F.count(F.lit(1)).alias("row_count"))
            parts.append(rows.select(F.lit(asked).alias("asked"), "row_count", F.lit(None).cast("string").alias("refusal")))
        except UnknownColumn as error:
            parts.append(spark.range(1).select(F.lit(asked).alias("asked"), F.lit(None).cast("long").alias("row_count"), F.lit(str(error)).alias("refusal")))
    return parts[0].unionAll(parts[1])
