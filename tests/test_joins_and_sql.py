import pytest
from pyspark.sql import functions as F

from brightledger.operators.joins import (
    FanOutRefused,
    JoinSpec,
    column_suffix,
    find_existing_join,
    join_identity,
    join_stats,
    joined,
    joined_counts,
    lineage_row,
    preview_join,
    safe_join,
    unmatched_rows,
)
from brightledger.operators.profile import batch_reprofile, profile_frame
from brightledger.operators.relationships import detect_relationships, value_overlaps
from brightledger.operators.sql import SqlRefused, sql_query, view_names
from tests.conftest import as_dicts


def test_inner_join_statistics(orders, customers):
    row = join_stats(orders(10), customers, JoinSpec("customer_id", "customer_id")).first()
    assert (row["rows_after"], row["unmatched_left"], row["unmatched_right"]) == (10, 0, 3)
    assert row["cardinality"] == "many_to_one" and row["key_overlap_percentage"] == 100.0
    assert row["estimated_fan_out_rows"] is None


@pytest.mark.parametrize("how, rows", [("inner", 9), ("left", 10), ("right", 9 + 3), ("full", 13)])
def test_join_types(orders, customers, how, rows):
    left = orders(10).withColumn("customer_id", F.when(F.col("order_id") == 1, F.lit(999)).otherwise(F.col("customer_id")))
    spec = JoinSpec("customer_id", "customer_id", how)
    stats = join_stats(left, customers, spec).first()
    out = safe_join(left, customers, spec)
    assert out.count() == stats["rows_after"] == rows
    assert out.columns.count("customer_id") == 1 and out.filter("customer_id IS NULL").count() == 0
    assert unmatched_rows(left, customers, "customer_id", "customer_id").count() == 1


def test_many_to_many_is_refused(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (2,)], "k int")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (3, "w")], "k int, v string")
    with pytest.raises(FanOutRefused, match="6 rows"):
        safe_join(left, right, JoinSpec("k", "k"))
    assert safe_join(left, right, JoinSpec("k", "k", allow_fan_out=True)).count() == 6
    assert preview_join(left, right, JoinSpec("k", "k")).first()["estimated_fan_out_rows"] == 6


def test_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "j int")
    match = join_stats(left, right, JoinSpec("k", "j")).first()
    drop = join_stats(left, right, JoinSpec("k", "j", null_keys="drop")).first()
    assert match["matched_both"] == 3 and drop["matched_both"] == 1
    assert match["key_overlap_percentage"] == drop["key_overlap_percentage"] == 100.0
    assert match["cardinality"] == "many_to_one"  # two nulls repeat a key
    assert safe_join(left, right, JoinSpec("k", "j")).count() == 3
    assert safe_join(left, right, JoinSpec("k", "j", null_keys="drop")).count() == 1


def test_different_kinds_never_match(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([("1",), ("x",)], "k string")
    row = preview_join(left, right, JoinSpec("k", "k", "full")).first()
    assert row["matched_both"] == 0 and any("type mismatch" in n for n in row["notes"])
    assert safe_join(left, right, JoinSpec("k", "k")).count() == 0


def test_suffixes_differ_for_sheets_of_one_file():
    a, b = column_suffix("A very long report name.xlsx — Facts"), column_suffix("A very long report name.xlsx — Dims")
    assert a != b and a.startswith("_facts_") and len(a.rsplit("_", 1)[1]) == 8
    assert column_suffix("Facts") != column_suffix("facts") and len(column_suffix("—")) == 9


def test_existing_join_is_found(spark):
    spec = JoinSpec("a", "b")
    lineage = lineage_row(spark, "d1", "l", "r", spec, "u")
    keys = "left_id string, left_column string, right_id string, right_column string, join_type string"
    requests = spark.createDataFrame([("l", "a", "r", "b", "inner"), ("l", "a", "r", "b", "left")], keys)
    assert {r["join_type"]: r["existing_id"] for r in as_dicts(find_existing_join(lineage, requests))} == {"inner": "d1", "left": None}
    assert join_identity("l", spec, "r") == "join:l:a:r:b:inner"


def test_relationship_of_orders_and_customers(spark, orders, customers):
    tables = {"orders": orders(40), "customers": customers}
    found = as_dicts(detect_relationships(tables, profile_frame(spark, batch_reprofile(tables))))
    best = found[0]
    assert (best["left_column"], best["right_column"], best["confidence"]) == ("customer_id", "customer_id", "HIGH")
    assert best["confidence_score"] == 95.0 and best["cardinality"] == "many_to_one"


def test_shared_categories_are_no_relationship(spark):
    a = spark.createDataFrame([(r, float(i)) for i, r in enumerate(["N", "S", "E", "W"] * 6)], "Region string, x double")
    b = spark.createDataFrame([(r, float(i)) for i, r in enumerate(["N", "S", "E", "W"] * 5)], "Region string, y double")
    tables = {"a": a, "b": b}
    assert detect_relationships(tables, profile_frame(spark, batch_reprofile(tables))).count() == 0


def test_stem_match_and_value_cap(spark):
    products = spark.createDataFrame([(f"P{i}", i) for i in range(30)], "product_code string, n int")
    sales = spark.createDataFrame([(f"P{i % 10}", float(i)) for i in range(40)], "ProductID string, amount double")
    tables = {"products": products, "sales": sales}
    rows = profile_frame(spark, batch_reprofile(tables))
    by_stem = as_dicts(detect_relationships(tables, rows))[0]
    assert by_stem["confidence_score"] == 80.0 and by_stem["reasons"][0] == "same_key_stem"
    codes = products.withColumnRenamed("product_code", "product_id")
    tables = {"products": codes, "sales": sales}
    rows = profile_frame(spark, batch_reprofile(tables))
    best = as_dicts(detect_relationships(tables, rows))[0]
    assert best["confidence_score"] == 95.0 and best["reasons"][0] == "same_name"
    capped = as_dicts(detect_relationships(tables, rows, max_values=5))[0]
    assert capped["value_overlap_percentage"] is None and capped["confidence_score"] == 65.0


def test_overlaps_of_more_columns_than_one_word_holds(spark):
    wide = spark.range(6).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(70)])
    other = spark.range(4).select((F.col("id") * 3).alias("k"))
    columns = [("wide", f"c{i}") for i in range(70)] + [("other", "k")]
    got = {(r["a_column"], r["b_column"]): r["common"] for r in as_dicts(value_overlaps({"wide": wide, "other": other}, columns))}
    sets = [{j * (i + 1) for j in range(6)} for i in range(70)] + [{0, 3, 6, 9}]
    names = [n for _, n in columns]
    assert got == {(names[a], names[b]): len(sets[a] & sets[b]) for a in range(71) for b in range(a + 1, 71)}


# --- SQL ----------------------------------------------------------------------------


def test_sql_over_named_tables(orders, customers):
    result = sql_query(
        {"orders.csv": orders(20), "2024 customers": customers},
        "WITH j AS (SELECT * FROM orders_csv o JOIN t_2024_customers c ON o.customer_id = c.customer_id) "
        "SELECT segment, sum(amount) AS total FROM j WHERE region <> 'a;b' GROUP BY segment;",
    )
    assert sum(r["total"] for r in result.rows) == 4100.0 and not result.truncated
    assert result.table_columns["orders_csv"] == ["order_id", "date", "customer_id", "amount", "region"]


def test_row_cap(orders):
    result = sql_query({"o": orders(20)}, "SELECT * FROM o", max_rows=7)
    assert len(result.rows) == 7 and result.truncated


def test_view_names():
    names = view_names(["a b", "a-b", "1x", "—"])
    assert names["1x"] == "t_1x" and names["—"] == "dataset"
    assert names["a b"] != names["a-b"] and all(n.startswith("a_b_") for n in (names["a b"], names["a-b"]))


@pytest.mark.parametrize(
    "text",
    [
        "", ";", "DROP TABLE o", "SELECT 1; SELECT 2", "INSERT INTO o VALUES (1)", "selection",
        "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT `reflect`('java.lang.System', 'exit', 0)",
        "SELECT reflect /* x */ ('java.lang.System', 'exit', 0)", "SELECT * FROM o WHERE amount IN (SELECT java_method('a', 'b'))",
        "WITH a AS (SELECT try_reflect('a', 'b')) SELECT * FROM a", "SELECT * FROM other", "SELECT * FROM o JOIN parquet.`/x` USING (a)",
        "SELECT (SELECT max(x) FROM other) FROM o", "SELECT * FROM spark_catalog.default.o", "WITH a AS (SELECT * FROM other) SELECT * FROM o",
    ],
)
def test_refused_texts(orders, text):
    frame = orders(3)
    frame.createOrReplaceTempView("other")
    with pytest.raises(SqlRefused):
        sql_query({"o": frame}, text)
    frame.sparkSession.catalog.dropTempView("other")


def test_views_are_neither_replaced_nor_left(spark, orders):
    spark.range(3).createOrReplaceTempView("o")
    before = {t.name for t in spark.catalog.listTables()}
    assert len(sql_query({"o": orders(5)}, "SELECT * FROM o WHERE region <> 'reflect(;)'").rows) == 5
    assert {t.name for t in spark.catalog.listTables()} == before and spark.table("o").count() == 3
    spark.catalog.dropTempView("o")


@pytest.mark.parametrize(
    "text", ["SELECT * FROM csv.`/etc/passwd`", "WITH a AS (SELECT 1) INSERT INTO o SELECT * FROM a", "SELECT nope FROM o", "SELECT 1) x; DROP VIEW o; --"]
)
def test_refused_by_analysis(orders, text):
    with pytest.raises(SqlRefused):
        sql_query({"o": orders(3)}, text)


def test_joined_counts_match_the_rows(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None), (3, "d")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (1, "q"), (None, "p"), (4, None)], "j int, x string")
    x, y = "x" + column_suffix("one"), "x" + column_suffix("two")
    for how in ("inner", "left", "right", "full"):
        for null_keys in ("match", "drop"):
            spec = JoinSpec("k", "j", how, "one", "two", True, null_keys)
            rows = joined(left, right, spec)
            for left_by, right_by, names in ((["x"], ["x"], [x, y]), ([], ["x"], [y]), (["k"], [], ["k"])):
                wanted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("joined_rows"))
                found = joined_counts(left, right, spec, left_by, right_by)
                assert found.columns == wanted.columns
                assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_joined_counts_build_no_pairs(spark):
    many = spark.range(300_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    out = joined_counts(many, many.withColumnRenamed("x", "y"), JoinSpec("k", "k"), right_by=["y"])
    assert out.agg(F.sum("joined_rows")).first()[0] == 2 * 150_000**2


def test_fan_out_query_counts_without_pairs(spark, tmp_path):
    from queries.joining import j6_fan_out_allowed

    spark.range(300_000).select((F.col("id") % 2).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(300_000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).cast("int").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    row = j6_fan_out_allowed(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.min("customers"), F.max("customers"), F.bool_and("refused_by_default")).first()
    assert tuple(row) == (300_000, 150_000, 150_000, True)
