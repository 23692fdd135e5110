"""Profiles of merged states against profiles of the rows."""

from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from brightledger.operators.profile import PROFILE_SCHEMA, compact_value, profile_table
from brightledger.operators.states import States, batch_states, load_states, merge_states, profile_states, save_states

SCHEMA = "id long, name string, price string, day string, when timestamp_ntz, born date, ratio double, small float, flag boolean, tags array<string>, gone string"


def _rows(n):
    return [
        (
            i, f"name {i % 7}", f"€{i % 13},{i % 10}00.5" if i % 5 else None, f"{i % 28 + 1}/{i % 12 + 1}/2024", datetime(2024, 1 + i % 12, 3, i % 24), date(2020, 1, 1 + i % 30),
            float("nan") if i % 11 == 0 else 1e9 + (i * 7919 % 1000) / 7, (i % 9) / 10, None if i % 3 else i % 2 == 0, ["a", str(i % 4)], None,
        )
        for i in range(n)
    ]


def _same(a, b):
    assert a.row_count == b.row_count and a.duplicate_row_count == b.duplicate_row_count
    for x, y in zip(a.columns, b.columns, strict=True):
        for f in PROFILE_SCHEMA:
            want = y[f.name]
            assert x[f.name] == (pytest.approx(want) if isinstance(want, float) else want), (x["column_name"], f.name)


@pytest.mark.parametrize("cuts", [[0, 400], [0, 1, 2, 150, 400], [0, 0, 400]])
def test_merged_batches_are_the_whole_table(spark, tmp_path, cuts):
    rows = _rows(390) + _rows(10)
    df = spark.createDataFrame(rows, SCHEMA)
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        save_states(batch_states(spark.createDataFrame(rows[low:high], SCHEMA)), str(tmp_path), "t/1", f"b {i}")
    _same(profile_states(load_states(spark, str(tmp_path), "t/1"), "t"), profile_table(df, "t"))


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame(_rows(60), SCHEMA)
    for rows in (df.limit(20), df):
        save_states(batch_states(rows), str(tmp_path), "t", "only")
    _same(profile_states(load_states(spark, str(tmp_path), "t"), "t"), profile_table(df, "t"))


def test_layouts_are_chosen_from_all_batches(spark):
    # Either batch alone would read day and month the other way round.
    one = spark.createDataFrame([(f"{i}/{j}/2024",) for i in range(1, 13) for j in (1, 2)], "d string")
    two = spark.createDataFrame([(f"{i}/5/2024",) for i in range(13, 29) for _ in range(3)], "d string")
    merged = profile_states(merge_states([batch_states(one), batch_states(two)]), "t")
    _same(merged, profile_table(one.unionByName(two), "t"))
    assert merged.columns[0]["date_layout"] == "d/M/yyyy"


def test_columns_of_other_types_are_refused(spark):
    a, b = spark.range(3).select("id"), spark.range(3).select(F.col("id").cast("string"))
    with pytest.raises(ValueError, match="id"):
        profile_states(merge_states([batch_states(a), batch_states(b)]), "t")


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    _same(profile_states(merge_states([batch_states(empty)]), "t"), profile_table(empty, "t"))


def test_values_are_counted_without_sorting_cells(spark):
    rows = [(1, "a", -0.0, [1]), (1, "a", 0.0, [1]), (None, None, float("nan"), None), (2, "0.0", 2.5, [])]
    df = spark.createDataFrame(rows, "id int, name string, ratio double, list array<int>")
    states = batch_states(df)
    merged = merge_states([states, batch_states(df)])
    for values, times in ((states.values, 1), (merged.values, 2)):
        assert "SortAggregate" not in values._jdf.queryExecution().executedPlan().toString()
        keys = df.select(*[compact_value(df, n).alias(n) for n in df.columns]).collect()
        wanted = Counter((n, r[n]) for r in keys for n in df.columns if r[n] is not None)
        assert {(r["column_name"], r["value_key"]): r["n"] for r in values.collect()} == {k: n * times for k, n in wanted.items()}
        assert {(r["column_name"], r["value"]) for r in values.collect()} == {
            ("id", "1"), ("id", "2"), ("name", "a"), ("name", "0.0"), ("ratio", "0.0"), ("ratio", "2.5"), ("list", "[1]"), ("list", "[]"),
        }


def test_zeros_kept_with_a_sign_are_zeros(spark):
    states = batch_states(spark.createDataFrame([(0.0,)], "x double"))
    signed = States(states.columns, states.values.withColumn("value", F.lit("-0.0")), states.rows)
    assert merge_states([states, signed]).values.select("value_key", "n", "value").collect() == [("0.0", 2, "0.0")]
