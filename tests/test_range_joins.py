"""Interval joins against all pairs compared one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brightledger.operators.filters import UnknownColumn
from brightledger.operators.ranges import Span, interval_join

SIDE = "id long, key string, a double, b double"


def _rows(n, seed, start=0):
    rng = random.Random(seed)
    out = []
    for i in range(start, start + n):
        low = rng.choice([rng.uniform(-50, 50), rng.randint(-20, 20), rng.uniform(-1e6, 1e6), 7.0])
        length = rng.choice([0, 0.25, 1, rng.uniform(0, 3), rng.uniform(0, 200), 1e6, -1])
        out.append((i, rng.choice("xyz"), float(low), float(low + length)))
    return out + [(start + n, "x", None, 3.0), (start + n + 1, "x", 3.0, None), (start + n + 2, "y", float("-inf"), float("inf")), (start + n + 3, None, 0.0, 9.0), (start + n + 4, "y", float("nan"), 2.0)]


def _pairs(left, right, keyed, open_end):
    ok = lambda low, high: low is not None and high is not None and low <= high and (not open_end or low < high)
    less = (lambda x, y: x < y) if open_end else (lambda x, y: x <= y)
    return sorted(
        (i, j)
        for i, k, a, b in left
        for j, m, c, d in right
        if ok(a, b) and ok(c, d) and less(c, b) and less(a, d) and (not keyed or (k == m and k is not None))
    )


@pytest.mark.parametrize(("keyed", "open_end", "unit"), [(False, False, 1.0), (True, False, 0.1), (False, True, 50.0), (True, True, 1e-6)])
def test_interval_join(spark, keyed, open_end, unit):
    left, right = _rows(150, 1), _rows(170, 2, 1000)
    out = interval_join(
        spark.createDataFrame(left, SIDE).repartition(3), spark.createDataFrame(right, SIDE), Span("a", "b"), Span("a", "b"), [("key", "key")] if keyed else [], unit, open_end, "first", "second"
    )
    ids = [n for n in out.columns if n.startswith("id_")]
    assert len(ids) == 2 and len(out.columns) == 8
    assert sorted(map(tuple, out.select(*ids).collect())) == _pairs(left, right, keyed, open_end)


def test_points_in_intervals(spark):
    left = [(i, "x", float(i % 40), float(i % 40 + i % 5)) for i in range(80)]
    points = [(i, float(i) / 2) for i in range(100)]
    l, p = spark.createDataFrame(left, SIDE), spark.createDataFrame(points, "p long, at double")
    closed = interval_join(l, p, Span("a", "b"), Span("at"))
    assert sorted(map(tuple, closed.select("id", "p").collect())) == sorted((i, j) for i, _, a, b in left for j, x in points if a <= x <= b)
    half = interval_join(p, l, Span("at"), Span("a", "b"), open_end=True)
    assert sorted(map(tuple, half.select("id", "p").collect())) == sorted((i, j) for i, _, a, b in left for j, x in points if a <= x < b)
    assert interval_join(l.limit(0), p, Span("a", "b"), Span("at")).count() == 0
    assert interval_join(l, p.limit(0), Span("a", "b"), Span("at")).count() == 0
    with pytest.raises(UnknownColumn):
        interval_join(l, p, Span("a", "z"), Span("at"))


def test_times_and_odd_names(spark):
    day = datetime(2024, 3, 30)
    stays = [(i, day + timedelta(minutes=7 * i), day + timedelta(minutes=7 * i, seconds=(i * 991) % 5000)) for i in range(120)]
    l = spark.createDataFrame(stays, "`a.b` long, low timestamp_ntz, high timestamp_ntz")
    out = interval_join(l, l.withColumnRenamed("a.b", "`c`"), Span("low", "high"), Span("low", "high"), unit=600)
    got = sorted(map(tuple, out.select("`a.b`", "```c```").collect()))
    assert got == sorted((i, j) for i, a, b in stays for j, c, d in stays if c <= b and a <= d)


def test_plan_has_no_nested_loop(spark):
    left, right = spark.createDataFrame(_rows(50, 1), SIDE), spark.createDataFrame(_rows(50, 2), SIDE)
    out = interval_join(left, right, Span("a", "b"), Span("a", "b"), left_name="one", right_name="two")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hot_cell_is_posted_once_a_row(spark):
    # 4,000 points and 40 intervals in one place: pairs are the result alone.
    points = spark.range(4000).select(F.col("id"), (F.col("id") % 3).cast("double").alias("at"))
    spans = spark.range(40).select(F.col("id").alias("s"), F.lit(0.5).alias("low"), F.lit(2.0).alias("high"))
    assert interval_join(points, spans, Span("at"), Span("low", "high")).groupBy("s").count().agg(F.min("count"), F.max("count")).first() == (2666, 2666)
