import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from brightledger.operators.aggregate import (
    breakdown,
    breakdown2,
    categorical_distribution,
    compare_periods,
    correlation,
    correlation_sample,
    numeric_distribution,
    scalar,
    scalars,
    trend,
)
from brightledger.operators.filters import (
    Condition,
    DrillStep,
    UnknownColumn,
    apply_filters,
    drill_filters,
    next_dimension,
    result_status,
)
from brightledger.operators import quantiles
from brightledger.operators.quantiles import exact_quantiles, value_band
from tests.conftest import as_dicts, order_rows


def kept(df, *conditions):
    return sorted(row[0] for row in apply_filters(df, conditions).collect())


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, "A", 1.0, "$1,000"), (2, "b", 2.5, "250"), (3, None, None, "junk"), (4, "ab", float("nan"), None)]
    return spark.createDataFrame(rows, "id long, s string, x double, money string")


def test_equality_is_typed(mixed):
    assert kept(mixed, Condition("s", "eq", "A")) == [1]
    assert kept(mixed, Condition("id", "eq", "1")) == []  # text never equals a number
    assert kept(mixed, Condition("s", "eq", 1)) == []
    assert kept(mixed, Condition("id", "eq", 1.5)) == []
    assert kept(mixed, Condition("id", "in", [1, "2", 4])) == [1, 4]


def test_not_equal_keeps_nulls(mixed):
    assert kept(mixed, Condition("s", "ne", "A")) == [2, 3, 4]
    assert kept(mixed, Condition("id", "ne", "x")) == [1, 2, 3, 4]


def test_order_comparisons_read_currency_and_skip_nan(mixed):
    assert kept(mixed, Condition("money", "gt", 500)) == [1]
    assert kept(mixed, Condition("money", "lte", 1000)) == [1, 2]
    assert kept(mixed, Condition("x", "gt", 0)) == [1, 2]
    assert kept(mixed, Condition("x", "gte", "2.5")) == [2]


@pytest.mark.parametrize("op, bound", [(op, b) for op in ("gt", "gte", "lt", "lte") for b in (-1.5, 0, 2, 2.5, 3.0)])
def test_whole_number_bounds(spark, op, bound):
    import operator

    df = spark.range(6)
    test = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}[op]
    assert kept(df, Condition("id", op, bound)) == [i for i in range(6) if test(i, bound)]


def test_contains_is_case_insensitive_regex(mixed):
    assert kept(mixed, Condition("s", "contains", "a|B")) == [1, 2, 4]
    assert kept(mixed, Condition("s", "contains", "none")) == []


def test_unknown_column_names_dataset(mixed):
    with pytest.raises(UnknownColumn, match="nope.*sales"):
        apply_filters(mixed, [Condition("nope", "eq", 1)], "sales")


def test_empty_result_has_status(mixed):
    assert result_status(apply_filters(mixed, [Condition("s", "eq", "zzz")])).first()["status"] == "insufficient_data"


def test_drill_down_path(orders):
    path = [DrillStep("region", "North")]
    assert next_dimension(["region", "customer_id"], path) == "customer_id"
    out = breakdown(orders(), "customer_id", "sum", "amount", drill_filters(path))
    expected = {}
    for _, _, customer, amount, region in order_rows(20):
        if region == "North":
            expected[customer] = expected.get(customer, 0) + amount
    assert {r["customer_id"]: r["sum_amount"] for r in as_dicts(out)} == expected


def test_sum_of_orders(orders):
    row = scalar(orders(), "sum", "amount").first()
    assert row["value"] == sum(100 + 10 * i for i in range(1, 21)) and row["row_count"] == 20


def test_scalars_agree_with_single_ones(orders):
    wanted = [(a, "amount") for a in ("sum", "mean", "median", "min", "max", "count", "nunique")] + [("count", None)]
    many = {(r["aggregation"], r["metric"]): r["value"] for r in as_dicts(scalars(orders(), wanted))}
    for agg, metric in wanted:
        assert many[(agg, metric)] == scalar(orders(), agg, metric).first()["value"]


def test_no_numbers_is_insufficient(customers):
    for agg in ("sum", "mean", "median"):
        row = scalar(customers, agg, "name").first()
        assert row["value"] is None and row["status"] == "insufficient_data"


def test_count_with_and_without_metric(mixed):
    assert scalar(mixed, "count").first()["value"] == 4
    assert scalar(mixed, "count", "x").first()["value"] == 2  # null and NaN are missing
    assert scalar(mixed, "nunique", "x").first()["value"] == 2


def test_null_groups_dropped_and_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 5.0), ("b", 3.0)], "k string, v double")
    assert {r["k"]: r["sum_v"] for r in as_dicts(breakdown(df, "k", "sum", "v"))} == {"a": 0.0, "b": 3.0}
    assert [r["k"] for r in as_dicts(breakdown(df, "k", "mean", "v"))] == ["b"]


def test_share_of_shown_and_of_all(spark):
    df = spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 1.0)], "k string, v double")
    shown = {r["k"]: r["percentage_of_total"] for r in as_dicts(breakdown(df, "k", "sum", "v", top_n=2))}
    whole = {r["k"]: r["percentage_of_total"] for r in as_dicts(breakdown(df, "k", "sum", "v", top_n=2, pct_base="all"))}
    assert shown == {"a": 66.67, "b": 33.33} and whole == {"a": 60.0, "b": 30.0}


def test_share_without_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "k string, v double")
    assert all(r["percentage_of_total"] is None for r in as_dicts(breakdown(df, "k", "sum", "v")))
    assert "percentage_of_total" not in breakdown(df, "k", "mean", "v").columns


def test_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, v double")
    assert [r["k"] for r in as_dicts(breakdown(df, "k", "sum", "v"))] == ["c", "a", "b"]
    assert [r["k"] for r in as_dicts(breakdown(df, "k", "sum", "v", sort="asc", top_n=2))] == ["a", "b"]


def test_two_dimensions_descending_and_capped(spark):
    rows = [("North", "A", 10.0), ("North", "B", 20.0), ("South", "A", 5.0), ("South", "B", 30.0), ("North", "A", 1.0), ("South", None, 99.0)]
    df = spark.createDataFrame(rows, "region string, category string, revenue double")
    out = as_dicts(breakdown2(df, "region", "category", "sum", "revenue", top_n=3))
    assert [(r["region"], r["category"], r["sum_revenue"]) for r in out] == [("South", "B", 30.0), ("North", "B", 20.0), ("North", "A", 11.0)]


def test_dimension_called_value_or_with_a_dot(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 4.0, "x")], ["value", "net.price", "my dim"])
    assert [tuple(r) for r in breakdown(df, "value", "sum", "net.price").collect()] == [("b", 4.0, 57.14), ("a", 3.0, 42.86)]
    assert [tuple(r) for r in breakdown2(df, "my dim", "value", "median", "net.price", top_n=1).collect()] == [("x", "b", 4.0)]
    assert scalar(df, "mean", "net.price", [Condition("my dim", "eq", "x")]).first()["value"] == 2.5


def test_trend_by_text_dates(orders):
    expected = {}
    for _, day, _, amount, _ in order_rows(20):
        expected[day[:7]] = expected.get(day[:7], 0) + amount
    out = as_dicts(trend(orders(), "date", "sum", "amount", date_layout="yyyy-M-d"))
    assert [r["period"] for r in out] == sorted(expected)
    assert {r["period"]: r["value"] for r in out} == expected


def test_trend_needs_two_rows_not_two_periods(spark):
    one = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-09", "b")], "d string, k string").withColumn("d", F.col("d").cast("date"))
    assert trend(one, "d", "count").count() == 0
    assert trend(one, "d", "count", dimension="k").count() == 2


def test_compare_periods(orders):
    row = compare_periods(orders(), "date", "2024-01", "2024-02", "sum", "amount", date_layout="yyyy-M-d").first()
    a = sum(r[3] for r in order_rows(20) if r[1][:7] == "2024-01")
    b = sum(r[3] for r in order_rows(20) if r[1][:7] == "2024-02")
    assert (row["value_a"], row["value_b"], row["absolute_change"]) == (a, b, b - a)
    assert row["percentage_change"] == round((b - a) / a * 100, 2)
    assert compare_periods(orders(), "date", "2024-01", "2030-01", "sum", "amount", date_layout="yyyy-M-d").first()["status"] == "period_not_found"


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.1, 7.0), (3.0, 5.9, 7.0), (4.0, None, 7.0)], "a double, b double, c double")
    xs, ys = [1.0, 2.0, 3.0], [2.0, 4.1, 5.9]
    assert correlation(df, "a", "b").first().asDict() == {"coefficient": round(statistics.correlation(xs, ys), 4), "pairs_considered": 3}
    assert correlation(df, "a", "c").first()["coefficient"] is None  # constant
    assert correlation(df.limit(2), "a", "b").first()["coefficient"] is None  # too few pairs
    assert correlation_sample(df, "a", "b").count() == 3


def test_histogram_is_right_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    out = as_dicts(numeric_distribution(df, "x"))
    assert [r["row_count"] for r in out] == [2, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    same = as_dicts(numeric_distribution(spark.createDataFrame([(5.0,)] * 3, "x double"), "x"))
    assert sum(r["row_count"] for r in same) == 3 and len(same) == 10


def test_category_counts(spark):
    df = spark.createDataFrame([("x",)] * 3 + [("b",)] * 2 + [("a",)] * 2 + [(None,)], "k string")
    assert [(r["value"], r["row_count"]) for r in as_dicts(categorical_distribution(df, "k"))] == [("x", 3), ("a", 2), ("b", 2)]


def linear_quantile(values, p):
    values = sorted(values)
    spot = p * (len(values) - 1)
    low = math.floor(spot)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (spot - low)


def test_ranked_quantiles_with_one_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot", rng.choice([0.0, -1e-9, rng.gauss(0, 1e6), round(rng.random(), 2)])) for _ in range(3000)]
    rows += [(f"k{i % 40}", rng.uniform(-5, 5)) for i in range(1000)] + [("one", 4.25), ("none", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for few in (False, True):
        got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "v", points, few).collect()}
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            assert got[k] == pytest.approx([linear_quantile(values, p) for p in points], rel=1e-12, abs=1e-12), (few, k)


def test_quantiles_of_narrow_and_tiny_values(spark):
    rng = random.Random(11)
    rows = [("time", 1.7e9 + rng.random() / 100) for _ in range(2000)] + [("tiny", rng.uniform(1, 1000) * 1e-13) for _ in range(1000)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(500)] + [("same", 7.5)] * 300
    df = spark.createDataFrame(rows, "k string, v double")
    points = [0.0, 0.01, 0.3, 0.5, 0.95, 1.0]
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "v", points).collect()}
    for k in ("time", "tiny", "wide", "same"):
        values = [v for name, v in rows if name == k]
        assert got[k] == pytest.approx([linear_quantile(values, p) for p in points], rel=1e-12), k
    bands = df.filter("k = 'tiny'").select(value_band(F.col("v")).alias("b")).distinct().count()
    assert bands > 500


def test_bands_keep_the_order(spark):
    values = sorted([-1e12, -3.5, -1e-7, 0.0, 1e-9, 0.3, 0.30001, 7.0, 1e3, 1e12])
    bands = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(value_band(F.col("x"))).collect()]
    assert bands == sorted(bands)


@pytest.mark.parametrize("held", [1, 7, 1 << 20])
def test_quantiles_of_few_groups_cut_ranges_until_they_are_small(spark, monkeypatch, held):
    monkeypatch.setattr(quantiles, "SORTED_ROWS", held)
    rng = random.Random(5)
    rows = [("near", 1.7e9 + rng.random()) for _ in range(300)] + [("ties", float(rng.choice([1, 1, 1, 2, 50]))) for _ in range(301)]
    rows += [("signs", rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9)) for _ in range(200)] + [("one", 4.0), ("none", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    wanted = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "x", wanted, few_groups=True).collect()}
    assert set(got) == {"near", "ties", "signs", "one", None}
    for group, values in got.items():
        mine = sorted(x for g, x in rows if g == group and x is not None)
        at = [p * (len(mine) - 1) for p in wanted]
        assert values == pytest.approx([mine[int(a)] + (mine[min(int(a) + 1, len(mine) - 1)] - mine[int(a)]) * (a - int(a)) for a in at], rel=1e-12)
    whole = exact_quantiles(df.filter("g = 'near'"), [], "x", [0.5]).first()[0]
    assert whole == pytest.approx([got["near"][2]], rel=1e-15)
    counted = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    assert {r.g: r.quantiles for r in exact_quantiles(counted, ["g"], "x", wanted, few_groups=True, times="n").collect()} == got
    assert exact_quantiles(df.filter("false"), [], "x", [0.5]).count() == 0
