"""Scalars, breakdowns, trends, correlation, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import (
    c,
    is_number,
    is_time,
    known,
    month_label,
    share_pct,
    to_number_lenient,
    to_time,
    type_of,
)
from brightledger.operators.filters import Condition, apply_filters, require_columns
from brightledger.operators.quantiles import exact_quantiles

AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count", "nunique")
CHART_ROWS = 100
DISTRIBUTION_BINS = 10
TOP_CATEGORIES = 20


def value_name(aggregation: str, metric: str | None) -> str:
    return f"{aggregation}_{metric or 'records'}"


def _check(df: DataFrame, aggregation: str, metric: str | None) -> None:
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation '{aggregation}'")
    if metric is None and aggregation != "count":
        raise ValueError(f"aggregation '{aggregation}' needs a metric column")


def measure(df: DataFrame, aggregation: str, metric: str | None) -> Column:
    """The grouped form: an all-null group sums to 0, other aggregates are NULL."""
    if aggregation == "count":
        return F.count(F.lit(1)).cast("double") if metric is None else F.count(known(df, metric)).cast("double")
    if aggregation == "nunique":
        return F.count_distinct(known(df, metric)).cast("double")
    number = to_number_lenient(df, metric).cast("double")
    return {
        "sum": F.coalesce(F.sum(number), F.lit(0.0)),
        "mean": F.avg(number),
        "min": F.min(number),
        "max": F.max(number),
    }[aggregation]


def grouped(
    df: DataFrame, keys: dict[str, Column], aggregation: str, metric: str | None, value_as: str = "value"
) -> DataFrame:
    """key columns + the value. Rows with a null key are dropped first."""
    _check(df, aggregation, metric)
    needed = {name: expr for name, expr in keys.items()}
    kept = df
    for expr in needed.values():
        kept = kept.filter(expr.isNotNull())
    if aggregation == "median":
        number = to_number_lenient(df, metric).cast("double").alias("_metric")
        flat = kept.select(*[expr.alias(name) for name, expr in needed.items()], number)
        out = exact_quantiles(flat, list(needed), "_metric", [0.5])
        return out.select(*[c(k) for k in needed], F.col("quantiles")[0].alias(value_as))
    return kept.groupBy(*[expr.alias(name) for name, expr in needed.items()]).agg(
        measure(df, aggregation, metric).alias(value_as)
    )


def scalar(
    df: DataFrame, aggregation: str, metric: str | None = None, filters: list[Condition] = (), dataset: str = "table"
) -> DataFrame:
    """A1: one row (value, row_count, status); no usable number is NULL, not 0."""
    require_columns(df, [metric], dataset)
    _check(df, aggregation, metric)
    df = apply_filters(df, filters, dataset)
    rows = F.count(F.lit(1)).alias("row_count")
    if aggregation == "median":
        number = df.select(to_number_lenient(df, metric).cast("double").alias("_x"))
        middle = exact_quantiles(number, [], "_x", [0.5])
        out = df.agg(rows).join(middle.select(F.col("quantiles")[0].alias("value")), how="left")
    else:
        out = df.agg(_scalar_measure(df, aggregation, metric).alias("value"), rows)
    short = F.col("value").isNull() | (F.col("row_count") == 0)
    return out.select(
        "value",
        "row_count",
        F.when(short, "insufficient_data").otherwise("ok").alias("status"),
    )


def scalars(df: DataFrame, wanted: list[tuple[str, str | None]], filters: list[Condition] = (), dataset: str = "table") -> DataFrame:
    """A1 for several (aggregation, metric) pairs: all but medians in one pass."""
    for aggregation, metric in wanted:
        require_columns(df, [metric], dataset)
        _check(df, aggregation, metric)
    df = apply_filters(df, filters, dataset)
    numbers = [i for i, (aggregation, _) in enumerate(wanted) if aggregation != "median"]
    values = {i: _scalar_measure(df, *wanted[i]).alias(f"v{i}") for i in numbers}
    wide = df.agg(F.count(F.lit(1)).alias("row_count"), *values.values())
    metrics = list(dict.fromkeys(metric for aggregation, metric in wanted if aggregation == "median"))
    if metrics:
        long = df.select(*[to_number_lenient(df, m).cast("double").alias(m) for m in metrics])
        long = long.unpivot([], [c(m) for m in metrics], "metric", "_x")
        middles = exact_quantiles(long, ["metric"], "_x", [0.5], few_groups=True)
        found = middles.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("quantiles")[0]))).alias("medians"))
        wide = wide.withColumn("medians", found.scalar())
    structs = [
        F.struct(
            F.lit(aggregation).alias("aggregation"),
            F.lit(metric).cast("string").alias("metric"),
            (F.col(f"v{i}") if i in values else F.col("medians")[F.lit(metric)]).cast("double").alias("value"),
        )
        for i, (aggregation, metric) in enumerate(wanted)
    ]
    short = F.col("s.value").isNull() | (F.col("row_count") == 0)
    return wide.select("row_count", F.explode(F.array(*structs)).alias("s")).select(
        "s.aggregation", "s.metric", "s.value", "row_count", F.when(short, "insufficient_data").otherwise("ok").alias("status")
    )


def _scalar_measure(df: DataFrame, aggregation: str, metric: str | None) -> Column:
    if aggregation == "sum":
        return F.sum(to_number_lenient(df, metric).cast("double"))
    return measure(df, aggregation, metric)


def breakdown(
    df: DataFrame,
    dimension: str,
    aggregation: str = "sum",
    metric: str | None = None,
    filters: list[Condition] = (),
    top_n: int | None = None,
    sort: str = "desc",
    pct_base: str = "shown",
    dataset: str = "table",
) -> DataFrame:
    """One row per group, ordered by value then key.

    `percentage_of_total` (sum, count and nunique only) divides by the rows
    shown (`pct_base="shown"`) or by all groups (`"all"`).
    """
    require_columns(df, [dimension, metric], dataset)
    df = apply_filters(df, filters, dataset)
    name = value_name(aggregation, metric)
    groups = grouped(df, {dimension: known(df, dimension)}, aggregation, metric, "_value").filter("_value IS NOT NULL")
    order = [F.col("_value").asc() if sort == "asc" else F.col("_value").desc(), c(dimension).asc()]
    shown = groups.orderBy(*order).limit(top_n) if top_n else groups
    if aggregation in ("sum", "count", "nunique"):
        if top_n and pct_base == "shown":
            # At most top_n rows: a single-task window is enough.
            total = F.sum("_value").over(Window.partitionBy())
        else:
            # Not a window: that would pull every group into one task.
            total = groups.agg(F.sum("_value")).scalar()
        shown = shown.withColumn("percentage_of_total", share_pct(F.col("_value"), total))
    return shown.orderBy(*order).withColumnRenamed("_value", name)


def breakdown2(
    df: DataFrame,
    first: str,
    second: str,
    aggregation: str = "sum",
    metric: str | None = None,
    filters: list[Condition] = (),
    top_n: int | None = None,
    dataset: str = "table",
) -> DataFrame:
    """A3: two dimensions, largest first whatever the sort, at most top_n or 100 rows."""
    require_columns(df, [first, second, metric], dataset)
    df = apply_filters(df, filters, dataset)
    groups = grouped(df, {first: known(df, first), second: known(df, second)}, aggregation, metric, "_value")
    return (
        groups.filter("_value IS NOT NULL")
        .orderBy(F.col("_value").desc(), c(first).asc(), c(second).asc())
        .limit(top_n or CHART_ROWS)
        .withColumnRenamed("_value", value_name(aggregation, metric))
    )


def monthly(
    df: DataFrame,
    date_column: str,
    aggregation: str = "sum",
    metric: str | None = None,
    dimension: str | None = None,
    filters: list[Condition] = (),
    date_layout: str | None = None,
    dataset: str = "table",
) -> DataFrame:
    """Month (and dimension) groups, without the two-row rule."""
    require_columns(df, [date_column, metric, dimension], dataset)
    df = apply_filters(df, filters, dataset)
    keys = {"period": month_label(to_time(df, date_column, date_layout))}
    if dimension:
        keys[dimension] = known(df, dimension)
    return grouped(df, keys, aggregation, metric)


def trend(
    df: DataFrame,
    date_column: str,
    aggregation: str = "sum",
    metric: str | None = None,
    dimension: str | None = None,
    filters: list[Condition] = (),
    date_layout: str | None = None,
    dataset: str = "table",
) -> DataFrame:
    """A4: monthly trend in period order; empty below two result rows."""
    groups = monthly(df, date_column, aggregation, metric, dimension, filters, date_layout, dataset)
    # One row or none. It reads the values too, so that it has the columns of the
    # groups and reuses their shuffle; a filter would move below the grouping.
    enough = groups.agg(F.count(F.lit(1)).alias("_rows"), F.max(F.struct("value")).alias("_top")).filter("_rows >= 2 AND _top IS NOT NULL")
    order = [F.col("period")] + ([c(dimension)] if dimension else [])
    return groups.crossJoin(F.broadcast(enough)).drop("_rows", "_top").orderBy(*order)


def compare_periods(
    df: DataFrame,
    date_column: str,
    period_a: str,
    period_b: str,
    aggregation: str = "sum",
    metric: str | None = None,
    filters: list[Condition] = (),
    date_layout: str | None = None,
) -> DataFrame:
    """A5: two months side by side; the change in percent is NULL from zero."""
    groups = monthly(df, date_column, aggregation, metric, None, filters, date_layout)
    wanted = groups.filter(F.col("period").isin(period_a, period_b))
    sides = wanted.agg(
        F.max(F.when(F.col("period") == period_a, F.col("value"))).alias("value_a"),
        F.max(F.when(F.col("period") == period_b, F.col("value"))).alias("value_b"),
    )
    change = F.col("value_b") - F.col("value_a")
    return sides.select(
        F.lit(period_a).alias("period_a"),
        "value_a",
        F.lit(period_b).alias("period_b"),
        "value_b",
        F.round(change, 2).alias("absolute_change"),
        F.when(F.col("value_a") != 0, share_pct(change, F.col("value_a"))).alias("percentage_change"),
        F.when(F.col("value_a").isNull() | F.col("value_b").isNull(), "period_not_found").otherwise("ok").alias("status"),
    )


def correlation(df: DataFrame, first: str, second: str) -> DataFrame:
    """Pearson over complete pairs; NULL below three pairs or on a constant."""
    pairs = _pairs(df, first, second)
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs_considered"),
        F.try_divide(F.covar_pop("_a", "_b"), spread).alias("_r"),
    ).select(
        F.when(F.col("pairs_considered") >= 3, F.round("_r", 4)).alias("coefficient"),
        "pairs_considered",
    )


def correlation_sample(df: DataFrame, first: str, second: str) -> DataFrame:
    """Up to 100 complete pairs for a scatter plot."""
    return _pairs(df, first, second).limit(CHART_ROWS).toDF(first, second)


def _pairs(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.select(
        to_number_lenient(df, first).cast("double").alias("_a"),
        to_number_lenient(df, second).cast("double").alias("_b"),
    ).filter("_a IS NOT NULL AND _b IS NOT NULL")


def numeric_distribution(df: DataFrame, column: str, bins: int = DISTRIBUTION_BINS) -> DataFrame:
    """Equal-width right-closed bins, empty ones included."""
    x = df.select(known(df, column).cast("double").alias("x")).filter("x IS NOT NULL")
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = F.col("ends.lo"), F.col("ends.hi")
    width = (hi - lo) / bins
    place = F.ceil(F.try_divide(F.col("x") - lo, width)).cast("int")
    number = F.coalesce(F.least(F.lit(bins), F.greatest(F.lit(1), place)), F.lit(1)).alias("bin")
    counts = x.withColumn("ends", span.select(F.struct("lo", "hi")).scalar()).groupBy(number).agg(F.count(F.lit(1)).alias("n"))
    edges = (
        span.filter("lo IS NOT NULL")
        .select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
        .select(
            "bin",
            (F.col("lo") + (F.col("hi") - F.col("lo")) / bins * (F.col("bin") - 1)).alias("from_value"),
            (F.col("lo") + (F.col("hi") - F.col("lo")) / bins * F.col("bin")).alias("to_value"),
        )
    )
    return (
        edges.join(counts, "bin", "left")
        .select("bin", "from_value", "to_value", F.coalesce("n", F.lit(0)).alias("row_count"))
        .orderBy("bin")
    )


def categorical_distribution(df: DataFrame, column: str, top: int = TOP_CATEGORIES) -> DataFrame:
    """The most frequent values."""
    return (
        df.filter(known(df, column).isNotNull())
        .groupBy(known(df, column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.col("row_count").desc(), F.col("value"))
        .limit(top)
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    dtype = type_of(df, column)
    return numeric_distribution(df, column) if is_number(dtype) else categorical_distribution(df, column)


def chart_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """At most 100 rows feed a chart."""
    return df.orderBy(*order).limit(CHART_ROWS)


def capped(df: DataFrame, max_rows: int) -> tuple[list, bool]:
    """At most max_rows rows on the driver, and whether there were more."""
    rows = df.limit(max_rows + 1).collect()
    return rows[:max_rows], len(rows) > max_rows


def is_groupable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, T.MapType) and (is_number(dtype) or is_time(dtype) or isinstance(dtype, (T.StringType, T.BooleanType)))
