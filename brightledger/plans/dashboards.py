"""Default chart data for one table or several."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import known, month_label, to_time
from brightledger.operators.aggregate import scalars, value_name
from brightledger.operators.groupings import cut_table
from brightledger.operators.joins import FanOutRefused, JoinSpec, join_identity
from brightledger.operators.profile import TableProfile, profile_frame, profile_table
from brightledger.operators.relationships import detect_relationships
from brightledger.plans.derived import derive_dataset, read_lineage
from brightledger.session import small_frame, work_folder
from brightledger.plans.kpis import Choice, choice_for, discover_kpis, title_case, without_currency

DONUT_SLICES = 12
STACKED_SERIES = 4
COMPARISON_GROUPS = 20
COMPOSITION_GROUPS = 7
COMPARISON_TOP = 10
MAX_CHARTS = 3
MAX_MERGED = 4
MAX_AUTO_JOINS = 2
MAX_DASHBOARD_KPIS = 6

# Aggregation words used in titles.
TITLE_WORDS = {
    "sum": "Total", "mean": "Average", "median": "Median", "min": "Minimum", "max": "Maximum",
    "count": "Count of", "nunique": "Distinct",
}
TREND_TYPES = ["line", "time_series"]
COMPARISON_TYPES = ["bar", "ranking", "grouped_bar", "stacked_bar", "donut", "pie"]


# --- labels and titles -----------------------------------------------------------


def chart_label(
    shape: str, group_count: Column, is_ranking: bool = False, requested: str | None = None, series_count: Column | None = None
) -> Column:
    """The chart type a result shape asks for; a requested donut or pie with
    too many slices becomes a bar chart."""
    if shape == "scalar":
        own = F.lit("kpi_card")
    elif shape == "timeseries":
        return F.lit("line")
    elif shape == "two_way":
        own = F.when(series_count > STACKED_SERIES, "stacked_bar").otherwise("grouped_bar")
    elif shape == "insufficient_data":
        return F.lit("insufficient_data")
    else:
        own = F.lit("ranking" if is_ranking else "bar")
    if requested is None:
        return own
    if requested in ("donut", "pie"):
        return F.when(group_count > DONUT_SLICES, "bar").otherwise(requested)
    return F.lit(requested)


def chart_title(aggregation: Column, metric: Column, dimension: Column, chart_type: Column) -> Column:
    """D6: "Total X by Y", "Monthly X Trend", or the bare figure."""
    bare = F.regexp_replace(F.replace(without_currency(metric), F.lit("_"), F.lit(" ")), "(sum|mean|nunique)_", "")
    label = title_case(F.trim(bare))
    words = F.create_map(*[F.lit(x) for pair in TITLE_WORDS.items() for x in pair])
    word = words[aggregation]
    prefix = F.when(F.startswith(F.lower(label), F.lower(word)), F.lit(None)).otherwise(word)
    by = title_case(F.replace(dimension, F.lit("_"), F.lit(" ")))
    figure = F.concat_ws(" ", prefix, label)
    return (
        F.when(chart_type.isin(TREND_TYPES), F.concat(F.lit("Monthly "), label, F.lit(" Trend")))
        .when(dimension.isNotNull(), F.concat(figure, F.lit(" by "), by))
        .otherwise(figure)
    )


# --- charts of one table ---------------------------------------------------------------


@dataclass
class _Wanted:
    """A chart asked for: a measure over one key."""

    key: Column | None
    x_column: str | None
    agg: str
    metric: str
    chart_type: Column
    y_column: str
    top: int | None = None  # groups shown; None: all
    filled: bool = True  # whether groups without a value are left out
    few: int = 2  # points below which there is no chart

    def cut(self) -> tuple[str | None, bool]:
        """Months and a dimension of the name "period" are two keys."""
        return self.x_column, self.filled


def _points(df: DataFrame, wanted: list[_Wanted]) -> DataFrame:
    """(chart, x_value, y_value, place) of all charts, from one pass over the
    table. A chart of a key needs two points at least and shows its `top`
    greatest; trends keep all their months. Groups are few here (a dimension has
    at most 50, a trend its months), so a chart is ranked in one task."""
    names = list(dict.fromkeys(w.cut() for w in wanted))
    keys = [next(w.key for w in wanted if w.cut() == n) for n in names]
    measures = list(dict.fromkeys((w.agg, w.metric) for w in wanted))
    rows = cut_table(df, keys, measures)

    def point(i: int, w: _Wanted) -> Column:
        value = F.col(f"v{measures.index((w.agg, w.metric))}").cast("double")
        here = F.col("cut") == names.index(w.cut())
        here = here & value.isNotNull() if w.filled else here
        return F.when(here, F.struct(F.lit(i).alias("chart"), value.alias("y_value")))

    spread = rows.withColumn("p", F.explode(F.array_compact(F.array(*[point(i, w) for i, w in enumerate(wanted)]))))
    spread = spread.select("p.chart", F.col("label").alias("x_value"), "p.y_value", *[f"k{i}" for i in range(len(keys))])
    of_chart = Window.partitionBy("chart")
    order = F.row_number().over(of_chart.orderBy(F.col("y_value").desc(), *[f"k{i}" for i in range(len(keys))]))
    tops = _by_chart([w.top for w in wanted], "int")
    ranked = spread.withColumns({"place": order, "points": F.count(F.lit(1)).over(of_chart)})
    least = _by_chart([w.few for w in wanted], "int")
    return ranked.filter((F.col("points") >= least) & (tops.isNull() | (F.col("place") <= tops))).select("chart", "x_value", "y_value", "place")


def _by_chart(values: list, dtype: str) -> Column:
    """The value of a row's chart."""
    out = F.lit(None).cast(dtype)
    for i, value in enumerate(values):
        out = F.when(F.col("chart") == i, (value if isinstance(value, Column) else F.lit(value)).cast(dtype)).otherwise(out)
    return out


def _trend_of(df: DataFrame, profile: TableProfile, day: str, agg: str, metric: str) -> _Wanted:
    period = month_label(to_time(df, day, profile.layout(day)))
    return _Wanted(period, "period", agg, metric, chart_label("timeseries", F.lit(0)), "value", filled=False)


def default_charts(df: DataFrame, profile: TableProfile, choice: Choice | None = None) -> DataFrame:
    """Trend, comparison, composition, else single figures; at most three.

    Which charts apply is known from the profile. All of them come from one
    pass over the table and one shuffle of grouped states.
    """
    choice = choice or choice_for(df, profile)
    if not choice.metrics:
        return _no_charts(df)
    metric, agg = choice.best()
    wanted: list[_Wanted] = []
    if choice.dates and _months(profile, choice.dates[0]) >= 2:
        wanted.append(_trend_of(df, profile, choice.dates[0], agg, metric))
    compared = None
    if choice.dimensions:
        first = choice.dimensions[0]
        groups = profile.column(first)["unique_count"]
        if 2 <= groups <= COMPARISON_GROUPS:
            label = chart_label("table", F.lit(groups), True)
            wanted.append(_Wanted(known(df, first), first, agg, metric, label, value_name(agg, metric), COMPARISON_TOP))
            compared = first
        second = choice.dimensions[-1]
        slices = profile.column(second)["unique_count"]
        if second != compared and 2 <= slices <= COMPOSITION_GROUPS:
            metric2, agg2 = choice.metrics[1] if len(choice.metrics) > 1 else (metric, agg)
            label = chart_label("table", F.lit(slices), requested="donut")
            wanted.append(_Wanted(known(df, second), second, agg2, metric2, label, value_name(agg2, metric2)))
    wanted = wanted[:MAX_CHARTS]
    if wanted:
        points = _points(df, wanted)
    else:
        pairs = [(a, m) for m, a in choice.metrics[:2]]
        wanted = [_Wanted(None, None, a, m, chart_label("scalar", F.lit(1)), m) for a, m in pairs]
        number = _by_pair(pairs)
        points = scalars(df, pairs).filter("status = 'ok'").select(number.alias("chart"), F.lit(None).cast("string").alias("x_value"), F.col("value").alias("y_value"))
    titles = [chart_title(F.lit(w.agg), F.lit(w.metric), F.lit(None if w.x_column == "period" else w.x_column).cast("string"), w.chart_type) for w in wanted]
    return points.select(
        F.lit(profile.dataset_id).alias("dataset_id"),
        _by_chart([w.chart_type for w in wanted], "string").alias("chart_type"),
        _by_chart([w.x_column for w in wanted], "string").alias("x_column"),
        _by_chart([w.y_column for w in wanted], "string").alias("y_column"),
        _by_chart([w.agg for w in wanted], "string").alias("aggregation"),
        _by_chart(titles, "string").alias("title"),
        "x_value",
        "y_value",
        (F.col("chart") + 1).cast("int").alias("chart_no"),
    )


def _by_pair(pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("int")
    for i, (agg, metric) in enumerate(pairs):
        out = F.when((F.col("aggregation") == agg) & (F.col("metric") == metric), i).otherwise(out)
    return out


def _months(profile: TableProfile, name: str) -> int:
    """At least how many calendar months the date column touches (2 means two or more)."""
    col = profile.column(name)
    if not col["min_date"]:
        return 0
    return 1 if col["min_date"][:7] == col["max_date"][:7] else 2


CHART_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("dataset_id", "chart_type", "x_column", "y_column", "aggregation", "title", "x_value")
    ]
    + [T.StructField("y_value", T.DoubleType()), T.StructField("chart_no", T.IntegerType())]
)


def _no_charts(df: DataFrame) -> DataFrame:
    return small_frame(df.sparkSession, [], CHART_SCHEMA)


# --- charts of several tables -----------------------------------------------------------


def cross_table_charts(
    tables: dict[str, DataFrame],
    profiles: dict[str, TableProfile],
    root: str | None = None,
    lineage: DataFrame | None = None,
    max_joins: int = MAX_AUTO_JOINS,
) -> list[DataFrame]:
    """Charts of inner joins over the best HIGH relationships; pairs whose
    keys both repeat are skipped. Each join is written under `root` (by default
    a new folder of the shared work area) unless the lineage, by default that of
    `root`, already has it; tables derived from each other are not joined."""
    if len(tables) < 2:
        return []
    spark = next(iter(tables.values())).sparkSession
    root = root or work_folder(spark, "joined")
    lineage = read_lineage(spark, root) if lineage is None else lineage
    found = detect_relationships(tables, profile_frame(spark, list(profiles.values())), lineage)
    charts, tried = [], set()
    for row in found.filter("confidence = 'HIGH'").collect():
        pair = frozenset((row["left_table"], row["right_table"]))
        if pair in tried:
            continue
        if len(tried) >= max_joins:
            break
        tried.add(pair)
        left, right = row["left_table"], row["right_table"]
        spec = JoinSpec(row["left_column"], row["right_column"], "inner", left, right)
        try:
            identity = hashlib.sha256(join_identity(left, spec, right).encode()).hexdigest()
            wide, _ = derive_dataset(tables[left], tables[right], spec, root, f"join-{identity[:16]}", "dashboard", lineage)
        except FanOutRefused:
            continue
        charts.append(default_charts(wide, profile_table(wide, f"{left} ⋈ {right}", parts=["span"])))
    return charts


def merge_charts(charts: list[DataFrame]) -> DataFrame:
    """Distinct charts of several sets, trends before comparisons, at
    most four; single figures only fill up to two."""
    marked = [chart.withColumn("set_no", F.lit(i)) for i, chart in enumerate(charts)]
    points = reduce(DataFrame.unionAll, marked)
    shape = ["chart_type", "x_column", "y_column"]
    kinds = F.when(F.col("chart_type").isin(TREND_TYPES), 0).when(F.col("chart_type").isin(COMPARISON_TYPES), 1).otherwise(2)
    # Each chart has one row here; a report has few charts, so one task may rank them.
    heads = points.groupBy(*shape).agg(F.min(F.struct("set_no", "chart_no")).alias("first")).withColumn("kind", kinds)
    rank = F.row_number().over(Window.orderBy("kind", "first.set_no", "first.chart_no"))
    room = F.when(F.col("kind") < 2, MAX_MERGED).otherwise(2)
    kept = heads.withColumn("place", rank).filter(F.col("place") <= room)
    on = [F.col(f"p.{n}").eqNullSafe(F.col(f"h.{n}")) for n in shape]
    on += [F.col("p.set_no") == F.col("h.first.set_no"), F.col("p.chart_no") == F.col("h.first.chart_no")]
    return (
        points.alias("p")
        .join(kept.alias("h"), reduce(lambda a, b: a & b, on))
        .select("h.place", "p.dataset_id", "p.chart_type", "p.x_column", "p.y_column", "p.title", "p.x_value", "p.y_value")
    )


def kpi_dashboard(df: DataFrame, profile: TableProfile) -> DataFrame:
    """The results behind up to six KPIs, one row per point. Groups of all
    KPIs come from one pass over the table."""
    choice = choice_for(df, profile)
    kpis = discover_kpis(df, profile, choice).limit(MAX_DASHBOARD_KPIS).collect()
    wanted, heads, figures = [], [], []
    for kpi in kpis:
        metric, agg, day, dim = kpi["metric_column"], kpi["aggregation"], kpi["date_column"], kpi["dimension_column"]
        head = (kpi["kpi_no"], kpi["name"])
        if day:
            wanted.append(_trend_of(df, profile, day, agg, metric))
            heads.append((*head, "timeseries"))
        elif dim:
            wanted.append(_Wanted(known(df, dim), dim, agg, metric, F.lit(None), value_name(agg, metric), few=1))
            heads.append((*head, "table"))
        else:
            figures.append((*head, "scalar", None, kpi["preview_value"]))
    out = small_frame(df.sparkSession, figures, "kpi_no int, name string, result_type string, x_value string, y_value double")
    if not wanted:
        return out
    points = _points(df, wanted).select(
        _by_chart([h[0] for h in heads], "int").alias("kpi_no"), _by_chart([h[1] for h in heads], "string").alias("name"),
        _by_chart([h[2] for h in heads], "string").alias("result_type"), "x_value", "y_value",
    )
    return points.unionByName(out)
