"""Findings computed from the data, one row each."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions.exprs import known, month_label, share_pct, to_number_lenient, to_time
from brightledger.operators.aggregate import grouped, monthly
from brightledger.operators.groupings import cut_table
from brightledger.operators.profile import TableProfile, profile_frame, table_rows
from brightledger.operators.quantiles import exact_quantiles
from brightledger.plans.kpis import Choice, choice_for

CONCENTRATION_PCT = 40.0
MISSING_PCT = 30.0
MAX_MISSING_FINDINGS = 3
DUPLICATE_PCT = 5.0
CHANGE_PCT = 15.0
STALE_DAYS = 30
CATEGORY_SHARE_PCT = 50.0
MIN_VALUES = 10
OUTLIER_SHARE_PCT = 1.0
OUTLIER_COUNT = 10
OUTLIER_SAMPLE = 20

# The order findings are shown in.
CATEGORY_ORDER = ["significant_change", "anomaly", "top_performer", "concentration_risk", "data_quality"]


def _finding(category: Column | str, subject: Column, finding: Column, **values: Column) -> list[Column]:
    category = F.lit(category) if isinstance(category, str) else category
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return [
        category.alias("category"),
        subject.cast("string").alias("subject"),
        finding.alias("finding"),
        F.create_map(*pairs).alias("supporting_values"),
    ]


def top_group(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """The largest group by sum (ties by key), with its share of the total."""
    groups = grouped(df, {"top_group": known(df, dimension)}, "sum", metric)
    sums = groups.agg(F.struct(F.sum("value").alias("total"), F.count(F.lit(1)).alias("groups"))).scalar()
    return (
        groups.orderBy(F.col("value").desc(), F.col("top_group")).limit(1)
        .select(
            F.col("top_group").cast("string").alias("top_group"),
            F.col("value").alias("top_value"),
            sums["total"].alias("total"),
            sums["groups"].alias("group_count"),
        )
        .filter("total <> 0")
        .withColumn("share_pct", share_pct(F.col("top_value"), F.col("total")))
    )


def concentration(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """I1 kept only where one group holds more than 40 %."""
    return top_group(df, dimension, metric).filter(F.col("share_pct") > CONCENTRATION_PCT)


def last_change(df: DataFrame, date_column: str, metric: str, layout: str | None = None) -> DataFrame:
    """T4: the last month against the month before it in the data."""
    months = monthly(df, date_column, "sum", metric, date_layout=layout)
    last_two = months.orderBy(F.col("period").desc()).limit(2)
    return last_two.agg(
        F.min("period").alias("prior_period"),
        F.min_by("value", "period").alias("prior_value"),
        F.max("period").alias("last_period"),
        F.max_by("value", "period").alias("last_value"),
        F.count(F.lit(1)).alias("periods"),
    ).select(
        "prior_period",
        "prior_value",
        "last_period",
        "last_value",
        F.when(
            (F.col("periods") == 2) & (F.col("prior_value") != 0),
            share_pct(F.col("last_value") - F.col("prior_value"), F.col("prior_value")),
        ).alias("pct_change"),
    )


def significant_change(df: DataFrame, date_column: str, metric: str, layout: str | None = None) -> DataFrame:
    """T4 kept only from 15 % on."""
    return last_change(df, date_column, metric, layout).filter(F.abs("pct_change") >= CHANGE_PCT)


def iqr_bounds(df: DataFrame, metric: str) -> DataFrame:
    """One row with one struct: exact quartiles and the 1.5 IQR bounds. As a
    single value it enters other plans as one subquery in one column."""
    x = df.select(to_number_lenient(df, metric).cast("double").alias("x"))
    q = exact_quantiles(x, [], "x", [0.25, 0.75]).select(F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return q.select(F.struct("q1", "q3", iqr.alias("iqr"), low.alias("lower_bound"), high.alias("upper_bound")).alias("bounds"))


def _with_bounds(df: DataFrame, metric: str) -> DataFrame:
    x = df.select(to_number_lenient(df, metric).cast("double").alias("x")).filter("x IS NOT NULL")
    return x.withColumn("b", iqr_bounds(df, metric).scalar())


def iqr_anomalies(df: DataFrame, metric: str) -> DataFrame:
    """I4: outlier counts outside the bounds; empty below ten values, without
    spread or without outliers. The one row of bounds enters as a subquery."""
    x = _with_bounds(df, metric)
    above, below = F.col("x") > F.col("b.upper_bound"), F.col("x") < F.col("b.lower_bound")
    return (
        x.agg(
            F.any_value("b").alias("b"),
            F.count(F.lit(1)).alias("total_considered"),
            F.count_if(above | below).alias("outlier_count"),
            F.count_if(above).alias("high_count"),
            F.count_if(below).alias("low_count"),
            F.sum("x").alias("total_sum"),
            F.coalesce(F.sum(F.when(above | below, F.col("x"))), F.lit(0.0)).alias("outlier_sum"),
        )
        .select(
            *[F.round(F.col(f"b.{n}"), 2).alias(n) for n in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
            "total_considered",
            "outlier_count",
            share_pct(F.col("outlier_count"), F.col("total_considered")).alias("outlier_share_pct"),
            "high_count",
            "low_count",
            share_pct(F.abs("outlier_sum"), F.abs("total_sum"), 1).alias("outlier_contribution_pct"),
        )
        .filter((F.col("total_considered") >= MIN_VALUES) & (F.col("iqr") != 0) & (F.col("outlier_count") > 0))
    )


def outlier_sample(df: DataFrame, metric: str, k: int = OUTLIER_SAMPLE) -> DataFrame:
    """I4: up to 20 outlier values, the most extreme first."""
    x = _with_bounds(df, metric)
    low, high = F.col("b.lower_bound"), F.col("b.upper_bound")
    far = F.greatest(F.col("x") - high, low - F.col("x"))
    return (
        x.filter((F.col("x") > high) | (F.col("x") < low))
        .orderBy(far.desc(), F.col("x"))
        .limit(k)
        .select(F.round("x", 2).alias("outlier_value"))
    )


def anomaly(df: DataFrame, metric: str) -> DataFrame:
    """I4 kept when outliers are at least 1 % or at least ten."""
    found = iqr_anomalies(df, metric)
    material = (F.col("outlier_share_pct") >= OUTLIER_SHARE_PCT) | (F.col("outlier_count") >= OUTLIER_COUNT)
    direction = F.when(F.col("high_count") > F.col("low_count"), "high").when(F.col("low_count") > 0, "low").otherwise("none")
    return found.filter(material).withColumn("direction", direction)


def quality_findings(profile_rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Repeated rows above 5 %, and the first three columns above 30 % missing."""
    pct = F.round(F.try_divide(F.col("duplicate_row_count"), F.col("row_count")) * 100, 2)
    repeats = tables.withColumn("pct", pct).filter(F.col("pct") > DUPLICATE_PCT)
    rows = repeats.select(
        *_finding(
            "data_quality",
            F.col("dataset_id"),
            F.format_string("%d of %d rows repeat an earlier row", "duplicate_row_count", "row_count"),
            duplicate_row_count=F.col("duplicate_row_count"),
            row_count=F.col("row_count"),
            percentage=F.col("pct"),
        )
    )
    gaps = profile_rows.filter(F.col("missing_percentage") > MISSING_PCT).orderBy("position").limit(MAX_MISSING_FINDINGS)
    return rows.unionAll(
        gaps.select(
            *_finding(
                "data_quality",
                F.col("column_name"),
                F.concat(F.lit("no value in "), F.col("missing_percentage"), F.lit(" % of the rows")),
                missing_count=F.col("missing_count"),
                row_count=F.col("row_count"),
                percentage=F.col("missing_percentage"),
            )
        )
    )


def staleness(df: DataFrame, date_column: str, as_of: date, layout: str | None = None) -> DataFrame:
    """Days since the newest record, from 30 days on."""
    newest = df.agg(F.max(to_time(df, date_column, layout)).alias("latest"))
    return (
        newest.select(
            F.date_format("latest", "yyyy-MM-dd").alias("latest_date"),
            F.date_diff(F.lit(as_of), F.col("latest").cast("date")).alias("days_old"),
        )
        .filter(F.col("days_old") >= STALE_DAYS)
    )


def dominant_category(df: DataFrame, dimension: str) -> DataFrame:
    """I8: the most frequent value where it makes up at least half."""
    counts = df.filter(known(df, dimension).isNotNull()).groupBy(known(df, dimension).cast("string").alias("top_value")).agg(
        F.count(F.lit(1)).alias("top_count")
    )
    total = counts.agg(F.sum("top_count")).scalar()
    return (
        counts.orderBy(F.col("top_count").desc(), "top_value").limit(1)
        .select("top_value", "top_count", total.alias("total"))
        .withColumn("share_pct", share_pct(F.col("top_count"), F.col("total")))
        .filter(F.col("share_pct") >= CATEGORY_SHARE_PCT)
    )


def _row(category: str, subject: Column, finding: Column, **values: Column) -> Column:
    return F.struct(*_finding(category, subject, finding, **values))


def _grouped_findings(df: DataFrame, profile: TableProfile, choice: Choice, as_of: date) -> DataFrame:
    """I1, I2, I3, I7 of a report from one pass over the table: the groups of
    the first dimension, the months and the newest time share one shuffle. Months
    and the groups of a dimension are few, so their one row holds the months."""
    metric = choice.best()[0] if choice.metrics else None
    dimension = choice.dimensions[0] if metric and choice.dimensions else None
    day = choice.dates[0] if choice.dates else None
    stamp = to_time(df, day, profile.layout(day)) if day else None
    keys = ([known(df, dimension)] if dimension else []) + ([month_label(stamp)] if day else [])
    cuts = cut_table(df, keys, [("sum", metric)] if metric else [("count", None)], {"latest": stamp} if day else None)
    month = len(keys) - 1
    in_group, in_month = F.col("cut") == 0 if dimension else F.lit(False), F.col("cut") == month if day else F.lit(False)
    facts = cuts.agg(
        F.min(F.when(in_group, F.struct((-F.col("v0")).alias("less"), F.col("k0"), "label"))).alias("first"),
        F.sum(F.when(in_group, F.col("v0"))).alias("total"),
        F.slice(F.sort_array(F.collect_list(F.when(in_month, F.struct(F.col("label").alias("period"), F.col("v0").alias("value")))), asc=False), 1, 2).alias("months"),
        (F.max("latest") if day else F.lit(None).cast("timestamp")).alias("latest"),
    )
    found = []
    if dimension:
        group, value = F.col("first.label"), -F.col("first.less")
        share = share_pct(value, F.col("total"))
        sentence = F.concat(group, F.lit(f" leads {metric} by {dimension} with "), share, F.lit(" %"))
        values = dict(top_value=value, total=F.col("total"), share_pct=share)
        some = F.col("total") != 0
        found += [F.when(some, _row("top_performer", group, sentence, **values)), F.when(some & (share > CONCENTRATION_PCT), _row("concentration_risk", group, sentence, **values))]
    if metric and day:
        last, prior = F.get("months", F.lit(0)), F.get("months", F.lit(1))
        change = F.when(prior["value"] != 0, share_pct(last["value"] - prior["value"], prior["value"]))
        sentence = F.concat(F.lit(f"{metric} changed by "), change, F.lit(" % from "), prior["period"], F.lit(" to "), last["period"])
        values = dict(prior_period=prior["period"], prior_value=prior["value"], last_period=last["period"], last_value=last["value"], pct_change=change)
        found.append(F.when(F.abs(change) >= CHANGE_PCT, _row("significant_change", F.lit(metric), sentence, **values)))
    if day:
        days = F.date_diff(F.lit(as_of), F.col("latest").cast("date"))
        sentence = F.concat(F.lit(f"newest {day} is "), days, F.lit(" days old"))
        values = dict(latest_date=F.date_format("latest", "yyyy-MM-dd"), days_old=days)
        found.append(F.when(days >= STALE_DAYS, _row("data_quality", F.lit(day), sentence, **values)))
    return facts.select(F.inline(F.array_compact(F.array(*found))))


def generate_insights(
    df: DataFrame, profile: TableProfile, as_of: date, choice: Choice | None = None
) -> DataFrame:
    """All findings that hold, in one shape; no rows when none does. Groups,
    months and the newest time are read in one pass, quartiles in passes of
    their own over one column."""
    spark = df.sparkSession
    rows = profile_frame(spark, [profile])
    choice = choice or choice_for(df, profile)
    parts: list[DataFrame] = []
    if choice.dates or (choice.metrics and choice.dimensions):
        parts.append(_grouped_findings(df, profile, choice, as_of))
    if choice.metrics:
        metric = choice.best()[0]
        odd = anomaly(df, metric)
        sentence = F.concat(
            F.col("outlier_count"), F.lit(" of "), F.col("total_considered"), F.lit(f" {metric} values lie outside "),
            F.col("lower_bound"), F.lit(" to "), F.col("upper_bound"),
        )
        names = ("lower_bound", "upper_bound", "outlier_count", "outlier_share_pct", "outlier_contribution_pct", "total_considered", "direction")
        parts.append(odd.select(*_finding("anomaly", F.lit(metric), sentence, **{n: F.col(n) for n in names})))
    parts.append(quality_findings(rows, table_rows(spark, [profile])))
    if not choice.metrics and choice.dimensions:
        dimension = choice.dimensions[0]
        main = dominant_category(df, dimension)
        sentence = F.concat(F.col("share_pct"), F.lit(f" % of the rows share {dimension} "), F.col("top_value"))
        names = ("top_count", "total", "share_pct")
        parts.append(main.select(*_finding("concentration_risk", F.lit(dimension), sentence, **{n: F.col(n) for n in names})))
    return reduce(DataFrame.unionAll, parts).withColumn("dataset_id", F.lit(profile.dataset_id))


def order_findings(findings: DataFrame) -> DataFrame:
    """Business signals before quality notes."""
    rank = F.when(F.col("category") == CATEGORY_ORDER[0], 0)
    for i, name in enumerate(CATEGORY_ORDER[1:], start=1):
        rank = rank.when(F.col("category") == name, i)
    return findings.withColumn("priority", rank.otherwise(len(CATEGORY_ORDER) - 1)).orderBy("priority", "category", "subject")
