"""Column and table profiles.

A table is profiled with a fixed number of jobs whatever its width: one
aggregate for counts and moments, one for all distinct counts together, then
medians and top values only for the columns whose type asks for them. What
reaches the driver is one row per column.
"""

from __future__ import annotations

from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import (
    DATE_LAYOUTS,
    as_text,
    c,
    ends_like_key,
    is_number,
    is_time,
    known,
    names_a_key,
    parse_layout,
    text_to_number,
    to_number_lenient,
    to_time,
    type_of,
)
from brightledger.operators.quantiles import exact_quantiles
from brightledger.session import small_frame

HIGH_MISSING_PCT = 50.0
HIGH_CARDINALITY_RATIO = 0.9
HIGH_CARDINALITY_ROWS = 20
DATE_FLOOR = 0.05
PARSE_RATE = 0.9
TOP_VALUES = 5
# What a profile can hold beyond types, counts and distinct counts.
PARTS = ("stats", "top", "span", "dup")
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("inferred_type", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("non_null_count", T.LongType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("missing_percentage", T.DoubleType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("mean_value", T.DoubleType()),
        T.StructField("median_value", T.DoubleType()),
        T.StructField("std_value", T.DoubleType()),
        T.StructField("cardinality", T.LongType()),
        T.StructField(
            "top_values",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("value", T.StringType()),
                        T.StructField("count", T.LongType()),
                        T.StructField("percentage", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("min_date", T.StringType()),
        T.StructField("max_date", T.StringType()),
        T.StructField("date_coverage_days", T.IntegerType()),
        T.StructField("date_layout", T.StringType()),
    ]
)


@dataclass
class TableProfile:
    """What the driver keeps of a table: one dict per column, plus quality."""

    dataset_id: str
    row_count: int
    columns: list[dict[str, Any]]
    duplicate_row_count: int | None
    duplicate_headers: list[str] = field(default_factory=list)

    def of_type(self, inferred_type: str) -> list[str]:
        return [col["column_name"] for col in self.columns if col["inferred_type"] == inferred_type]

    def column(self, name: str) -> dict[str, Any]:
        return next(col for col in self.columns if col["column_name"] == name)

    def flagged(self, flag: str) -> list[str]:
        return [col["column_name"] for col in self.columns if flag in col["quality_flags"]]

    def layout(self, name: str) -> str | None:
        return self.column(name)["date_layout"]


# --- measures over one table ------------------------------------------------


def counts(df: DataFrame) -> DataFrame:
    """P1 without distincts: column_name, row_count, non_null, missing, missing %."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(known(df, f.name)).alias(f"c{i}") for i, f in enumerate(df.schema)])
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.col(f"c{i}").alias("non_null_count"))
                for i, f in enumerate(df.schema)
            ]
        )
    )
    return wide.select("n", rows.alias("r")).select(
        "r.position",
        "r.column_name",
        F.col("n").alias("row_count"),
        "r.non_null_count",
        (F.col("n") - F.col("r.non_null_count")).alias("missing_count"),
        F.coalesce(F.round(F.try_divide(F.col("n") - F.col("r.non_null_count"), F.col("n")) * 100, 2), F.lit(0.0)).alias(
            "missing_percentage"
        ),
    )


def compact_value(df: DataFrame, name: str) -> Column:
    """A short text standing for the value: texts and nested values by their
    SHA-256, so distinct counts never shuffle whole texts."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (known(df, name) + F.lit(0.0).cast(dtype)).cast("string")
    text = as_text(df, name)
    if isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        return F.sha2(text, 256)
    return text


def unique_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Exact distinct counts, one shuffle of distinct cells per type of column.

    Columns of one type go through a single grouping; numbers and times are
    compared as they are, only the rest as text.
    """
    classes: dict[str, list[str]] = {}
    for name in names or df.columns:
        dtype = type_of(df, name)
        if isinstance(dtype, T.IntegralType):
            kind = "bigint"
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            kind = "double"
        else:
            kind = dtype.simpleString() if is_time(dtype) else "string"
        classes.setdefault(kind, []).append(name)
    parts = []
    for kind, members in classes.items():
        value = compact_value if kind == "string" else known
        cells = df.select(*[value(df, n).cast(kind).alias(n) for n in members])
        long = cells.unpivot([], [c(n) for n in members], "column_name", "value").filter("value IS NOT NULL")
        seen = long.groupBy("column_name", "value").agg(F.lit(1).alias("_one"))
        parts.append(seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count")))
    return reduce(DataFrame.unionAll, parts)


def profile_counts(df: DataFrame) -> DataFrame:
    """Counts and distincts, one row per column."""
    return (
        counts(df)
        .join(unique_counts(df), "column_name", "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
        .orderBy("position")
    )


def numeric_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """P5: min, max, mean, median and sample deviation per numeric column."""
    moments = df.agg(
        *[
            F.struct(
                F.lit(n).alias("column_name"),
                F.min(to_number_lenient(df, n).cast("double")).alias("min_value"),
                F.max(to_number_lenient(df, n).cast("double")).alias("max_value"),
                F.round(F.avg(to_number_lenient(df, n).cast("double")), 4).alias("mean_value"),
                F.coalesce(F.round(F.stddev_samp(to_number_lenient(df, n).cast("double")), 4), F.lit(0.0)).alias("std_value"),
            ).alias(f"s{i}")
            for i, n in enumerate(names)
        ]
    ).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))
    moments = moments.filter("min_value IS NOT NULL")
    cells = df.select(*[to_number_lenient(df, n).cast("double").alias(n) for n in names])
    long = cells.unpivot([], [c(n) for n in names], "column_name", "x")
    medians = exact_quantiles(long, ["column_name"], "x", [0.5], few_groups=True).select(
        "column_name", F.col("quantiles")[0].alias("median_value")
    )
    return moments.join(medians, "column_name")


def top_values(df: DataFrame, names: list[str], k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values per column, ties by value.

    Counting merges before the shuffle and the rank limit is applied on both
    sides of it, so a column never lands in one task whole.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), as_text(df, n).alias("value")) for n in names])
    freq = (
        df.select(F.inline(cells))
        .filter("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = df.agg(*[F.count(known(df, n)).alias(f"c{i}") for i, n in enumerate(names)]).select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("total")) for i, n in enumerate(names)])
        )
    )
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value")))
    return (
        freq.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .join(totals, "column_name")
        .select(
            "column_name",
            "rank",
            "value",
            "count",
            F.round(F.col("count") / F.col("total") * 100, 2).alias("percentage"),
        )
    )


def date_ranges(df: DataFrame, layouts: dict[str, str | None]) -> DataFrame:
    """First, last and whole elapsed days per date column."""
    spans = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.min(to_time(df, n, layout)).alias("first"),
            F.max(to_time(df, n, layout)).alias("last"),
        ).alias(f"d{i}")
        for i, (n, layout) in enumerate(layouts.items())
    ]
    wide = df.agg(*spans).select(F.inline(F.array(*[F.col(f"d{i}") for i in range(len(spans))])))
    elapsed = F.timestamp_diff("DAY", F.col("first"), F.col("last")).cast("int")
    return wide.filter("first IS NOT NULL").select(
        "column_name",
        F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss").alias("min_date"),
        F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss").alias("max_date"),
        elapsed.alias("date_coverage_days"),
    )


def row_print(df: DataFrame) -> Column:
    """SHA-256 of a row; lengths keep neighbouring values apart."""
    parts = []
    for f in df.schema:
        text = compact_value(df, f.name)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, and their share.

    Copies merge before the shuffle, and of each row only a SHA-256 is shuffled.
    """
    keys = [F.unhex(row_print(df)).alias("k0")]
    prints = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return prints.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"),
    ).withColumn(
        "duplicate_row_percentage",
        F.coalesce(F.round(F.try_divide(F.col("duplicate_row_count"), F.col("row_count")) * 100, 2), F.lit(0.0)),
    )


# --- types --------------------------------------------------------------------


def layout_hits(df: DataFrame, names: list[str]) -> list[Column]:
    """Aggregates counting, per text column and layout, the values of all
    rows that parse; only values with a digit are tried."""
    hits = []
    for i, name in enumerate(names):
        text = F.when(c(name).rlike("[0-9]"), c(name))
        hits += [F.count(parse_layout(text, layout)).alias(f"h{i}_{k}") for k, layout in enumerate(DATE_LAYOUTS)]
    return hits


def best_layouts(row: Row, names: list[str], filled: dict[str, int]) -> dict[str, tuple[str, int]]:
    """Per column the layout most values parse with (the first among equals) and
    how many do, if at least 5 % of its values."""
    found = {}
    for i, name in enumerate(names):
        best = max(range(len(DATE_LAYOUTS)), key=lambda k: (row[f"h{i}_{k}"], -k))
        if filled[name] and row[f"h{i}_{best}"] >= DATE_FLOOR * filled[name]:
            found[name] = (DATE_LAYOUTS[best], row[f"h{i}_{best}"])
    return found


def date_layouts(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The layouts of text columns, from all their values in one aggregate."""
    if not names:
        return {}
    row = df.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(names)], *layout_hits(df, names)).first()
    best = best_layouts(row, names, {n: row[f"n{i}"] for i, n in enumerate(names)})
    return {name: layout for name, (layout, _) in best.items()}


def semantic_types(facts: DataFrame, strict: bool = False) -> DataFrame:
    """The semantic type per column, decided from its facts.

    facts: column_name, kind (bool, number, time, text), row_count,
    non_null_count, unique_count, number_rate, date_rate.
    """
    name = F.col("column_name")
    ratio = F.try_divide(F.col("unique_count"), F.col("non_null_count"))
    some = F.col("non_null_count") > 5
    strong, weak = ends_like_key(name, strict), names_a_key(name)
    number = F.when(strong | (weak & (ratio > 0.95) & some), "identifier").otherwise("numeric")
    text = (
        F.when(F.col("number_rate") >= PARSE_RATE, number)
        .when(F.col("date_rate") >= PARSE_RATE, "date")
        .when(strong | (weak & (ratio > 0.9) & some), "identifier")
        .when((ratio > 0.9) & (F.col("non_null_count") > 20), "text")
        .otherwise("categorical")
    )
    decided = (
        F.when(F.col("non_null_count") == 0, "unknown")
        .when(F.col("kind") == "bool", "boolean")
        .when(F.col("kind") == "number", number)
        .when(F.col("kind") == "time", "date")
        .otherwise(text)
    )
    stored_as_text = (F.col("kind") == "text") & (F.col("non_null_count") > 0) & (F.col("number_rate") >= PARSE_RATE)
    return facts.withColumn("inferred_type", decided).withColumn("numeric_stored_as_text", F.coalesce(stored_as_text, F.lit(False)))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if is_number(dtype):
        return "number"
    return "time" if is_time(dtype) else "text"


def type_facts(df: DataFrame) -> DataFrame:
    """The facts P2 decides on, in two jobs at any width: one aggregate for
    counts, number hits and layout hits, one for distinct counts."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    filled = [F.count(known(df, f.name)).alias(f"c{i}") for i, f in enumerate(df.schema)]
    numbers = [F.count(text_to_number(c(n))).alias(f"x{i}") for i, n in enumerate(texts)]
    with ThreadPoolExecutor(2) as pool:
        hits = layout_hits(df, texts)
        first = pool.submit(lambda: df.agg(F.count(F.lit(1)).alias("n"), *filled, *numbers, *hits).first())
        distinct = pool.submit(lambda: dict(map(tuple, unique_counts(df).collect())))
        row, uniques = first.result(), distinct.result()
    non_null = {f.name: row[f"c{i}"] for i, f in enumerate(df.schema)}
    number_rate = {n: row[f"x{i}"] / non_null[n] if non_null[n] else 0.0 for i, n in enumerate(texts)}
    best = {n: found for n, found in best_layouts(row, texts, non_null).items() if number_rate[n] < PARSE_RATE}
    layouts = {n: layout for n, (layout, _) in best.items()}
    date_rate = {n: parsed / non_null[n] for n, (_, parsed) in best.items()}
    rows = [
        (
            i,
            f.name,
            kind_of(f.dataType),
            row["n"],
            non_null[f.name],
            row["n"] - non_null[f.name],
            round((row["n"] - non_null[f.name]) / row["n"] * 100, 2) if row["n"] else 0.0,
            uniques.get(f.name, 0),
            number_rate.get(f.name, 0.0),
            date_rate.get(f.name, 0.0),
            layouts.get(f.name),
        )
        for i, f in enumerate(df.schema)
    ]
    return small_frame(
        df.sparkSession,
        rows,
        "position int, column_name string, kind string, row_count long, non_null_count long, missing_count long,"
        " missing_percentage double, unique_count long, number_rate double, date_rate double, date_layout string",
    ).coalesce(1)


def infer_types(df: DataFrame, strict: bool = False) -> DataFrame:
    """P2 over one table: column_name, inferred_type, numeric_stored_as_text, …"""
    return semantic_types(type_facts(df), strict).orderBy("position")


# --- the whole profile ---------------------------------------------------------


def profile_table(
    df: DataFrame,
    dataset_id: str,
    duplicate_headers: list[str] | None = None,
    strict: bool = False,
    parts: Collection[str] = PARTS,
) -> TableProfile:
    """P1-P9 for one table, brought to the driver as one dict per column.

    `parts` names what is computed beyond types and counts: numeric figures,
    top values, date spans, repeated rows. What is left out stays None (the
    number of repeated rows too), and its passes over the table are saved.
    """
    facts = [row.asDict() for row in infer_types(df, strict).collect()]
    rows = facts[0]["row_count"] if facts else 0
    by_name = {row["column_name"]: row for row in facts}
    numeric = [n for n, row in by_name.items() if row["inferred_type"] == "numeric"]
    categorical = [n for n, row in by_name.items() if row["inferred_type"] == "categorical"]
    dates = {n: row["date_layout"] for n, row in by_name.items() if row["inferred_type"] == "date"}
    # A complete column without repeats proves that no row repeats.
    keyed = any(row["unique_count"] == rows for row in facts)
    measures = {
        "stats": lambda: numeric_stats(df, numeric).collect() if numeric else [],
        "top": lambda: top_values(df, categorical).collect() if categorical else [],
        "span": lambda: date_ranges(df, dates).collect() if dates else [],
        "dup": lambda: 0 if keyed or not rows else duplicate_rows(df).first()["duplicate_row_count"],
    }
    with ThreadPoolExecutor(len(PARTS)) as pool:
        jobs = {name: pool.submit(measures[name]) for name in PARTS if name in parts}
        done = {name: job.result() for name, job in jobs.items()}
    stats = {row["column_name"]: row.asDict() for row in done.get("stats", [])}
    spans = {row["column_name"]: row.asDict() for row in done.get("span", [])}
    tops: dict[str, list] | None = {} if "top" in parts else None
    for row in sorted(done.get("top", []), key=lambda r: (r["column_name"], r["rank"])):
        tops.setdefault(row["column_name"], []).append({k: row[k] for k in ("value", "count", "percentage")})
    columns = [column_profile(dataset_id, row, stats, spans, tops) for row in facts]
    return TableProfile(dataset_id, rows, columns, done.get("dup"), duplicate_headers or [])


def column_profile(dataset_id: str, row: dict, stats: dict, spans: dict, tops: dict | None) -> dict[str, Any]:
    name, kind = row["column_name"], row["inferred_type"]
    flags = []
    if row["numeric_stored_as_text"]:
        flags.append("numeric_stored_as_text")
    if row["missing_percentage"] > HIGH_MISSING_PCT:
        flags.append("high_missing")
    ratio = row["unique_count"] / max(row["non_null_count"], 1)
    if kind == "categorical" and ratio > HIGH_CARDINALITY_RATIO and row["row_count"] > HIGH_CARDINALITY_ROWS:
        flags.append("high_cardinality")
    numbers, span = stats.get(name, {}), spans.get(name, {})
    column = {f.name: None for f in PROFILE_SCHEMA}
    column.update({k: row[k] for k in ("column_name", "position", "inferred_type", "row_count", "non_null_count")})
    column.update({k: row[k] for k in ("missing_count", "missing_percentage", "unique_count")})
    column.update({k: numbers.get(k) for k in ("min_value", "max_value", "mean_value", "median_value", "std_value")})
    column.update({k: span.get(k) for k in ("min_date", "max_date", "date_coverage_days")})
    column.update(
        dataset_id=dataset_id,
        quality_flags=flags,
        cardinality=row["unique_count"] if kind == "categorical" else None,
        top_values=tops.get(name, []) if kind == "categorical" and tops is not None else None,
        date_layout=row["date_layout"] if kind == "date" else None,
    )
    return column


def profile_frame(spark: SparkSession, profiles: list[TableProfile]) -> DataFrame:
    """Profile rows of any number of tables, for the catalog operators."""
    rows = [tuple(col[f.name] for f in PROFILE_SCHEMA) for profile in profiles for col in profile.columns]
    return small_frame(spark, rows, PROFILE_SCHEMA).coalesce(1)


def quality_flags(profile_rows: DataFrame) -> DataFrame:
    """P9 as columns over profile rows (inferred type and counts given)."""
    ratio = F.col("unique_count") / F.greatest(F.col("non_null_count"), F.lit(1))
    return profile_rows.withColumn(
        "quality_flags",
        F.array_compact(
            F.array(
                F.when(F.col("numeric_stored_as_text"), "numeric_stored_as_text"),
                F.when(F.col("missing_percentage") > HIGH_MISSING_PCT, "high_missing"),
                F.when(
                    (F.col("inferred_type") == "categorical")
                    & (ratio > HIGH_CARDINALITY_RATIO)
                    & (F.col("row_count") > HIGH_CARDINALITY_ROWS),
                    "high_cardinality",
                ),
            )
        ),
    )


def quality_summary(profile_rows: DataFrame, tables: DataFrame) -> DataFrame:
    """P10: score, rating and notes per dataset.

    tables: dataset_id, row_count, duplicate_row_count, duplicate_headers.
    """

    def flagged(flag: str) -> Column:
        names = F.collect_list(
            F.when(F.array_contains("quality_flags", flag), F.struct(F.col("position"), F.col("column_name")))
        )
        return F.transform(F.array_sort(names), lambda s: s["column_name"])

    flags = profile_rows.groupBy("dataset_id").agg(
        flagged("high_missing").alias("mostly_missing"),
        flagged("numeric_stored_as_text").alias("text_numbers"),
        flagged("high_cardinality").alias("high_cardinality"),
    )
    joined = tables.join(flags, "dataset_id").withColumn(
        "duplicate_row_percentage",
        F.coalesce(F.round(F.try_divide(F.col("duplicate_row_count"), F.col("row_count")) * 100, 2), F.lit(0.0)),
    )
    score = (
        F.lit(100.0)
        - F.least(F.col("duplicate_row_percentage"), F.lit(30.0))
        - 15 * F.size("mostly_missing")
        - 5 * F.size("text_numbers")
        - 5 * F.size("duplicate_headers")
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("duplicate_row_count") > 0, F.format_string("%d repeated rows", "duplicate_row_count")),
            F.when(F.size("mostly_missing") > 0, F.concat(F.lit("mostly missing: "), F.array_join("mostly_missing", ", "))),
            F.when(F.size("text_numbers") > 0, F.concat(F.lit("numbers kept as text: "), F.array_join("text_numbers", ", "))),
            F.when(F.size("duplicate_headers") > 0, F.concat(F.lit("renamed headers: "), F.array_join("duplicate_headers", ", "))),
            F.when(F.size("high_cardinality") > 0, F.concat(F.lit("very many categories: "), F.array_join("high_cardinality", ", "))),
        )
    )
    return joined.select(
        "dataset_id",
        "row_count",
        "duplicate_row_count",
        "duplicate_row_percentage",
        F.round(score, 2).alias("score"),
        F.when(score >= 85, "good").when(score >= 60, "fair").otherwise("poor").alias("rating"),
        notes.alias("notes"),
    )


def table_rows(spark: SparkSession, profiles: list[TableProfile]) -> DataFrame:
    rows = [(p.dataset_id, p.row_count, p.duplicate_row_count, p.duplicate_headers) for p in profiles]
    return small_frame(
        spark, rows, "dataset_id string, row_count long, duplicate_row_count long, duplicate_headers array<string>"
    )


def typed_columns(profile_rows: DataFrame) -> DataFrame:
    """Column lists by type, in column order."""

    def named(kind: str) -> Column:
        picked = F.collect_list(F.when(F.col("inferred_type") == kind, F.struct("position", "column_name")))
        return F.transform(F.array_sort(picked), lambda s: s["column_name"])

    kinds = ("numeric", "categorical", "date", "identifier", "text")
    return profile_rows.groupBy("dataset_id").agg(*[named(k).alias(f"{k}_columns") for k in kinds])


def batch_reprofile(
    tables: dict[str, DataFrame], parallel: int = 4, parts: Collection[str] = PARTS
) -> list[TableProfile]:
    """IO8: profiles of many tables; their jobs share the cluster."""
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(lambda item: profile_table(item[1], item[0], parts=parts), tables.items()))
