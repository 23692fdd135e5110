"""IO8: profiles from states of batches, which merge instead of rescanning rows.

A batch leaves three small tables: per column its counts and moments (and, of
texts, how each date layout fits), per column and distinct value how often it
occurs, and per distinct row how often it occurs. States of any number of
batches add up to those of all their rows, so a profile of a table that grows
reads the new rows once and nothing of the old ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import DATE_LAYOUTS, as_text, c, is_time, known, parse_layout, text_to_number, to_number_lenient, to_time
from brightledger.operators.profile import DATE_FLOOR, PARSE_RATE, TOP_VALUES, TableProfile, column_profile, compact_value, kind_of, row_print, semantic_types
from brightledger.operators.quantiles import exact_quantiles
from brightledger.session import small_frame

PARTS = ("columns", "values", "rows")


@dataclass
class States:
    """columns: a row for each column (and batch, before they are merged);
    values: (column_name, value_key, n, value); rows: (row_key, n)."""

    columns: DataFrame
    values: DataFrame
    rows: DataFrame

    def table(self, part: str) -> DataFrame:
        return getattr(self, part)


def _column_state(df: DataFrame, position: int, field: T.StructField) -> Column:
    name, kind = field.name, kind_of(field.dataType)
    if kind == "text" and isinstance(field.dataType, T.StringType):
        number, digits = text_to_number(c(name)), F.when(c(name).rlike("[0-9]"), c(name))
        fits = [_span(parse_layout(digits, layout)) for layout in DATE_LAYOUTS]
    else:
        number = to_number_lenient(df, name).cast("double") if kind != "time" else F.lit(None).cast("double")
        fits = [_span(to_time(df, name))] if is_time(field.dataType) else []
    none = F.array().cast("array<struct<hits:bigint,first:timestamp_ntz,last:timestamp_ntz>>")
    return F.struct(
        F.lit(position).alias("position"), F.lit(name).alias("column_name"), F.lit(kind).alias("kind"), F.lit(field.dataType.simpleString()).alias("type"),
        F.count(F.lit(1)).alias("rows"), F.count(known(df, name)).alias("filled"), F.count(number).alias("numbers"),
        F.avg(number).alias("mean"), (F.var_pop(number) * F.count(number)).alias("squares"), F.min(number).alias("least"), F.max(number).alias("most"),
        (F.array(*fits) if fits else none).alias("fits"),
    )


def _span(stamp: Column) -> Column:
    return F.struct(F.count(stamp).alias("hits"), F.min(stamp).alias("first"), F.max(stamp).alias("last"))


def batch_states(df: DataFrame) -> States:
    """The states of one batch, lazily: one pass for the columns, one for the
    values of all columns together, one for the rows. Equal values and rows
    merge before they are shuffled; of long values a SHA-256 is the key."""
    states = [_column_state(df, i, f).alias(f"s{i}") for i, f in enumerate(df.schema)]
    columns = df.agg(*states).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(states))])))
    # Values are grouped by their text alone: counts then stay in a hash table,
    # where a text carried along would have every cell sorted.
    hashed = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType))]
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), (as_text if n in hashed else compact_value)(df, n).alias("value")) for n in df.columns])
    counts = df.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("column_name").isin(hashed), F.sha2("value", 256)).otherwise(F.col("value"))
    values = counts.select("column_name", key.alias("value_key"), "n", "value")
    rows = df.groupBy(F.unhex(row_print(df)).alias("row_key")).agg(F.count(F.lit(1)).alias("n"))
    return States(columns, values, rows)


def save_states(states: States, root: str, dataset_id: str, batch: str) -> None:
    """Keep a batch's states; the same batch again replaces them."""
    for part in PARTS:
        states.table(part).write.mode("overwrite").parquet(f"{root}/{quote(dataset_id, safe='')}/{part}/batch={quote(batch, safe='')}")


def load_states(spark: SparkSession, root: str, dataset_id: str) -> States:
    """The states of all batches kept of a dataset."""
    return merge_states([States(*[spark.read.parquet(f"{root}/{quote(dataset_id, safe='')}/{part}").drop("batch") for part in PARTS])])


def merge_states(parts: list[States]) -> States:
    """The states of all rows of these batches. Counts add up, means and sums of
    squares by the batches' distances from the common mean."""
    columns, values, rows = (reduce(DataFrame.unionByName, [p.table(part) for p in parts]) for part in PARTS)
    of_column = Window.partitionBy("column_name")
    center = F.try_divide(F.sum(F.col("numbers") * F.col("mean")).over(of_column), F.sum("numbers").over(of_column))
    columns = columns.withColumn("center", center)
    squares = F.col("squares") + F.col("numbers") * F.pow(F.col("mean") - F.col("center"), F.lit(2))
    # Layouts stand in one order in all batches.
    fits = F.collect_list("fits")
    width = F.greatest(F.lit(0), F.array_max(F.transform(fits, F.size)))
    at = lambda field, i: F.transform(F.col("all_fits"), lambda b: F.get(b, i)[field])
    merged = columns.groupBy("position", "column_name", "kind", "type").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.sum("numbers").alias("numbers"), F.any_value("center").alias("mean"),
        F.sum(squares).alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"), fits.alias("all_fits"), width.alias("width"),
    )
    each = F.transform(
        F.slice(F.array(*[F.lit(i) for i in range(len(DATE_LAYOUTS))]), 1, F.col("width")),
        lambda i: F.struct(
            F.aggregate(at("hits", i), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("hits"), F.array_min(at("first", i)).alias("first"), F.array_max(at("last", i)).alias("last")
        ),
    )
    merged = merged.withColumn("fits", each).drop("all_fits", "width")
    # A key has one value, but for states kept when -0.0 could stand for zero.
    value = F.when((F.col("value_key") == "0.0") & (F.col("value") == "-0.0"), F.col("value_key")).otherwise(F.col("value"))
    return States(
        merged,
        values.groupBy("column_name", "value_key", value.alias("value")).agg(F.sum("n").alias("n")).select("column_name", "value_key", "n", "value"),
        rows.groupBy("row_key").agg(F.sum("n").alias("n")),
    )


def profile_states(states: States, dataset_id: str, duplicate_headers: list[str] | None = None, strict: bool = False, k: int = TOP_VALUES) -> TableProfile:
    """P1-P9 of the rows behind merged states, equal to the profile of the rows.
    One dict for each column reaches the driver."""
    unique = states.values.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    rows = [r.asDict(recursive=True) for r in states.columns.join(unique, "column_name", "left").orderBy("position").collect()]
    kinds: dict[str, str] = {}
    for r in rows:
        if kinds.setdefault(r["column_name"], r["type"]) != r["type"]:
            raise ValueError(f"column '{r['column_name']}' is {kinds[r['column_name']]} in one batch and {r['type']} in another")
    spark, layouts, facts = states.columns.sparkSession, {}, []
    for r in rows:
        text = r["kind"] == "text"
        number_rate = r["numbers"] / r["filled"] if text and r["filled"] else 0.0
        best = max(range(len(r["fits"])), key=lambda i: (r["fits"][i]["hits"], -i)) if r["fits"] else None
        hits = r["fits"][best]["hits"] if best is not None else 0
        dated = text and r["filled"] and number_rate < PARSE_RATE and hits and hits >= DATE_FLOOR * r["filled"]
        layouts[r["column_name"]] = (best, DATE_LAYOUTS[best] if dated else None)
        missing = r["rows"] - r["filled"]
        facts.append((
            r["position"], r["column_name"], r["kind"], r["rows"], r["filled"], missing, round(missing / r["rows"] * 100, 2) if r["rows"] else 0.0,
            r["unique_count"] or 0, number_rate, hits / r["filled"] if dated else 0.0, layouts[r["column_name"]][1],
        ))
    typed = semantic_types(small_frame(
        spark, facts,
        "position int, column_name string, kind string, row_count long, non_null_count long, missing_count long,"
        " missing_percentage double, unique_count long, number_rate double, date_rate double, date_layout string",
    ).coalesce(1), strict)
    types = [r.asDict() for r in typed.orderBy("position").collect()]
    stats = _numeric(states, {t["column_name"]: kinds[t["column_name"]] for t in types if t["inferred_type"] == "numeric"})
    spans = {}
    for t, r in zip(types, rows):
        best = layouts[t["column_name"]][0]
        if t["inferred_type"] == "date" and best is not None and r["fits"][best]["first"] is not None:
            first, last = r["fits"][best]["first"], r["fits"][best]["last"]
            spans[t["column_name"]] = {"min_date": f"{first:%Y-%m-%dT%H:%M:%S}", "max_date": f"{last:%Y-%m-%dT%H:%M:%S}", "date_coverage_days": (last - first).days}
    tops = _tops(states.values, [t["column_name"] for t in types if t["inferred_type"] == "categorical"], k)
    repeats = states.rows.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    total = rows[0]["rows"] if rows else 0
    return TableProfile(dataset_id, total, [column_profile(dataset_id, t, stats, spans, tops) for t in types], repeats, duplicate_headers or [])


def _numeric(states: States, types: dict[str, str]) -> dict[str, dict]:
    """P5 of these columns (name to type); a number's text gives the number back."""
    names = list(types)
    if not names:
        return {}
    of = lambda *wanted: F.col("column_name").isin([n for n, t in types.items() if t in wanted])
    number = F.when(of("string"), text_to_number(F.col("value"))).when(of("float"), F.col("value").try_cast("float").cast("double"))
    cells = states.values.filter(F.col("column_name").isin(names)).withColumn("x", number.otherwise(F.col("value").try_cast("double")))
    medians = exact_quantiles(cells, ["column_name"], "x", [0.5], few_groups=True, times="n").select("column_name", F.col("quantiles")[0].alias("median_value"))
    spread = F.coalesce(F.round(F.sqrt(F.try_divide(F.col("squares"), F.col("numbers") - 1)), 4), F.lit(0.0))
    figures = states.columns.filter(F.col("column_name").isin(names) & (F.col("numbers") > 0)).select(
        "column_name", F.col("least").alias("min_value"), F.col("most").alias("max_value"), F.round("mean", 4).alias("mean_value"), spread.alias("std_value")
    )
    return {r["column_name"]: r.asDict() for r in figures.join(medians, "column_name").collect()}


def _tops(values: DataFrame, names: list[str], k: int) -> dict[str, list[dict]]:
    if not names:
        return {}
    mine = values.filter(F.col("column_name").isin(names))
    total = mine.groupBy("column_name").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value")))
    best = mine.withColumn("rank", rank).filter(F.col("rank") <= k).join(total, "column_name")
    tops: dict[str, list[dict]] = {}
    for r in best.orderBy("column_name", "rank").select("column_name", "value", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("share")).collect():
        tops.setdefault(r["column_name"], []).append({"value": r["value"], "count": r["n"], "percentage": r["share"]})
    return tops
