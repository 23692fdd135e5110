"""Likely key relationships between the tables of a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions.exprs import bare_name, key_stem, names_a_key
from brightledger.operators.profile import compact_value
from brightledger.session import small_frame

KEY_UNIQUENESS = 0.95
MIN_SCORE = 45.0
NULL_PENALTY_PCT = 20.0
# Columns per 64-bit word of a column set.
SET_BITS = 62


def key_candidates(profile_rows: DataFrame) -> DataFrame:
    """Identifiers, and other columns whose name reads like a key."""
    by_name = F.col("inferred_type").isin("numeric", "categorical", "text") & names_a_key(F.col("column_name"))
    ratio = F.coalesce(F.try_divide(F.col("unique_count"), F.col("non_null_count")), F.lit(0.0))
    repeats = (F.col("unique_count") < F.col("non_null_count")) | (F.col("missing_count") > 1)
    return profile_rows.filter((F.col("inferred_type") == "identifier") | by_name).select(
        "dataset_id",
        "position",
        "column_name",
        "inferred_type",
        "unique_count",
        "missing_percentage",
        ratio.alias("uniqueness"),
        repeats.alias("repeats"),
        bare_name(F.col("column_name")).alias("bare"),
        key_stem(F.col("column_name")).alias("stem"),
    )


def value_overlaps(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(a_table, a_column, b_table, b_column, common) for columns sharing values.

    All pairs in one job and without pairing inside a value: each value is
    reduced to the set of columns holding it, as bits, which merge before the
    shuffle; equal sets are counted together, and only the distinct sets are
    spread out into pairs.
    """
    words = [f"w{i}" for i in range((len(columns) - 1) // SET_BITS + 1)]

    def bits(i: int) -> list[Column]:
        return [F.lit(1 << i % SET_BITS if w == i // SET_BITS else 0).cast("bigint").alias(name) for w, name in enumerate(words)]

    parts = []
    for table in dict.fromkeys(t for t, _ in columns):
        df = tables[table]
        cells = [
            F.struct(compact_value(df, name).alias("value"), *bits(i)) for i, (t, name) in enumerate(columns) if t == table
        ]
        parts.append(df.select(F.inline(F.array(*cells))).filter("value IS NOT NULL"))
    cells = reduce(DataFrame.unionAll, parts)
    holders = cells.groupBy("value").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = holders.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    members = F.array_compact(
        F.array(
            *[
                F.when(F.col(words[i // SET_BITS]).bitwiseAND(F.lit(1 << i % SET_BITS)) != 0, F.lit(i))
                for i in range(len(columns))
            ]
        )
    )
    pairs = (
        sets.select("n", members.alias("cols"))
        .select("n", "cols", F.explode("cols").alias("a"))
        .select("n", "a", F.explode("cols").alias("b"))
        .filter("a < b")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("common"))
    )
    names = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(n).alias("n")) for t, n in columns])
    return pairs.select(
        names[F.col("a")]["t"].alias("a_table"),
        names[F.col("a")]["n"].alias("a_column"),
        names[F.col("b")]["t"].alias("b_table"),
        names[F.col("b")]["n"].alias("b_column"),
        "common",
    )


def _compatible(a: Column, b: Column) -> Column:
    keyish = ("identifier", "numeric")
    return (a.isin(*keyish) & b.isin(*keyish)) | ((a == b) & a.isin("categorical", "text"))


def detect_relationships(
    tables: dict[str, DataFrame],
    profile_rows: DataFrame,
    lineage: DataFrame | None = None,
    max_values: int | None = None,
) -> DataFrame:
    """Scored column pairs, best first.

    A pair can only reach the threshold by its name or by common values, so
    pairs come from equi-joins on the two name forms and from the overlaps;
    tables are never paired blindly. `max_values` leaves columns with more
    distinct values out of the overlap, as an optional economy.
    """
    order = {name: i for i, name in enumerate(tables)}
    rank = F.element_at(F.create_map(*[x for n, i in order.items() for x in (F.lit(n), F.lit(i))]), F.col("dataset_id"))
    found = key_candidates(profile_rows).withColumn("table_no", rank)
    kept = [row for row in found.select("table_no", "position", "dataset_id", "column_name", "unique_count").collect()]
    kept.sort(key=lambda row: (row["table_no"], row["position"]))
    counted = [
        (row["dataset_id"], row["column_name"]) for row in kept if max_values is None or row["unique_count"] <= max_values
    ]
    sides = {
        side: found.select(*[F.col(n).alias(f"{side}_{n}") for n in found.columns]) for side in ("a", "b")
    }
    a, b = sides["a"], sides["b"]
    key = ["a_dataset_id", "a_column_name", "b_dataset_id", "b_column_name"]
    same_name = a.join(b, (F.col("a_bare") == F.col("b_bare")) & (F.col("a_table_no") < F.col("b_table_no"))).select(*key)
    same_stem = a.join(
        b, (F.col("a_stem") == F.col("b_stem")) & (F.col("a_stem") != "") & (F.col("a_table_no") < F.col("b_table_no"))
    ).select(*key)
    pairs = same_name.unionAll(same_stem)
    spark = profile_rows.sparkSession
    if counted:
        overlaps = value_overlaps(tables, counted).toDF(*key, "common")
        pairs = pairs.unionAll(overlaps.filter("a_dataset_id <> b_dataset_id").select(*key))
    else:
        overlaps = small_frame(spark, [], ", ".join(f"{k} string" for k in key) + ", common long")
    pairs = pairs.distinct()
    if lineage is not None:
        parents = lineage.select("derived_id", F.explode(F.array("left_id", "right_id")).alias("parent_id"))
        for child, parent in (("a_dataset_id", "b_dataset_id"), ("b_dataset_id", "a_dataset_id")):
            own = (F.col(child) == F.col("derived_id")) & (F.col(parent) == F.col("parent_id"))
            pairs = pairs.join(parents, own, "left_anti")
    joined = (
        pairs.join(a, ["a_dataset_id", "a_column_name"]).join(b, ["b_dataset_id", "b_column_name"]).join(overlaps, key, "left")
    )
    gated = joined.filter(
        _compatible(F.col("a_inferred_type"), F.col("b_inferred_type"))
        & (F.greatest("a_uniqueness", "b_uniqueness") >= KEY_UNIQUENESS)
    )
    return _scored(gated, max_values)


def _scored(pairs: DataFrame, max_values: int | None) -> DataFrame:
    smaller = F.least("a_unique_count", "b_unique_count")
    sampled = smaller > 0
    if max_values is not None:
        sampled = sampled & (F.greatest("a_unique_count", "b_unique_count") <= max_values)
    overlap = F.when(sampled, F.round(F.coalesce("common", F.lit(0)) / smaller * 100, 2))
    same_bare = F.col("a_bare") == F.col("b_bare")
    same_stem = (F.col("a_stem") == F.col("b_stem")) & (F.col("a_stem") != "")
    name_points = F.when(same_bare, 40.0).when(same_stem, 25.0).otherwise(0.0)
    cardinality = (
        F.when(F.col("a_repeats") & F.col("b_repeats"), "many_to_many")
        .when(F.col("a_repeats"), "many_to_one")
        .when(F.col("b_repeats"), "one_to_many")
        .otherwise("one_to_one")
    )
    unique_points = F.when(cardinality == "one_to_one", 20.0).when(cardinality == "many_to_many", 0.0).otherwise(25.0)
    nulls = F.greatest("a_missing_percentage", "b_missing_percentage")
    penalty = F.when(nulls > NULL_PENALTY_PCT, 10.0).otherwise(0.0)
    score = name_points + unique_points + F.coalesce(F.col("overlap") / 100 * 30, F.lit(0.0)) - penalty
    reasons = F.array_compact(
        F.array(
            F.when(same_bare, "same_name").when(same_stem, "same_key_stem"),
            F.concat(F.lit("types:"), "a_inferred_type", F.lit("-"), "b_inferred_type"),
            F.when(F.col("cardinality") == "one_to_one", "both_unique").when(F.col("cardinality") != "many_to_many", "primary_foreign"),
            F.when(F.col("overlap").isNull(), "overlap_unknown").otherwise("overlap_measured"),
            F.when(nulls > NULL_PENALTY_PCT, "many_nulls"),
        )
    )
    return (
        pairs.withColumn("overlap", overlap)
        .withColumn("cardinality", cardinality)
        .withColumn("score", score)
        .filter(F.col("score") >= MIN_SCORE)
        .select(
            F.col("a_dataset_id").alias("left_table"),
            F.col("a_column_name").alias("left_column"),
            F.col("b_dataset_id").alias("right_table"),
            F.col("b_column_name").alias("right_column"),
            F.round("score", 1).alias("confidence_score"),
            F.when(F.col("score") >= 75, "HIGH").when(F.col("score") >= 55, "MEDIUM").otherwise("LOW").alias("confidence"),
            "cardinality",
            F.col("overlap").alias("value_overlap_percentage"),
            F.col("a_unique_count").alias("left_unique"),
            F.col("b_unique_count").alias("right_unique"),
            reasons.alias("reasons"),
        )
        .orderBy(F.col("confidence_score").desc(), "left_table", "left_column", "right_table", "right_column")
    )
