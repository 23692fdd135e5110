"""Joins that report what they do before they do it."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightledger.functions.exprs import c, is_number, is_time, known, share_pct, type_of
from brightledger.operators.filters import require_columns
from brightledger.session import small_frame

JOIN_TYPES = ("inner", "left", "right", "full")


class FanOutRefused(ValueError):
    """Both key columns repeat values, so the join would multiply rows."""


@dataclass(frozen=True)
class JoinSpec:
    left_key: str
    right_key: str
    how: str = "inner"
    left_name: str = "left"
    right_name: str = "right"
    allow_fan_out: bool = False
    null_keys: str = "match"  # "match": null equals null; "drop": null matches nothing


def _kind(df: DataFrame, key: str) -> str:
    dtype = type_of(df, key)
    return "number" if is_number(dtype) else "time" if is_time(dtype) else dtype.simpleString()


def _keys(left: DataFrame, right: DataFrame, spec: JoinSpec) -> tuple[Column, Column]:
    """Comparable keys; keys of different kinds are tagged so that none match."""
    require_columns(left, [spec.left_key], spec.left_name)
    require_columns(right, [spec.right_key], spec.right_name)
    lk, rk = known(left, spec.left_key), known(right, spec.right_key)
    kinds = _kind(left, spec.left_key), _kind(right, spec.right_key)
    if kinds[0] == kinds[1]:
        return lk, rk
    return tuple(F.concat(F.lit(kind + ":"), key.cast("string")) for kind, key in zip(kinds, (lk, rk)))


def key_counts(left: DataFrame, right: DataFrame, lk: Column, rk: Column) -> DataFrame:
    """(k, ln, rn): rows per key on both sides, null included, 0 where absent.

    One grouping over both sides: rows merge before the single shuffle, and
    null keys meet in one group.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = left.select(lk.alias("k"), one.alias("ln"), zero.alias("rn")).unionAll(
        right.select(rk.alias("k"), zero.alias("ln"), one.alias("rn"))
    )
    return both.groupBy("k").agg(F.sum("ln").alias("ln"), F.sum("rn").alias("rn"))


def join_stats(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """Everything a join would do, from the key counts alone.

    The joined rows are never built: both sides shrink to one row per key
    first, so a key holding a third of a table is one row here.
    """
    if spec.how not in JOIN_TYPES:
        raise ValueError(f"unknown join type '{spec.how}'")
    both = key_counts(left, right, *_keys(left, right, spec))
    ln, rn = F.col("ln"), F.col("rn")
    real = F.col("k").isNotNull()
    pairs = ln * rn if spec.null_keys == "match" else F.when(real, ln * rn).otherwise(0)
    lonely_left = F.when(pairs == 0, ln).otherwise(0)
    lonely_right = F.when(pairs == 0, rn).otherwise(0)
    sums = both.agg(
        *[
            F.coalesce(F.sum(x), F.lit(0)).alias(name)
            for name, x in {
                "matched_both": pairs,
                "unmatched_left": lonely_left,
                "unmatched_right": lonely_right,
                "rows_before_left": ln,
                "rows_before_right": rn,
                "fan_out": F.when(real, ln * rn),
            }.items()
        ],
        F.coalesce(F.max(ln) > 1, F.lit(False)).alias("l_dup"),
        F.coalesce(F.max(rn) > 1, F.lit(False)).alias("r_dup"),
        F.count_if(real & (ln > 0)).alias("left_keys"),
        F.count_if(real & (rn > 0)).alias("right_keys"),
        F.count_if(real & (ln > 0) & (rn > 0)).alias("common_keys"),
    )
    smaller = F.greatest(F.least("left_keys", "right_keys"), F.lit(1))
    rows_after = F.col("matched_both")
    if spec.how in ("left", "full"):
        rows_after = rows_after + F.col("unmatched_left")
    if spec.how in ("right", "full"):
        rows_after = rows_after + F.col("unmatched_right")
    many = F.col("l_dup") & F.col("r_dup")
    return sums.select(
        "rows_before_left",
        "rows_before_right",
        "matched_both",
        "unmatched_left",
        "unmatched_right",
        rows_after.alias("rows_after"),
        F.when(many, "many_to_many")
        .when(F.col("l_dup"), "many_to_one")
        .when(F.col("r_dup"), "one_to_many")
        .otherwise("one_to_one")
        .alias("cardinality"),
        many.alias("duplicate_key_warning"),
        share_pct(F.col("common_keys"), smaller).alias("key_overlap_percentage"),
        F.when(many, F.col("fan_out")).alias("estimated_fan_out_rows"),
        "left_keys",
        "right_keys",
    )


def preview_join(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """The statistics plus notes; never refuses."""
    kinds = _kind(left, spec.left_key), _kind(right, spec.right_key)
    clash = (
        (F.col("key_overlap_percentage") == 0) & (F.col("left_keys") > 0) & (F.col("right_keys") > 0) & F.lit(kinds[0] != kinds[1])
    )
    return join_stats(left, right, spec).withColumn(
        "notes",
        F.array_compact(
            F.array(
                F.when(clash, F.lit(f"no common keys: {kinds[0]} against {kinds[1]} may be a type mismatch")),
                F.when(F.col("unmatched_left") > 0, F.format_string(f"%d rows of {spec.left_name} unmatched", "unmatched_left")),
                F.when(F.col("unmatched_right") > 0, F.format_string(f"%d rows of {spec.right_name} unmatched", "unmatched_right")),
                F.when(F.col("duplicate_key_warning"), F.lit("both keys repeat: rows multiply")),
            )
        ),
    )


def key_intersection(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys on both sides."""
    return left.select(c(left_key).alias("key")).filter("key IS NOT NULL").intersect(right.select(c(right_key).alias("key")))


def key_difference(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys of the left side the right side lacks."""
    keys = left.select(c(left_key).alias("key")).filter("key IS NOT NULL").distinct()
    return keys.join(right.select(c(right_key).alias("key")).distinct(), "key", "left_anti")


def unmatched_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of the left side without a partner."""
    others = right.select(c(right_key).alias("_k")).distinct()
    return left.join(others, c(left_key).eqNullSafe(F.col("_k")), "left_anti")


def column_suffix(dataset_name: str) -> str:
    """Up to three words of the name's last part, and a checksum that tells
    datasets with the same words apart."""
    words = re.findall("[0-9a-z]+", dataset_name.rpartition("—")[2].lower())[:3]
    return "_".join(["", *words, f"{zlib.crc32(dataset_name.encode()):08x}"])


def safe_join(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """The join, refused first when it would multiply rows.

    No join hint is given: adaptive execution broadcasts a side only when its
    measured size allows it and splits partitions a hot key has filled.
    """
    stats = join_stats(left, right, spec).first()
    if stats["duplicate_key_warning"] and not spec.allow_fan_out:
        raise FanOutRefused(
            f"{spec.left_name}.{spec.left_key} and {spec.right_name}.{spec.right_key} both repeat values: "
            f"{stats['estimated_fan_out_rows']} rows expected from {stats['rows_before_left']} and "
            f"{stats['rows_before_right']} (key overlap {stats['key_overlap_percentage']} %)"
        )
    return joined(left, right, spec)


def joined(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """The join itself, colliding names suffixed, a shared key name kept once."""
    lk, rk = _keys(left, right, spec)
    shared = spec.left_key if spec.left_key == spec.right_key else None
    clashes = (set(left.columns) & set(right.columns)) - {shared}
    ls, rs = column_suffix(spec.left_name), column_suffix(spec.right_name)
    l_names = {n: f"{n}{ls}" if n in clashes else n for n in left.columns}
    r_names = {n: f"{n}{rs}" if n in clashes else n for n in right.columns if n != shared}
    l = left.select(lk.alias("_lk"), *[c(n).alias(f"l.{n}") for n in left.columns])
    r = right.select(rk.alias("_rk"), *[c(n).alias(f"r.{n}") for n in right.columns])
    same = F.col("_lk").eqNullSafe(F.col("_rk")) if spec.null_keys == "match" else F.col("_lk") == F.col("_rk")
    if spec.how == "full":
        # Hot and null keys of a full join meet in one task; those of a left and
        # an anti join are split at run time.
        out = l.join(r, same, "left").unionByName(r.join(l.select("_lk").distinct(), same, "left_anti"), allowMissingColumns=True)
    else:
        out = l.join(r, same, spec.how)
    picked = [
        F.coalesce(c(f"l.{n}"), c(f"r.{n}")).alias(n) if n == shared else c(f"l.{n}").alias(new) for n, new in l_names.items()
    ]
    return out.select(*picked, *[c(f"r.{n}").alias(new) for n, new in r_names.items()])


def joined_counts(left: DataFrame, right: DataFrame, spec: JoinSpec, left_by: list[str] | None = None, right_by: list[str] | None = None) -> DataFrame:
    """How many rows of `joined` have each value of these columns of its
    sides (named as there), as `joined_rows`, without building those rows.

    Each side shrinks to one row for its key and columns; the products of their
    counts add up. A key that both sides repeat costs what its rows cost, not
    what their pairs would.
    """
    lk, rk = _keys(left, right, spec)
    shared = spec.left_key if spec.left_key == spec.right_key else None
    clashes = (set(left.columns) & set(right.columns)) - {shared}
    sides, names = [], []
    for df, key, by, dataset, tag in ((left, lk, left_by or [], spec.left_name, "l"), (right, rk, right_by or [], spec.right_name, "r")):
        require_columns(df, by, dataset)
        new = {n: f"_{tag}v" if n == shared else f"{n}{column_suffix(dataset)}" if n in clashes else n for n in by}
        sides.append(df.groupBy(key.alias(f"_{tag}k"), *[c(n).alias(x) for n, x in new.items()]).agg(F.count(F.lit(1)).alias(f"_{tag}n")))
        names += new.values()
    rows = joined(*sides, JoinSpec("_lk", "_rk", spec.how, spec.left_name, spec.right_name, True, spec.null_keys))
    held = [n for n in ("_lv", "_rv") if n in names]
    groups = [c(n) for n in names if n not in held] + ([F.coalesce(*map(c, held)).alias(shared)] if held else [])
    one = F.lit(1).cast("bigint")
    pairs = F.coalesce("_ln", one) * F.coalesce("_rn", one)
    return rows.groupBy(*groups).agg(F.sum(pairs).alias("joined_rows"))


# --- lineage ------------------------------------------------------------------

LINEAGE_SCHEMA = (
    "derived_id string, left_id string, left_column string, right_id string, right_column string,"
    " join_type string, created_by string"
)


def join_identity(left_id: str, spec: JoinSpec, right_id: str) -> str:
    """The same sources, keys and type name the same derived dataset."""
    return f"join:{left_id}:{spec.left_key}:{right_id}:{spec.right_key}:{spec.how}"


def lineage_row(
    spark: SparkSession, derived_id: str, left_id: str, right_id: str, spec: JoinSpec, created_by: str
) -> DataFrame:
    """How a derived dataset came about."""
    row = (derived_id, left_id, spec.left_key, right_id, spec.right_key, spec.how, created_by)
    return small_frame(spark, [row], LINEAGE_SCHEMA)


def find_existing_join(lineage: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (left_id, left_column, right_id, right_column, join_type)
    with the derived dataset that already answers them, else NULL."""
    keys = ["left_id", "left_column", "right_id", "right_column", "join_type"]
    known_joins = lineage.groupBy(*keys).agg(F.min("derived_id").alias("existing_id"))
    return requests.join(known_joins, keys, "left")
