"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of copies to expect: the
source's target over its size. Expected copies are summed up along the source's
documents, one random offset is added, and a document is emitted once for each
whole number its part of the sum crosses. Documents stand in order of their
size, so the words taken follow the target as closely as the copies do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.llm.ranks import nulls_last, ranked
from brightledger.llm.tables import settled, whole_row

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Sums of expected copies are kept in units of 2 ** -BITS, without rounding.
BITS = 30
_ONE = 1 << BITS


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source_size, target) of sources given as (key, source_size).

    Weights repeat over the sources in order of their keys. Targets are in
    proportion to weights and sum up to `share` of all sizes; none is above
    `most` times its source's size, and what is cut off is shared again by
    weight among the others until none is above. A round is one sum over the
    sources; the driver keeps the level that all share.
    """
    if not 0 <= share <= most or min(weights) <= 0:
        raise ValueError("share must be between 0 and most, weights above 0")
    placed = ranked(totals.withColumn("_all", F.lit(0)), "_all", ["key"], "sources").drop("_all")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = settled(placed.select("key", "source_size", weight.alias("weight")), "weighted")
    size, level, full = F.col("source_size"), 0.0, -1
    whole = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        # A source that is full at one level is full at all higher ones.
        capped = level * F.col("weight") > most * size
        row = sources.agg(F.sum(F.when(capped, 1).otherwise(0)).alias("full"), F.sum(F.when(capped, size).otherwise(0)).alias("given"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open")).first()
        if row["full"] in (None, full) or not row["open"]:
            break
        full, level = row["full"], (whole - most * row["given"]) / row["open"]
    return sources.select("key", "source_size", F.least(most * size.cast("double"), level * F.col("weight")).alias("target"))


def _offset(key: Column, seed: int) -> Column:
    """A source's random offset in units of 2 ** -BITS."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % _ONE


def mix_copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, source, size (words `[^\\x20\\x09-\\x0D]+`, null text: 0), source_size,
    target, copies and taken (copies times size) of every row; with `carry` the
    input row as the struct `row`.

    Order, offset and sums depend on the rows and the seed alone, so runs agree.
    Documents of one source stand by size, then id; rows equal in both are
    interchangeable. Sources ascend by code points, null last; a source without
    words takes no copies. No document has more than `most` copies. An empty
    table gives no rows. A hot source is dealt over tasks by size and id.
    """
    size = F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    columns = [nulls_last(F.col(source_column)).alias("key"), F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size.alias("size")]
    sized = settled(docs.select(*columns, *([whole_row(docs)] if carry else [])), "sizes")
    targets = settled(source_targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    copies = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    parts = targets.select("key", "source_size", "target", F.floor(copies).alias("whole"), F.floor((copies - F.floor(copies)) * _ONE + 0.5).alias("part"), _offset(F.col("key"), seed).alias("offset"))
    placed = ranked(sized, "key", ["size", "doc_id"], "size-order").join(parts, "key")
    # The fraction of the sum before the document; a whole number is crossed
    # where its part reaches over the next one.
    reached = (F.col("offset") + F.col("place") % _ONE * F.col("part")) % _ONE
    crossed = F.col("whole") + F.when(reached + F.col("part") >= _ONE, 1).otherwise(0)
    placed = placed.withColumn("copies", crossed.cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each input row as often as `mix_copies` says."""
    return mix_copies(docs, carry=True, **options).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
