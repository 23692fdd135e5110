"""Joins on overlapping intervals, as equality joins on cells of the line.

An interval has a level, the least power of two that is not shorter, and lies in
two cells of that size at most. Two intervals that overlap share a cell at the
higher of their levels, so each side is posted at its own level and at those of
the other side above it, and both meet by (level, cell).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions.exprs import c, is_time, known, type_of
from brightledger.operators.filters import require_columns
from brightledger.operators.joins import column_suffix

#: Cells of size one reach so far to both sides.
FURTHEST = 2.0**61


@dataclass(frozen=True)
class Span:
    """The columns an interval starts and ends at; a point has one for both.
    Intervals that end before they start, or lack an end, meet nothing."""

    low: str
    high: str | None = None

    def ends(self) -> tuple[str, str]:
        return self.low, self.high or self.low


def _place(df: DataFrame, name: str, unit: float) -> Column:
    """The cell of size one that a value lies in; times count in seconds."""
    if is_time(type_of(df, name)):
        value = F.unix_micros(c(name).cast("timestamp")) / (unit * 1_000_000)
    else:
        value = known(df, name).cast("double") / unit
    # What lies further out shares the last cell; values are compared in any case.
    return F.floor(F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), value))).cast("long")


def _sided(df: DataFrame, span: Span, unit: float, side: str, keys: list[str]) -> DataFrame:
    """The rows as a struct, with exact ends, cells of size one, and the level."""
    low, high = span.ends()
    first, last = _place(df, low, unit), _place(df, high, unit)
    rows = df.select(
        F.struct(*[c(n) for n in df.columns]).alias(side),
        *[c(k).alias(f"{side}_key{i}") for i, k in enumerate(keys)],
        known(df, low).alias(f"{side}_low"), known(df, high).alias(f"{side}_high"), first.alias(f"{side}_first"), last.alias(f"{side}_last"),
    ).filter(F.col(f"{side}_low") <= F.col(f"{side}_high"))
    # Digits of the length in base two; a cell of that size is not shorter.
    length = F.col(f"{side}_last") - F.col(f"{side}_first")
    return rows.withColumn(f"{side}_level", F.when(length == 0, 0).otherwise(F.length(F.bin(length))).cast("int"))


def _cell(place: Column, level: Column) -> Column:
    """The cell of size 2 ** level that a cell of size one lies in."""
    return F.call_function("shiftright", place, level)


def _posted(rows: DataFrame, side: str, levels: Column) -> DataFrame:
    """Each row once for each of these levels and each cell of it, two at most."""
    shift = lambda name: _cell(F.col(f"{side}_{name}"), F.col("level"))
    return rows.withColumn("level", F.explode(levels)).withColumn("cell", F.explode(F.array_distinct(F.array(shift("first"), shift("last")))))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_span: Span,
    right_span: Span,
    keys: list[tuple[str, str]] = (),
    unit: float = 1.0,
    open_end: bool = False,
    left_name: str = "left",
    right_name: str = "right",
) -> DataFrame:
    """Pairs of rows whose intervals overlap, and whose `keys` (left, right
    columns) are equal; every pair once, colliding names suffixed as in J8.

    Intervals hold both ends, with `open_end` not the upper one; a span of one
    column is a point, which has its place either way. `unit` is the size of the finest cells, in seconds for times: near
    the length of most intervals is best, any is right. No side is broadcast by
    a hint and nothing is a nested loop; cells many rows share are partitions
    that adaptive execution splits. A row is posted twice for each level that
    the other side has above its own, 63 at most.
    """
    low, high = left_span.ends()
    require_columns(left, [low, high, *[k for k, _ in keys]], left_name)
    low, high = right_span.ends()
    require_columns(right, [low, high, *[k for _, k in keys]], right_name)
    l = _sided(left, left_span, unit, "l", [k for k, _ in keys])
    r = _sided(right, right_span, unit, "r", [k for _, k in keys])
    # The levels of each side, one small set; those above a row's own are posted.
    of_l, of_r = (F.coalesce(side.agg(F.sort_array(F.collect_set(f"{name}_level"))).scalar(), F.array().cast("array<int>")) for side, name in ((l, "l"), (r, "r")))
    l_posted = _posted(l.withColumn("theirs", of_r), "l", F.array_union(F.array("l_level"), F.filter("theirs", lambda x: x > F.col("l_level")))).drop("theirs")
    r_posted = _posted(r.withColumn("theirs", of_l), "r", F.array_union(F.array("r_level"), F.filter("theirs", lambda x: x > F.col("r_level")))).drop("theirs")
    same = (l_posted["level"] == r_posted["level"]) & (l_posted["cell"] == r_posted["cell"])
    for i in range(len(keys)):
        same = same & (F.col(f"l_key{i}") == F.col(f"r_key{i}"))
    # They meet at the higher level, in the cell where the overlap starts.
    start = _cell(F.greatest("l_first", "r_first"), l_posted["level"])
    once = (l_posted["level"] == F.greatest("l_level", "r_level")) & (l_posted["cell"] == start)
    if open_end:
        # A point is a place; an interval without length is empty then.
        upper = lambda side, span: F.lit(True) if span.high is None else F.col(f"{side}_low") < F.col(f"{side}_high")
        before = lambda a, b, span: (F.col(a) <= F.col(b)) if span.high is None else (F.col(a) < F.col(b))
        exact = before("r_low", "l_high", left_span) & before("l_low", "r_high", right_span) & upper("l", left_span) & upper("r", right_span)
    else:
        exact = (F.col("l_low") <= F.col("r_high")) & (F.col("r_low") <= F.col("l_high"))
    pairs = l_posted.join(r_posted, same & once & exact)
    clashes = set(left.columns) & set(right.columns)
    name = lambda n, of: f"{n}{column_suffix(of)}" if n in clashes else n
    return pairs.select(
        *[F.col("l").getField(n).alias(name(n, left_name)) for n in left.columns],
        *[F.col("r").getField(n).alias(name(n, right_name)) for n in right.columns],
    )
