"""Exact quantiles (linear interpolation) that hold for any group size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import c
from brightledger.session import small_frame

_WANT = "array<struct<slot:int,spot:double,rank:bigint>>"

# Equal-width parts into which a wanted band's own range is cut again.
PARTS = 4096
# A range of values is sorted once it holds no more rows than this.
SORTED_ROWS = 1 << 20


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: list[float], few_groups: bool = False, times: str | None = None
) -> DataFrame:
    """keys + `quantiles ARRAY<DOUBLE>`; null values are left out. A row counts
    as often as its column `times` says, if one is given.

    No group's values meet in one task. Values are counted by bands of a fixed
    relative width, and only bands that hold a wanted rank are looked at again.
    Set `few_groups` where the number of groups is bounded, such as one per
    column (without keys there is one): a few ranges of values for each group and
    probability then pass through the driver, which reads the table again for
    what lies in them, and nothing else is shuffled. With any number of groups
    equal values are counted first, and bands and values meet in a join.
    """
    group = [c(k) for k in keys]
    names = [*keys, "_band"]
    often = c(times).cast("bigint") if times else F.lit(1).cast("bigint")
    data = df.select(*group, c(value).cast("double").alias("_x"), often.alias("_n")).filter("_x IS NOT NULL")
    if few_groups or not keys:
        return _from_ranges(data, keys, probabilities)
    rows = data.groupBy(*group, "_x").agg(F.sum("_n").alias("_n")).withColumn("_band", value_band(F.col("_x")))
    rows = _wanted(rows, _band_ranks(rows, keys, probabilities), names)
    width = F.col("_top") - F.col("_least")
    part = F.when(width > 0, F.floor((F.col("_x") - F.col("_least")) / width * (PARTS - 1))).otherwise(0).cast("bigint")
    rows = rows.withColumn("_part", part)
    parts = _totals(rows, [*names, "_part"]).withColumnRenamed("_want", "_all")
    rows = _wanted(rows.drop("_want", "_least", "_top"), parts, [*names, "_part"])
    return _between(rows, keys, [*names, "_part"], probabilities)


def _band_ranks(rows: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """The bands of rows (keys, _x, _n, _band), each with all ranks its group wants."""
    total = F.sum("_rows").over(Window.partitionBy(*[c(k) for k in keys]))
    spots = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), spot.alias("spot"), rank.cast("bigint").alias("rank"))
            for i, p in enumerate(probabilities)
            for spot in [F.lit(float(p)) * (total - 1)]
            for rank in (F.floor(spot), F.ceil(spot))
        ]
    )
    return _totals(rows, [*keys, "_band"]).withColumn("_all", spots)


def _between(rows: DataFrame, keys: list[str], parts: list[str], probabilities: list[float]) -> DataFrame:
    """The quantiles from the rows (_x, _n, _want) of parts that hold a wanted rank."""
    in_part = Window.partitionBy(*[c(n) for n in parts]).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum("_n").over(in_part)
    held = rows.withColumn("_last", last).withColumn("_w", F.explode("_want"))
    held = held.filter((F.col("_w.rank") < F.col("_last")) & (F.col("_w.rank") >= F.col("_last") - F.col("_n")))
    of = lambda i, column: F.when(F.col("_w.slot") == i, column)
    ends = [F.struct(F.min(of(i, F.col("_x"))).alias("lo"), F.max(of(i, F.col("_x"))).alias("hi"), F.max(of(i, F.col("_w.spot"))).alias("spot")).alias(f"_q{i}") for i in range(len(probabilities))]
    found = held.groupBy(*[c(k) for k in keys]).agg(*ends)
    values = [F.col(f"_q{i}.lo") + (F.col(f"_q{i}.hi") - F.col(f"_q{i}.lo")) * (F.col(f"_q{i}.spot") - F.floor(F.col(f"_q{i}.spot"))) for i in range(len(probabilities))]
    return found.filter(F.col("_q0.lo").isNotNull()).select(*[c(k) for k in keys], F.array(*values).alias("quantiles"))


def _from_ranges(data: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """The quantiles of few groups: ranges of values that hold wanted ranks are
    cut until each is one value or has few enough rows to be sorted."""
    bands = _wanted_parts(_band_ranks(data.withColumn("_band", value_band(F.col("_x"))), keys, probabilities), [*keys, "_band"])
    # Of each range its group, ends, rows and wanted ranks within it.
    ranges = [(tuple(r[k] for k in keys), r["_least"], r["_top"], r["_rows"], [tuple(w) for w in r["_want"]]) for r in bands.collect()]
    while any(rows > SORTED_ROWS and low < high for _, low, high, rows, _ in ranges):
        large = [r for r in ranges if r[3] > SORTED_ROWS and r[1] < r[2]]
        ranges = [r for r in ranges if r not in large]
        marked = _marked(data, keys, large)
        part = F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (PARTS - 1)).cast("bigint")
        cut = marked.groupBy("_at", part.alias("_part")).agg(F.sum("_n"), F.min("_x"), F.max("_x"))
        before: dict[int, int] = {}
        for at, _, rows, low, high in sorted(cut.collect()):
            first = before.get(at, 0)
            before[at] = first + rows
            want = [(slot, spot, rank - first) for slot, spot, rank in large[at][4] if first <= rank < first + rows]
            if want:
                ranges.append((large[at][0], low, high, rows, want))
    counted = _marked(data, keys, ranges).groupBy(*[c(k) for k in keys], "_at", "_x").agg(F.sum("_n").alias("_n"), F.first("_want").alias("_want"))
    return _between(counted, keys, ["_at"], probabilities)


def _marked(data: DataFrame, keys: list[str], ranges: list[tuple]) -> DataFrame:
    """The rows that lie in one of the ranges, with its number, ends and ranks.
    Without keys the ends are literals, which reach the scan."""
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(ranges):
        groups.setdefault(r[0], []).append(i)
    if not groups:
        return data.filter("false").withColumns({"_at": F.lit(0), "_low": F.col("_x"), "_high": F.col("_x"), "_want": F.array().cast(_WANT)})
    width = max(map(len, groups.values()))
    range_type = T.StructType.fromDDL(f"at int, low double, high double, want {_WANT}")
    table = T.StructType([data.schema[k] for k in keys] + [T.StructField(f"_r{i}", range_type) for i in range(width)])
    rows = [(*key, *[(i, *ranges[i][1:3], ranges[i][4]) for i in members], *[None] * (width - len(members))) for key, members in groups.items()]
    if keys:
        # One row for each group, of which there are few.
        names = {k: f"_g{i}" for i, k in enumerate(keys)}
        small = small_frame(data.sparkSession, rows, table)
        small = small.select(*[c(k).alias(n) for k, n in names.items()], *[f"_r{i}" for i in range(width)])
        data = data.join(F.broadcast(small), reduce(lambda a, b: a & b, [c(k).eqNullSafe(F.col(n)) for k, n in names.items()])).drop(*names.values())
        spans = [F.col(f"_r{i}") for i in range(width)]
    else:
        literal = lambda r: F.struct(F.lit(r[0]).alias("at"), F.lit(r[1]).alias("low"), F.lit(r[2]).alias("high"), F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(p).alias("spot"), F.lit(k).cast("bigint").alias("rank")) for s, p, k in r[3]]).alias("want"))
        spans = [literal(r) for r in rows[0]]
        data = data.filter(reduce(lambda a, b: a | b, [F.col("_x").between(r[1], r[2]) for r in rows[0]]))
    here = F.coalesce(*[F.when(F.col("_x").between(s["low"], s["high"]), s) for s in spans])
    marked = data.withColumn("_r", here).filter("_r IS NOT NULL")
    return marked.select(*[c(k) for k in keys], "_x", "_n", F.col("_r.at").alias("_at"), F.col("_r.low").alias("_low"), F.col("_r.high").alias("_high"), F.col("_r.want").alias("_want"))


def value_band(x: Column) -> Column:
    """A band number that never decreases with x: about 0.2 % relative width at
    every magnitude, zero a band of its own."""
    size = F.floor(F.log(F.abs(x)) * 512) + 500_000
    return F.when(x == 0, 0).when(x > 0, size).otherwise(-size).cast("bigint")


def _totals(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows, least and greatest value of each band, the rows up to it within
    what is common to its neighbours, and the ranks wanted there."""
    carried = [F.first("_want").alias("_want")] if "_want" in rows.columns else []
    bands = rows.groupBy(*[c(n) for n in names]).agg(F.sum("_n").alias("_rows"), F.min("_x").alias("_least"), F.max("_x").alias("_top"), *carried)
    upto = Window.partitionBy(*[c(n) for n in names[:-1]]).orderBy(c(names[-1])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bands.withColumn("_end", F.sum("_rows").over(upto))


def _wanted_parts(bands: DataFrame, names: list[str]) -> DataFrame:
    """The bands that hold a wanted rank, with ranks counted from their first row."""
    before = F.col("_end") - F.col("_rows")
    mine = F.filter("_all", lambda s: (s["rank"] >= before) & (s["rank"] < F.col("_end")))
    mine = F.transform(mine, lambda s: F.struct(s["slot"].alias("slot"), s["spot"].alias("spot"), (s["rank"] - before).alias("rank")))
    return bands.select(*[c(n) for n in names], "_least", "_top", "_rows", mine.alias("_want")).filter(F.size("_want") > 0)


def _wanted(rows: DataFrame, bands: DataFrame, names: list[str]) -> DataFrame:
    """The rows of bands that hold a wanted rank."""
    targets = _wanted_parts(bands, names)
    on = [F.col(f"l.{_q(n)}").eqNullSafe(F.col(f"r.{_q(n)}")) for n in names]
    return rows.alias("l").join(targets.alias("r"), reduce(lambda a, b: a & b, on)).select("l.*", "r._want", "r._least", "r._top")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
