"""Several groupings of one table in one pass: what charts, KPIs and findings share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.functions.exprs import c
from brightledger.operators.aggregate import measure

#: The `cut` of the figures over all rows.
WHOLE = -1


def cut_table(df: DataFrame, keys: list[Column], measures: list[tuple[str, str | None]], extra: dict[str, Column] | None = None, whole: bool = False) -> DataFrame:
    """One row for each value of each key: cut (the key's number), label (its
    value as text), k0, k1, … (the value in the column of its key), v0, v1, …
    (the measures, as in a breakdown) and the greatest value of each `extra` column. With `whole`
    also one row over everything, with the cut -1.

    The table is read once and shuffled once, as partial states: GROUPING SETS
    with one key each. A row takes part in every cut whose key it has; null keys
    make no row. Measures are (aggregation, metric) and merge; medians and
    distinct counts don't and are not taken.
    """
    for aggregation, _ in measures:
        if aggregation in ("median", "nunique"):
            raise ValueError(f"{aggregation} has no partial state of fixed size")
    metrics = list(dict.fromkeys(m for _, m in measures if m is not None))
    names = [f"_k{i}" for i in range(len(keys))]
    flat = df.select(*[key.alias(name) for key, name in zip(keys, names)], *[c(m) for m in metrics], *[e.alias(f"_e{i}") for i, e in enumerate((extra or {}).values())])
    sets = [[F.col(n)] for n in names] + ([[]] if whole or not names else [])
    values = [measure(flat, *m).alias(f"v{i}") for i, m in enumerate(measures)]
    last = [F.max(f"_e{i}").alias(name) for i, name in enumerate(extra or {})]
    # One bit a key, the first key the highest; it is 0 where the key is grouped by.
    rows = flat.groupingSets(sets, *[F.col(n) for n in names]).agg(F.grouping_id().alias("_id") if names else F.lit(0).alias("_id"), F.count(F.lit(1)).alias("rows"), *values, *last)
    full = (1 << len(names)) - 1
    cut = F.lit(WHOLE)
    for i in range(len(names)):
        cut = F.when(F.col("_id") == full - (1 << (len(names) - 1 - i)), i).otherwise(cut)
    label = F.coalesce(*[F.col(n).cast("string") for n in names]) if names else F.lit(None).cast("string")
    rows = rows.withColumn("cut", cut).withColumn("label", label).filter((F.col("cut") == WHOLE) | F.col("label").isNotNull())
    kept = [F.col(n).alias(f"k{i}") for i, n in enumerate(names)]
    return rows.select("cut", "label", *kept, "rows", *[f"v{i}" for i in range(len(measures))], *(extra or {}))
