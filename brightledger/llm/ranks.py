"""Places of rows in their group's order, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightledger.llm.tables import settled


def ranked(rows: DataFrame, group: str, order: list[str], purpose: str = "ranked") -> DataFrame:
    """The rows with `place`, the number of rows of their group before them.

    Rows are dealt by ranges of (group, order), so a group of any size spreads
    over as many tasks as it needs. A row's number in its task counts from the
    group's first row there; the group's rows in the tasks before are added,
    which are one count for each task and group. The order of equal rows is
    fixed by the table that holds the sorted rows. Group values are not null.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = settled(dealt.withColumn("_at", F.monotonically_increasing_id()), purpose)
    task = F.shiftright("_at", 33)
    counted = placed.groupBy(group, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(group, "_task", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.withColumn("_task", task).join(starts, [group, "_task"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_task")


def nulls_first(column: Column) -> Column:
    """A text that is never null and sorts like the column, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def nulls_last(column: Column) -> Column:
    """A text that is never null and sorts like the column, null last."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))
