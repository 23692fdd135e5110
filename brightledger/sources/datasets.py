"""IO3, IO4, IO6, IO7: datasets as parquet folders, and incremental intake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import c

MAX_SAMPLE = 500


def dataset_path(root: str, dataset_id: str) -> str:
    return f"{root.rstrip('/')}/{dataset_id}"


def read_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """IO3: lazily; only the columns a query uses are read."""
    return spark.read.parquet(dataset_path(root, dataset_id))


def writable(df: DataFrame) -> DataFrame:
    """Columns parquet or the profile cannot hold as they are become text."""
    odd = (T.VariantType, T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)
    return df.select(
        *[
            (F.to_json(c(f.name)) if isinstance(f.dataType, T.VariantType) else c(f.name).cast("string")).alias(f.name)
            if isinstance(f.dataType, odd)
            else c(f.name)
            for f in df.schema
        ]
    )


def write_dataset(df: DataFrame, root: str, dataset_id: str) -> str:
    """IO4: one folder per dataset id; an id is written once and never merged."""
    path = dataset_path(root, dataset_id)
    writable(df).write.mode("error").parquet(path)
    return path


def sample_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """IO6: between 1 and 500 rows."""
    return df.limit(max(1, min(n, MAX_SAMPLE)))


def plan_sync(listing: DataFrame, state: DataFrame) -> DataFrame:
    """IO7: listing (item_id, modified_at) with action "sync" where the item is
    new or newer than its state (item_id, synced_modified_at), else "skip"."""
    seen = state.groupBy("item_id").agg(F.max("synced_modified_at").alias("synced_modified_at"))
    joined = listing.join(seen, "item_id", "left")
    fresh = F.col("synced_modified_at").isNull() | (F.col("modified_at") > F.col("synced_modified_at"))
    return joined.withColumn("action", F.when(fresh, "sync").otherwise("skip"))


def incremental_ingest(
    listing: DataFrame, state: DataFrame, ingest: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """IO7: `ingest` gets all items due in one DataFrame and returns item_id and
    error (NULL if taken in); a failing item is recorded, the others go on.
    Returns the new state with status and last_error."""
    plan = plan_sync(listing, state)
    outcome = ingest(plan.filter("action = 'sync'").drop("action", "synced_modified_at")).select("item_id", "error")
    joined = plan.join(outcome, "item_id", "left")
    failed = F.col("error").isNotNull()
    taken = (F.col("action") == "sync") & ~failed
    return joined.select(
        "item_id",
        F.when(taken, F.col("modified_at")).otherwise(F.col("synced_modified_at")).alias("synced_modified_at"),
        F.when(failed, "error").otherwise("synced").alias("status"),
        F.col("error").alias("last_error"),
        "action",
    )
