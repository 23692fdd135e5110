"""Dataset versions, ownership and conversation sessions.

versions: id, user_id, filename, content_hash, version, is_active, created_at.
Newest versions are found with aggregates, which merge before the shuffle, so
a file or user holding most of the rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS_REMEMBERED = 6
LOGICAL = ["user_id", "filename"]


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def check_duplicates(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """Incoming (user_id, filename, content_hash) against the active versions."""
    active = versions.filter("is_active").select(
        *LOGICAL, F.col("content_hash").alias("active_hash"), F.col("id").alias("existing_id")
    )
    newest = versions.groupBy(*LOGICAL).agg((F.max("version") + 1).alias("next_version"))
    status = (
        F.when(F.col("existing_id").isNull(), "new")
        .when(F.col("content_hash") == F.col("active_hash"), "exact_duplicate")
        .otherwise("changed_version")
    )
    return (
        incoming.join(active, LOGICAL, "left")
        .join(newest, LOGICAL, "left")
        .select(
            *incoming.columns,
            status.alias("status"),
            F.when(status != "new", F.col("existing_id")).alias("existing_id"),
            F.when(status == "changed_version", F.col("next_version")).alias("next_version"),
        )
    )


def next_versions(versions: DataFrame) -> DataFrame:
    """The number the next version of each file gets."""
    return versions.groupBy(*LOGICAL).agg((F.max("version") + 1).alias("next_version"))


def add_versions(versions: DataFrame, uploads: DataFrame, force: bool = False) -> DataFrame:
    """Uploads (id, user_id, filename, content_hash, created_at), any number
    per file, taken in order of created_at and id. Content that differs from the
    version before it becomes a version; the last one of a file is active, older
    ones are kept inactive. Unchanged content adds nothing unless forced.

    One shuffle by file: a file's uploads are ordered in one window and never
    meet its versions, of which only the active hash and the greatest number are
    joined.
    """
    before = versions.groupBy(*LOGICAL).agg(
        F.max(F.when(F.col("is_active"), F.col("content_hash"))).alias("_hash"), F.max("version").alias("_top")
    )
    in_order = Window.partitionBy(*LOGICAL).orderBy("created_at", "id")
    batch = uploads.join(before, LOGICAL, "left")
    if not force:
        batch = batch.withColumn("_before", F.lag("content_hash").over(in_order))
        same = F.col("content_hash").eqNullSafe(F.coalesce("_before", "_hash"))
        batch = batch.filter(~same | F.coalesce("_before", "_hash").isNull())
    last = F.row_number().over(Window.partitionBy(*LOGICAL).orderBy(F.col("created_at").desc(), F.col("id").desc()))
    fresh = batch.select(
        *uploads.columns,
        (F.coalesce("_top", F.lit(0)) + F.row_number().over(in_order)).cast(versions.schema["version"].dataType).alias("version"),
        (last == 1).alias("is_active"),
    )
    replaced = fresh.select(*LOGICAL).distinct().withColumn("_replaced", F.lit(True))
    kept = versions.join(replaced, LOGICAL, "left").withColumn("is_active", F.col("is_active") & F.col("_replaced").isNull())
    return kept.select(*versions.columns).unionByName(fresh.select(*versions.columns))


def activate_versions(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen (user_id, id), at most one per file: that version active, all
    others of its file inactive. Another user's version is left alone."""
    target = versions.join(chosen.select("user_id", "id").distinct(), ["user_id", "id"], "left_semi")
    joined = versions.join(target.select(*LOGICAL, F.col("id").alias("_chosen")), LOGICAL, "left")
    flag = F.coalesce(F.col("id") == F.col("_chosen"), F.col("is_active"))
    return joined.withColumn("is_active", flag).select(*versions.columns)


def delete_versions(versions: DataFrame, deleted: DataFrame) -> DataFrame:
    """C4: versions without the deleted ids; where an active one went, the
    newest remaining version of its file becomes active."""
    ids = deleted.select("id").distinct()
    left = versions.join(ids, "id", "left_anti")
    orphaned = versions.filter("is_active").join(ids, "id", "left_semi").select(*LOGICAL).distinct()
    promoted = left.join(orphaned, LOGICAL, "left_semi").groupBy(*LOGICAL).agg(F.max("version").alias("_promote"))
    joined = left.join(promoted, LOGICAL, "left")
    flag = F.coalesce(F.col("version") == F.col("_promote"), F.col("is_active"))
    return joined.withColumn("is_active", flag).select(*versions.columns)


def visible_datasets(datasets: DataFrame, ownership: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Datasets (id, …) a user owns (ownership: user_id, id), and derived
    ones (lineage: derived_id, left_id, right_id) with an owned parent."""
    owned = ownership.select("user_id", "id").distinct()
    if lineage is not None:
        parents = lineage.select("derived_id", F.explode(F.array("left_id", "right_id")).alias("id"))
        derived = parents.join(owned, "id").select("user_id", F.col("derived_id").alias("id"))
        owned = owned.unionByName(derived).distinct()
    return datasets.join(owned, "id")


def narrowed(ownership: DataFrame, selection: DataFrame) -> DataFrame:
    """Ownership restricted to a selection; never widened by it."""
    return ownership.join(selection, [c for c in ("user_id", "id") if c in selection.columns], "left_semi")


def library(versions: DataFrame, include_inactive: bool = False) -> DataFrame:
    """By file, latest version first; active ones only unless asked."""
    shown = versions if include_inactive else versions.filter("is_active")
    return shown.orderBy("user_id", "filename", F.col("version").desc())


def listing(datasets: DataFrame) -> DataFrame:
    """Datasets in order of creation."""
    return datasets.orderBy("created_at", "id")


def recent_turns(turns: DataFrame, session: str, order: str, k: int = TURNS_REMEMBERED) -> DataFrame:
    """T5: the last k turns of every session; the rank limit already applies
    before the shuffle, so long sessions send k rows per task."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.col(order).desc()))
    return turns.withColumn("recency", rank).filter(F.col("recency") <= k)


def session_list(turns: DataFrame, session: str, activity: str) -> DataFrame:
    """Sessions with message count, latest activity first."""
    return (
        turns.groupBy(session)
        .agg(F.count(F.lit(1)).alias("message_count"), F.max(activity).alias("last_activity"))
        .orderBy(F.col("last_activity").desc(), session)
    )
