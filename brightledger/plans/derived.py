"""Joins kept as datasets of their own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from brightledger.operators.joins import LINEAGE_SCHEMA, JoinSpec, find_existing_join, lineage_row, safe_join
from brightledger.operators.profile import TableProfile, profile_table
from brightledger.session import small_frame
from brightledger.sources.datasets import dataset_path, read_dataset, write_dataset

# The folder under a root that keeps its lineage; no dataset has this id.
LINEAGE = "lineage"


def read_lineage(spark: SparkSession, root: str) -> DataFrame:
    """The lineage rows kept under `root`, none if nothing was derived yet."""
    try:
        return spark.read.schema(LINEAGE_SCHEMA).parquet(dataset_path(root, LINEAGE))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return small_frame(spark, [], LINEAGE_SCHEMA)


def derive_dataset(
    left: DataFrame,
    right: DataFrame,
    spec: JoinSpec,
    root: str,
    derived_id: str,
    created_by: str,
    lineage: DataFrame | None = None,
    lineage_root: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(dataset, its lineage row). The join is written once under `root` and
    read back, so later passes scan columns instead of joining again; its lineage
    row is kept there, too. Where the lineage (by default that of `lineage_root`,
    or else of `root`) already holds the same join, that dataset is read from
    where the lineage is kept.
    """
    spark = left.sparkSession
    if lineage is None:
        lineage = read_lineage(spark, lineage_root or root)
    keys = "left_id string, left_column string, right_id string, right_column string, join_type string"
    request = small_frame(spark, [(spec.left_name, spec.left_key, spec.right_name, spec.right_key, spec.how)], keys)
    existing = find_existing_join(lineage, request).first()["existing_id"]
    if existing is None:
        write_dataset(safe_join(left, right, spec), root, derived_id)
        made = lineage_row(spark, derived_id, spec.left_name, spec.right_name, spec, created_by)
        made.write.mode("append").parquet(dataset_path(root, LINEAGE))
        existing, lineage_root = derived_id, root
    row = lineage_row(spark, existing, spec.left_name, spec.right_name, spec, created_by)
    return read_dataset(spark, lineage_root or root, existing), row


def derive_profiled(
    left: DataFrame, right: DataFrame, spec: JoinSpec, root: str, derived_id: str, created_by: str
) -> tuple[DataFrame, DataFrame, TableProfile]:
    """The derived dataset, its lineage row, and its own profile."""
    dataset, row = derive_dataset(left, right, spec, root, derived_id, created_by)
    return dataset, row, profile_table(dataset, row.first()["derived_id"])
