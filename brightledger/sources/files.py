"""IO5: which files of a listing can be taken in, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightledger.session import small_frame

# Accepted endings.
TABLE_ENDINGS = [".csv", ".xlsx"]
DOCUMENT_ENDINGS = [".pdf", ".docx", ".pptx", ".txt", ".md", ".py", ".html", ".htm"]
LEGACY_ENDING = ".xls"


def list_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, length) of the files a glob names, from the file system's listing.

    Spark's own file readers leave empty files out, and those have to be
    reported here; no content is read.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path_glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    rows = [(status.getPath().toString(), status.getLen()) for status in found if status.isFile()]
    return small_frame(spark, rows, "path string, length long")


def file_ending(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))))


def validate_files(listing: DataFrame, max_mb: float, endings: list[str] | None = None) -> DataFrame:
    """IO5: the listing (path, length) with accepted and reason. Every file gets
    its own verdict, so a bad one never stops the rest."""
    endings = endings or TABLE_ENDINGS
    ending = file_ending(F.col("path"))
    reason = (
        F.when(ending.isNull(), "no_extension")
        .when((ending == LEGACY_ENDING) & F.lit(".xlsx" in endings), "legacy_format")
        .when(~ending.isin(endings), "unsupported_type")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > int(max_mb * 1024 * 1024), "too_big")
    )
    return listing.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def split_files(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO5: (accepted, rejected)."""
    return verdicts.filter("accepted"), verdicts.filter("NOT accepted")
