"""IO7 and A4 as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brightledger.functions.exprs import c


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, name_glob: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """New parquet files of a folder; the query's checkpoint knows the old ones."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", name_glob).parquet(folder)


def ingest_new_files(
    stream: DataFrame, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """IO7: takes in what is new and stops. A batch always writes its own folder,
    so a batch repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ready = prepare(batch) if prepare else batch
        ready.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_stream(stream: DataFrame, time_column: str, metric: str, late: str = "7 days") -> DataFrame:
    """A4 over a stream: sums per day and calendar month; days close with the watermark.

    Days are the windows (months are no fixed length); the month goes along as
    a key, so state stays one row per open day.
    """
    timed = stream.withColumn("_ts", c(time_column).cast("timestamp")).withWatermark("_ts", late)
    return (
        timed.groupBy(F.window("_ts", "1 day"), F.date_format(c(time_column), "yyyy-MM").alias("period"))
        .agg(F.sum(c(metric)).alias("value"), F.count(F.lit(1)).alias("row_count"))
        .select("period", F.col("window.start").cast("date").alias("day"), "value", "row_count")
    )


def keep_totals(totals: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes the days whose totals a batch has changed, each batch to a folder
    of its own; a batch run again after a failure replaces itself and touches no
    earlier one. Days behind the watermark leave the state. Stops when nothing
    new is left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def months_of(days: DataFrame) -> DataFrame:
    """Monthly totals of the days a stream has written, each as its last batch
    left it."""
    last = days.groupBy("period", "day").agg(F.max_by(F.struct("value", "row_count"), "batch").alias("last"))
    return last.groupBy("period").agg(F.sum("last.value").alias("value"), F.sum("last.row_count").alias("row_count"))
