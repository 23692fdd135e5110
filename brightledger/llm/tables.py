"""Tables of results in the shared work folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.session import work_folder


def settled(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: later
    steps neither compute them twice nor need the executors that made them."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct `row`, whatever their names are."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")
