"""Session, table loading and the shared work folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def get_spark(app: str = "brightledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing below is required for right results except the UTC time zone for
    zoned timestamps; adaptive execution picks join strategy, splits skewed
    join partitions and sizes shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package()
    return spark


def ship_package(*others: ModuleType) -> None:
    """Pickle the functions of this package (and others) by value, so executors
    need no install."""
    for module in (sys.modules["brightledger"], *others):
        cloudpickle.register_pickle_by_value(module)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table, lazily, so filters and column pruning reach the scan.

    Operators read NaN as missing where it matters (`exprs.known`); wrapping
    the scan here would keep comparisons from being pushed down.
    """
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A handful of driver rows as a local relation: no job is needed to read
    it, and its size is known to the optimizer."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    types = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types.types)], schema=types))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float columns with NaN read as missing; the projection still prunes."""
    floats = (T.DoubleType, T.FloatType)
    if not any(isinstance(f.dataType, floats) for f in df.schema):
        return df
    return df.select(
        *[
            F.nanvl(F.col(_quoted(f.name)), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(_quoted(f.name))
            for f in df.schema
        ]
    )


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one that `spark.checkpoint.dir` names.

    Only a local master may fall back to this machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="brightledger-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
