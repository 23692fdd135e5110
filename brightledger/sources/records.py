"""IO1: records of delimited files whose quoted cells hold line breaks.

A file of any size is read by as many tasks as it has splits. Whether a split
begins inside quotes depends on the quotes in all splits before it: splits count
theirs, a prefix sum of one number each gives the state at every start, and each
split then cuts its own records. What a split holds of a record that began in an
earlier one is put together afterwards, two fragments a split at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.functions.exprs import c

QUOTE = '"'

_CUT = "file string, at long, kind int, number long, record binary"
# Kinds of what a split holds: a whole record; lines of an earlier one; the start
# of one that goes on. Fragments of a split sort in this order.
WHOLE, REST, BEGUN = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split, whose lines come one after another."""
    split, inside, number, kind, held = None, False, 0, WHOLE, []

    def close(as_kind: int) -> tuple:
        row = (*split, as_kind, number, b"\n".join(held))
        held.clear()
        return row

    for batch in batches:
        rows: list[tuple] = []
        files, at, opened = (batch.column(k) for k in range(3))
        lines = batch.column(3).to_pylist()
        quotes = pc.count_substring(batch.column(3), QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
        places = at.to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(files).indices.to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((places[1:] != places[:-1]) | (coded[1:] != coded[:-1])) + 1
        for low, high in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
            here = (files[low].as_py(), int(places[low]))
            if here != split:
                if held:
                    rows.append(close(REST if kind == REST else BEGUN))
                split, number, inside = here, 0, bool(opened[low].as_py())
                kind = REST if inside else WHOLE
            # Whether each line ends inside quotes.
            after = (np.cumsum(quotes[low:high]) + inside) % 2 == 1
            ends = np.flatnonzero(~after)
            done = 0
            for end in ends.tolist():
                held.extend(lines[low + done : low + end + 1])
                rows.append(close(kind))
                number += kind == WHOLE
                kind, done = WHOLE, end + 1
            held.extend(lines[low + done : high])
            inside = bool(after[-1])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["file", "at", "kind", "number", "record"])
    if held:
        row = close(REST if kind == REST else BEGUN)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["file", "at", "kind", "number", "record"])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, number, record): the records of all files as bytes, with the
    start of the split they begin in and their number there; the first of a
    file is (0, 0). Line breaks inside quotes become line feeds, other bytes are
    as they were. A quote inside an unquoted cell must have a partner on its line.

    Splits that begin inside quotes are broadcast: at most one row of two
    numbers for each split of the input (128 MB by default). A record may span
    any number of splits; it is one row in the end.
    """
    line = F.col("value").cast("binary")
    # The file as a number, so that a row of the broadcast table has a fixed size.
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), line.alias("line"),
        (F.octet_length("value") - F.octet_length(F.replace("value", F.lit(QUOTE), F.lit("")))).alias("quotes"),
    )
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = lines.groupBy("file", "at").agg((F.sum("quotes") % 2).alias("odd")).withColumn("inside", before % 2 == 1)
    opened = splits.filter("inside").select(F.xxhash64("file").alias("name"), "at", F.lit(True).alias("inside"))
    placed = lines.withColumn("name", F.xxhash64("file")).join(F.broadcast(opened), ["name", "at"], "left")
    # A broadcast join keeps the lines of a split in their order.
    cut = placed.select("file", "at", F.coalesce("inside", F.lit(False)).alias("inside"), "line").mapInArrow(_cut, _CUT)
    whole = cut.filter(F.col("kind") == WHOLE).select("file", "at", "number", "record")
    return whole.unionByName(_stitched(cut.filter(F.col("kind") != WHOLE)))


def _stitched(fragments: DataFrame) -> DataFrame:
    """The records that span splits: each begun one with the rests after it, up
    to the next begun one. A file's fragments, two for each split at most, are
    numbered in one task."""
    begun = F.sum(F.when(F.col("kind") == BEGUN, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = fragments.withColumn("of", begun).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "number", "record"))).alias("parts"))
    joined = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0))["record"], lambda whole, p: F.concat(whole, F.lit(b"\n"), p["record"]))
    first = F.get("parts", F.lit(0))
    return parts.select("file", first["at"].alias("at"), first["number"].alias("number"), joined.alias("record"))


def narrowest_types(texts: DataFrame) -> list[str]:
    """For each text column the first of int, bigint, double, timestamp, boolean
    that all its values have the shape of, else string; null and empty values
    fit any, a column without others is string. One pass over the rows."""
    shapes = {
        "int": (r"^[+-]?\d{1,10}$", "int"), "bigint": (r"^[+-]?\d{1,19}$", "bigint"),
        "double": (r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$", "double"),
        "timestamp": (r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}.*)?$", "timestamp"), "boolean": r"(?i)^(?:true|false)$",
    }

    def fits(value: Column, kind: str) -> Column:
        if kind == "boolean":
            return value.rlike(shapes[kind])
        shape, dtype = shapes[kind]
        return F.when(value.isNotNull(), value.rlike(shape) & value.try_cast(dtype).isNotNull())

    checks = []
    for i, name in enumerate(texts.columns):
        value = F.when(c(name) != "", F.trim(c(name)))
        checks.append(F.count(value).alias(f"n{i}"))
        checks += [F.bool_and(fits(value, kind)).alias(f"{kind}{i}") for kind in shapes]
    row = texts.agg(*checks).first()
    return [next((k for k in shapes if row[f"n{i}"] and row[f"{k}{i}"]), "string") for i in range(len(texts.columns))]


def parse_records(records: DataFrame, code: str, sep: str, names: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The columns of records by Spark's own parser; without a schema types are
    the narrowest that all values fit."""
    # Quotes are doubled in quoted cells, as counting them needs it. Blanks at the
    # ends of cells stay (the parser fails on blank quoted cells if told to trim).
    options = {"sep": sep, "escape": QUOTE, "maxCharsPerColumn": "-1"}
    given = [(f.name, f.dataType.simpleString()) for f in schema] if schema is not None else None
    width = len(given or names)
    cells = ", ".join(f"c{i} string" for i in range(width))
    texts = records.select(F.from_csv(F.decode("record", code), cells, options).alias("r")).select("r.*")
    types = given or list(zip(names, narrowest_types(texts)))
    typed = [F.col(f"c{i}") if t == "string" else F.nullif(F.trim(f"c{i}"), F.lit("")).try_cast(t) for i, (_, t) in enumerate(types)]
    return texts.select(*[x.alias(n) for x, (n, _) in zip(typed, types)])
