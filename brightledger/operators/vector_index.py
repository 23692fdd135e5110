"""Vector search through an inverted file, exact on the rows it looks at.

Vectors of unit length lie in cells around k-means centers. Of each the index
keeps what is left after its center, one byte a dimension, next to the vector
itself. A query looks at the cells nearest to it: in a block of vectors the bytes
choose candidates, whose similarities are then computed from the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.operators.search import TOP_K, best_hits
from brightledger.session import work_folder

#: Vectors that the centers are fitted on, at any size of the table: those of
#: the least hashes of their ids. Every vector of the table is indexed.
SAMPLE_ROWS = 20_000
#: Cells at most (a center has some twenty vectors of the sample at least).
MOST_CELLS = 1024
#: Candidates by their bytes, for each hit wanted.
CANDIDATES = 4
BLOCK_BYTES = 1 << 20
#: Share of the nearest vectors that a search is to find, and the vectors of the
#: sample that tell how many cells that takes.
RECALL, ASKED_ROWS, ASKED_HITS = 0.95, 300, 10


@dataclass
class VectorIndex:
    """Blocks (cell, ids, scales, codes, units) of a table, the centers, and the
    number of cells a query should look at."""

    blocks: DataFrame
    centers: np.ndarray
    probes: int = 0

    @property
    def cells(self) -> int:
        return len(self.centers)


def _units(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, float) for v in vectors])
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def fit_centers(sample: np.ndarray, cells: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centers of unit length by k-means with spread-out starts; a center that
    no vector is near to starts again at the vector worst served."""
    rng = np.random.default_rng(seed)
    centers, nearest = sample[[rng.integers(len(sample))]], np.full(len(sample), -np.inf)
    while len(centers) < cells:
        nearest = np.maximum(nearest, sample @ centers[-1])
        far = np.maximum(1 - nearest, 0)
        if not far.sum() > 1e-12:
            break
        centers = np.vstack([centers, sample[rng.choice(len(sample), p=far / far.sum())]])
    for _ in range(rounds):
        scores = sample @ centers.T
        cell = scores.argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, sample)
        worst = np.argsort(scores.max(axis=1), kind="stable")
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-12)
        sums[empty] = sample[worst[: len(empty)]]
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centers


def fit_probes(sample: np.ndarray, centers: np.ndarray, recall: float = RECALL) -> int:
    """How many of the nearest cells hold `recall` of the sample vectors that
    are nearest to some of its vectors. Neighbours within the sample are further
    away than those in the table, so it is rather more than needed."""
    asked = sample[:: max(1, len(sample) // ASKED_ROWS)]
    scores = asked @ sample.T
    near = np.argpartition(-scores, min(ASKED_HITS, len(sample) - 1), axis=1)[:, : ASKED_HITS + 1]
    cell = (sample @ centers.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centers.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def build_vector_index(vectors: DataFrame, id_column: str, vector_column: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, folder: str | None = None) -> VectorIndex:
    """An index of all vectors, written to `folder` (by default a new one of the
    shared work area). Cells are the root of the number of vectors, `MOST_CELLS`
    at most. Missing vectors are left out; all others must have one length.

    Only the sample reaches the driver. Rows are dealt by cell and id, so a cell
    of any size spreads over tasks, and packed in blocks of a megabyte.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    sample = plain.orderBy(F.xxhash64(F.col("id").cast("string")), F.col("id")).limit(sample_rows).toPandas()
    id_type = plain.schema["id"].dataType.simpleString()
    schema = f"cell int, ids array<{id_type}>, scales binary, codes binary, units binary"
    folder = folder or work_folder(spark, "vector-index")
    if sample.empty:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
        return VectorIndex(spark.read.schema(schema).parquet(folder), np.zeros((0, 0)))
    units = _units(sample["vector"])
    count = plain.count()
    centers = fit_centers(units, cells or max(1, min(MOST_CELLS, math.isqrt(count), len(units) // 20)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["cell"] = (_units(batch["vector"]) @ centers.T).argmax(axis=1).astype(np.int32)
                yield batch[["cell", "id", "vector"]]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, part in batch.groupby("cell", sort=False):
                unit = _units(part["vector"])
                left = unit - centers[cell]
                scale = np.maximum(np.abs(left).max(axis=1), 1e-12) / 127
                codes = np.rint(left / scale[:, None]).astype(np.int8)
                step = max(1, BLOCK_BYTES // (9 * unit.shape[1]))
                for low in range(0, len(part), step):
                    cut = slice(low, low + step)
                    yield pd.DataFrame({"cell": [np.int32(cell)], "ids": [part["id"].iloc[cut].tolist()], "scales": [scale[cut].tobytes()], "codes": [codes[cut].tobytes()], "units": [unit[cut].tobytes()]})

    placed = plain.mapInPandas(place, f"cell int, id {id_type}, vector array<double>")
    # Cells and ids are ranges, so that a large cell is no single task.
    dealt = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    dealt.mapInPandas(pack, schema).write.mode("overwrite").parquet(folder)
    return VectorIndex(spark.read.schema(schema).parquet(folder), centers, fit_probes(units, centers))


def search_index(index: VectorIndex, queries: DataFrame, k: int = TOP_K, probes: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """Query vectors (query_id, vector) to about the k best vectors by cosine:
    the k best of the `probes` cells nearest to each query (by default as many as
    the index was fitted to), with exact scores. With all cells and as many
    candidates as vectors, the result is that of `search_embeddings`.

    Queries are posted to their cells and packed there; blocks of vectors and
    of queries meet by cell, and a task keeps k rows for each query and block.
    Cells many queries look at are partitions that adaptive execution splits.
    """
    centers = index.centers
    probes = min(index.cells, probes or index.probes)
    asked, stored = queries.schema["query_id"].dataType, index.blocks.schema["ids"].dataType.elementType

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["vector"].notna()]
            if batch.empty or not probes:
                continue
            unit = _units(batch["vector"])
            scores = unit @ centers.T
            near = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
            at, cell = np.repeat(np.arange(len(unit)), probes), near.ravel()
            for c in np.unique(cell).tolist():
                mine = at[cell == c]
                step = max(1, BLOCK_BYTES // (8 * unit.shape[1]))
                for low in range(0, len(mine), step):
                    some = mine[low : low + step]
                    yield pd.DataFrame({"cell": [np.int32(c)], "query_ids": [batch["query_id"].iloc[some].tolist()], "query_units": [unit[some].tobytes()]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield _best_of_block(row, centers[row.cell], k, candidates)

    plain = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    posted = plain.mapInPandas(post, f"cell int, query_ids array<{asked.simpleString()}>, query_units binary")
    schema = T.StructType([T.StructField("query_id", asked), T.StructField("chunk_id", stored), T.StructField("score", T.DoubleType())])
    return best_hits(index.blocks.join(posted, "cell").mapInPandas(score, schema), k)


def _best_of_block(row, center: np.ndarray, k: int, candidates: int) -> pd.DataFrame:
    ids, query_ids = np.array(list(row.ids)), np.array(list(row.query_ids))
    asked = np.frombuffer(row.query_units).reshape(-1, len(center))
    codes = np.frombuffer(row.codes, np.int8).reshape(-1, len(center)).astype(np.float32)
    units = np.frombuffer(row.units).reshape(-1, len(center))
    wide = min(len(ids), max(1, candidates * k))
    # Similar by the bytes: that of the center and of what they say is left.
    near = asked @ center + np.frombuffer(row.scales)[:, None] * (codes @ asked.T.astype(np.float32))
    at = np.argpartition(-near, wide - 1, axis=0)[:wide].T
    query = np.repeat(np.arange(len(asked)), wide)
    scores = np.round(np.einsum("qcd,qd->qc", units[at], asked), 12).ravel()
    at = at.ravel()
    order = np.lexsort((ids[at], -np.round(scores, 9), query))
    at, query, scores = at[order], query[order], scores[order]
    kept = (np.arange(len(query)) - np.searchsorted(query, query) < k) & (scores > 0)
    return pd.DataFrame({"query_id": query_ids[query[kept]], "chunk_id": ids[at[kept]], "score": scores[kept]})
