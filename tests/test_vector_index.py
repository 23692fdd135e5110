"""The inverted file against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightledger.operators.search import search_embeddings
from brightledger.operators.vector_index import build_vector_index, fit_centers, search_index


def _hits(df):
    return {(r.query_id, r["rank"]): (r.chunk_id, r.relevance_score) for r in df.collect()}


def _vectors(spark, n, seed=1, dim=16):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(12, dim))
    rows = [(i, (hubs[i % 12] + rng.normal(scale=0.7, size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, rows[0][1])], "id long, v array<float>").repartition(4)


def test_all_cells_are_the_exact_search(spark):
    vectors = _vectors(spark, 700)
    queries = vectors.filter("id < 40").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    index = build_vector_index(vectors, "id", "v", cells=9)
    assert index.blocks.select(F.explode("ids").alias("i")).agg(F.count("i"), F.count_distinct("i")).first() == (701, 701)
    exact = search_embeddings(vectors, "id", "v", queries, 6)
    assert _hits(search_index(index, queries, 6, probes=9, candidates=1000)) == _hits(exact)


def test_recall_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = build_vector_index(vectors, "vec_id", "embedding")
    assert index.cells > 20
    found = {(r.query_id, r.chunk_id) for r in search_index(index, queries, 10).collect()}
    exact = {(r.query_id, r.chunk_id) for r in search_embeddings(vectors, "vec_id", "embedding", queries, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_odd_tables(spark):
    vectors = _vectors(spark, 50)
    queries = vectors.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    assert search_index(build_vector_index(vectors.limit(0), "id", "v"), queries).count() == 0
    index = build_vector_index(vectors, "id", "v")
    assert search_index(index, queries.limit(0)).count() == 0
    # A query without a vector finds nothing; equal vectors come by id.
    hits = _hits(search_index(index, queries.filter("id in (0, 50)"), 2, candidates=100))
    assert hits == {(0, 1): (0, 1.0), (0, 2): (51, 1.0)}
    named = vectors.select(F.concat(F.lit("v"), "id").alias("id"), "v")
    assert search_index(build_vector_index(named, "id", "v"), queries.filter("id = 3"), 1).first()["chunk_id"] == "v3"


def test_centers_of_few_distinct_vectors():
    sample = np.repeat(np.eye(3), 5, axis=0)
    centers = fit_centers(sample, 8)
    assert len(centers) == 3 and np.allclose(sorted(map(tuple, centers)), sorted(map(tuple, np.eye(3))))
    assert fit_centers(sample[:1], 4) == pytest.approx(sample[:1])
