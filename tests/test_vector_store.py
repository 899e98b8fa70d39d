"""Search with bounds finds what a scan of all vectors finds, and skips what it can."""

import numpy as np
import pytest

from corvane.operators import vector_store as V
from corvane.operators.retrieval import knn
from corvane.operators.vector_store import VectorStore

SCHEMA = "vec_id long, embedding array<float>"


def found(df):
    return {(r.query_id, r.rank): (r.vec_id, pytest.approx(r.score, abs=1e-9)) for r in df.collect()}


def test_clustered_vectors_are_mostly_skipped(spark, tmp_path, monkeypatch):
    """Also over queries in many blocks, copies that make ties, and after a reload by another store."""
    monkeypatch.setattr(V, "FILE_ROWS", 50)
    g = np.random.default_rng(3)
    centres = g.normal(size=(40, 16)) * 5
    rows = [(i, (centres[i % 40] + g.normal(size=16) * 0.1).tolist()) for i in range(2_000)] + [(5_000 + i, centres[0].tolist()) for i in range(300)]
    vectors = spark.createDataFrame([*rows, (None, [0.0] * 16), (9_999, None)], SCHEMA)
    VectorStore(spark, str(tmp_path / "v")).write(vectors)
    store = VectorStore(spark, str(tmp_path / "v"))
    queries = vectors.filter("vec_id % 50 = 0")
    want = found(knn(queries, vectors, 7))
    got, share = store.search(queries, 7)
    assert found(got) == want and share < 0.3
    read = store.vectors().filter("cluster = 0")
    assert "PartitionFilters: [isnotnull(cluster" in read._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(V, "QUERY_BYTES", 1_000)
    assert found(store.search(queries, 7)[0]) == want


@pytest.mark.parametrize("k", [1, 30, 500])
def test_vectors_without_clusters_and_large_k(spark, tmp_path, k):
    g = np.random.default_rng(k)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g.normal(size=(300, 8)) * g.exponential(size=(300, 1)))], SCHEMA)
    got, _ = VectorStore(spark, str(tmp_path / "v")).write(vectors).search(vectors.filter("vec_id < 9"), k)
    assert found(got) == found(knn(vectors.filter("vec_id < 9"), vectors, k))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    store = VectorStore(spark, str(tmp_path / "v")).write(none)
    assert store.search(none, 3)[0].collect() == [] and store.vectors().collect() == []


def test_few_products_are_held_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SCORES", 16)
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(200)], SCHEMA)
    got, _ = VectorStore(spark, str(tmp_path / "v")).write(rows, 4).search(rows, 7)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == {(r.query_id, r.vec_id, r["rank"]) for r in knn(rows, rows, 7).collect()}
