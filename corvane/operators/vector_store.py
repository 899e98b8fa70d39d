"""A stored table of vectors, clustered into files, and exact search that reads only files which can hold one of the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators.retrieval import QUERY_BYTES, k_best, top_per_group
from corvane.operators.storage import kept

#: Clusters at most, vectors for each of them that centres are drawn from, rounds that move centres, rows of a file. They decide
#: on what can be skipped, not on what is found.
MOST_CLUSTERS, DRAWN, ROUNDS, FILE_ROWS = 2_048, 20, 4, 100_000
#: Products of queries and vectors that a task holds at once.
SCORES = 1 << 20
#: What rounding may add to a bound, as a share of the numbers that it is made of.
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(column) else 0)


def centres_of(drawn: np.ndarray, n: int) -> np.ndarray:
    """n of the drawn vectors, moved a few times to the mean of what is nearest to them."""
    centres = drawn[:n].copy()
    for _ in range(ROUNDS):
        own = nearest(drawn, centres)
        for c in np.unique(own):
            centres[c] = drawn[own == c].mean(axis=0)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


class VectorStore:
    """In folder: vectors (id, vector), a folder for each cluster, and clusters (cluster, centre, radius, n)."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "vec_id", vector: str = "embedding"):
        self.spark, self.folder, self.id_col, self.vector = spark, folder, id_col, vector

    def clusters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/clusters")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"{self.id_col} long, {self.vector} array<double>, cluster int").parquet(f"{self.folder}/vectors")

    def write(self, vectors: DataFrame, clusters: int | None = None) -> VectorStore:
        """Stores vectors (id, vector) of one length. Rows without an id or a vector are left out; an empty table is stored too.

        Centres come from a bounded draw by hash; each vector goes to its nearest one. A cluster of any size, as of copies, is
        written as files of FILE_ROWS rows by as many tasks.
        """
        id_col, vector = self.id_col, self.vector
        rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<double>").alias(vector))
        n = rows.count()
        clusters = min(MOST_CLUSTERS, clusters or max(1, round(n**0.5)))
        drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64(id_col), id_col).limit(clusters * DRAWN).select(vector).collect()], dtype=np.float64)
        centres = centres_of(drawn, clusters) if n else np.zeros((0, 0))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = matrix(batch.column(1))
                    cluster = nearest(own, centres)
                    far = np.linalg.norm(own - centres[cluster], axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(far)], names=[id_col, vector, "cluster", "far"])

        assigned = kept(rows.mapInArrow(assign, f"{id_col} long, {vector} array<double>, cluster int, far double"))
        sizes = kept(assigned.groupBy("cluster").agg(F.max("far").alias("radius"), F.count("*").alias("n")))  # a row for each cluster
        files = F.broadcast(sizes.select("cluster", F.ceil(F.col("n") / FILE_ROWS).alias("files")))
        dealt = assigned.join(files, "cluster").repartition("cluster", F.pmod(F.xxhash64(id_col), F.col("files")))
        dealt.select(id_col, vector, "cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{self.folder}/vectors")
        named = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
        named.join(sizes, "cluster").write.mode("overwrite").parquet(f"{self.folder}/clusters")
        return self

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, float]:
        """query_id, id, score, rank of the k largest inner products of each query (ties: the smaller id), as a scan of all
        vectors would find them, and the share of all pairs of query and vector that were compared.

        An inner product with a vector is at most that with its cluster's centre and the query's length times the radius. Queries
        of QUERY_BYTES together first read the clusters with the highest bounds that hold k vectors; then all others whose bound
        reaches the k-th best that was found. Clusters that no query of them needs are not read.
        """
        id_col = self.id_col
        bounds = self.clusters().orderBy("cluster").collect()  # at most MOST_CLUSTERS
        asked = queries.filter(F.col(id_col).isNotNull() & F.col(self.vector).isNotNull()).select(F.col(id_col).cast("long").alias("query"), F.col(self.vector).cast("array<double>").alias("v"))
        out = self.spark.createDataFrame([], f"query_id long, {id_col} long, score double, rank int")
        total = asked.count()
        if not bounds or not total:
            return out, 0.0
        centres, radius, sizes = np.array([b.centre for b in bounds]), np.array([b.radius for b in bounds]), np.array([b.n for b in bounds])
        blocks, compared = max(1, -(-total * 8 * centres.shape[1] // QUERY_BYTES)), 0
        for block in range(blocks):
            got = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()
            if not got:
                continue
            ids, q = np.array([r.query for r in got]), np.array([r.v for r in got], dtype=np.float64)
            reach = np.linalg.norm(q, axis=1)[:, None] * radius
            bound = q @ centres.T + reach
            bound += SLACK * (np.abs(bound) + reach + 1)
            order = np.argsort(-bound, axis=1)
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros_like(bound, dtype=bool)
            np.put_along_axis(first, order, held < k, axis=1)
            found = self.best(bounds, first, ids, q, k)
            least = {r.query_id: r.score for r in found.filter(F.col("rank") == k).collect()}  # a row for each query of the block
            floor = np.array([least.get(i, -np.inf) for i in ids.tolist()])
            more = (bound >= floor[:, None]) & ~first
            both = found.drop("rank").unionByName(self.best(bounds, more, ids, q, k).drop("rank")) if more.any() else found.drop("rank")
            out = out.unionByName(top_per_group(both, ["query_id"], [F.desc("score"), F.asc(id_col)], k).withColumn("rank", F.col("rank").cast("int")))
            compared += int(((first | more) * sizes).sum())
        return out, compared / (total * int(sizes.sum()))

    def best(self, bounds: list, needed: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
        """The k best of each query in the clusters that it needs (queries by clusters). Only these are read."""
        id_col = self.id_col
        wanted = {b.cluster: np.flatnonzero(needed[:, i]) for i, b in enumerate(bounds) if needed[:, i].any()}

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))
            for batch in batches:
                own, values, cluster = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
                for c in np.unique(cluster).tolist():
                    rows = np.flatnonzero(cluster == c)
                    found, step = [top], max(1, SCORES // len(rows))
                    for begin in range(0, len(wanted[c]), step):
                        some = wanted[c][begin : begin + step]
                        scores = q[some] @ values[rows].T
                        least = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(some), -np.inf)
                        at, of = np.nonzero(scores >= least[:, None])
                        found.append(k_best(some[at], own[rows][of], scores[at, of], k))
                    top = k_best(*map(np.concatenate, zip(*found, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[top[0]]), pa.array(top[1]), pa.array(top[2])], names=["query_id", id_col, "score"])

        read = self.vectors().filter(F.col("cluster").isin(list(wanted)))
        return kept(top_per_group(read.mapInArrow(compare, f"query_id long, {id_col} long, score double"), ["query_id"], [F.desc("score"), F.asc(id_col)], k))
