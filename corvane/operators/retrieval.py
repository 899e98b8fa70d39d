"""Exact vector search, rank fusion, caps by document and the hybrid retrieval that joins them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.functions import vectors as V

RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60, 0.6, 0.4
CANDIDATES, FINAL, PER_DOCUMENT = 40, 8, 3
#: Bytes of query vectors that are compared in one pass over all vectors, and queries that are compared together.
QUERY_BYTES, TOGETHER = 64 << 20, 512


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, score: the k largest inner products with one query; ties go to the smaller id."""
    scored = vectors.select(id_col, V.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the k best of vectors for each query; ties go to the smaller id.

    Queries of QUERY_BYTES together are compared in one pass over vectors. Each task keeps a running best of k for each of
    them and hands it on once, at its end. Queries and vectors without an id or a vector are left out.
    """
    rows = queries.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("query"), F.col(vector).alias("v"))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    blocks = max(1, -(-shape.n * 8 * (shape.dim or 1) // QUERY_BYTES))
    parts = []
    for block in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()
        asked, matrix = np.array([r[0] for r in got], dtype=np.int64), np.array([r[1] for r in got], dtype=np.float64).reshape(len(got), shape.dim or 0)

        def best(batches: Iterator[pa.RecordBatch], asked=asked, matrix=matrix) -> Iterator[pa.RecordBatch]:
            top = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))
            for batch in batches:
                flat = batch.column(1)
                own, values = batch.column(0).to_numpy(zero_copy_only=False), flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1 if len(flat) else 0)
                for begin in range(0, len(asked) if len(own) else 0, TOGETHER):
                    scores = matrix[begin : begin + TOGETHER] @ values.T
                    least = np.partition(scores, max(0, len(own) - k), axis=1)[:, max(0, len(own) - k)] if len(own) > k else np.full(len(scores), -np.inf)
                    q, at = np.nonzero(scores >= least[:, None])
                    top = tuple(map(np.concatenate, zip(top, (q + begin, own[at], scores[q, at]), strict=True)))
                top = k_best(*top, k)
            yield pa.RecordBatch.from_arrays([pa.array(asked[top[0]]), pa.array(top[1]), pa.array(top[2])], names=["query_id", id_col, "score"])

        scanned = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long"), vector)
        parts.append(scanned.mapInArrow(best, f"query_id long, {id_col} long, score double"))
    return top_per_group(reduce(DataFrame.unionByName, parts), ["query_id"], [F.desc("score"), F.asc(id_col)], k)


def k_best(query: np.ndarray, own: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's rows the k with the largest scores, then the smallest ids."""
    order = np.lexsort((own, -score, query))
    query, own, score = query[order], own[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], own[place < k], score[place < k]


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, id_col: str, k: int = RRF_K, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT, by: str | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (id, rank, score) lists: id, fused, matched_by, vector_rank, keyword_rank, vector_score, rank.

    by: the column of both that tells questions apart. Order within each: fused score, found by both, vector score (without
    one last), id.
    """
    if k <= 0 or min(vector_weight, keyword_weight) < 0 or vector_weight + keyword_weight <= 0:
        raise ValueError("k must be positive, weights not negative and their sum positive")
    keys = [*([by] if by else []), id_col]
    v = vector_hits.select(*keys, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    w = keyword_hits.select(*keys, F.col("rank").alias("keyword_rank"))
    part = lambda r, weight: F.coalesce(F.lit(float(weight)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    both = F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull()
    matched = F.when(both, "both").when(F.col("vector_rank").isNotNull(), "vector").otherwise("fts")
    fused = v.join(w, keys, "full_outer").withColumn("fused", part("vector_rank", vector_weight) + part("keyword_rank", keyword_weight)).withColumn("matched_by", matched)
    order = [F.desc("fused"), F.asc(F.when(F.col("matched_by") == "both", 0).otherwise(1)), F.desc_nulls_last("vector_score"), F.asc(id_col)]
    within = W.partitionBy(by) if by else W.partitionBy()  # twice the candidates of a question at most
    return fused.withColumn("rank", F.row_number().over(within.orderBy(*order)).cast("long"))


def cap_per_document(ranked: DataFrame, document: str, cap: int = PER_DOCUMENT, k: int = FINAL, by: str | None = None) -> DataFrame:
    """The first cap hits of each document in rank order, then the first k of all, of each question if by names it; final_rank from 1."""
    capped = top_per_group(ranked, [*([by] if by else []), document], [F.asc("rank")], cap, "_in_document").drop("_in_document")
    if by:
        return top_per_group(capped, [by], [F.asc("rank")], k, "final_rank")
    first = capped.orderBy("rank").limit(k)
    return first.withColumn("final_rank", F.row_number().over(W.orderBy("rank")).cast("long"))


def best_of_repeats(hits: DataFrame, id_col: str, rank: str = "rank", position: str = "position") -> DataFrame:
    return top_per_group(hits, [id_col], [F.asc(rank), F.asc(position)], 1, "_k").drop("_k")


def merge_by_scale(keyword: DataFrame, vector: DataFrame, id_col: str, keyword_weight: float = 0.4, vector_weight: float = 0.6) -> DataFrame:
    """The older merge: scores over their largest absolute value, weighted and summed."""

    def scaled(hits: DataFrame, weight: float) -> DataFrame:
        most = hits.agg(F.nullif(F.max(F.abs("score")), F.lit(0.0)).alias("most"))  # one row
        return hits.crossJoin(F.broadcast(most)).select(id_col, (F.col("score") / F.col("most") * weight).alias("part"))

    return scaled(keyword, keyword_weight).unionByName(scaled(vector, vector_weight)).groupBy(id_col).agg(F.sum("part").alias("score"))
