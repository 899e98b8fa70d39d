"""Queries of the layered library: micro-batches, tombstones, search over layers, enrichment; and the SQL that states the same."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import address, enrichment, postings
from corvane.operators.storage import kept, new_folder, remove
from corvane.operators.vector_store import VectorStore
from corvane.plans.manifest import ManifestStore
from corvane.registry import query, read
from corvane.retrieval_queries import DOT_SQL, TERMS, asked, bm25_sql, sql_strip
from corvane.streaming import ingest

#: What lives after library()'s batches: even ids were changed by the second batch, of these every third came back by the third one.
LIVING_SQL = f"""living AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT (doc_id % 3 = 0 AND said) THEN text || ' (b)' ELSE text END AS text, CASE WHEN doc_id % 2 = 1 THEN 0 WHEN doc_id % 3 = 0 AND said THEN 2 ELSE 1 END::BIGINT AS layer
  FROM (SELECT doc_id, coalesce(text, '') AS text, {sql_strip("coalesce(text, '')")} <> '' AS said FROM documents WHERE doc_id IS NOT NULL) WHERE said OR doc_id % 2 = 0)"""

_libraries: dict[tuple, ManifestStore] = {}


def library(spark: SparkSession, sf_dir: str) -> ManifestStore:
    """All documents in a base and two micro-batches: three of four ids at first, then all even ones with an ending, then every
    third as it was. Written by the first query that needs it and read by the others of the application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _libraries:
        docs = read(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
        batch = lambda which, text="text": docs.filter(which).select("key", F.expr(text).alias("text"))
        store = ingest.initialise(spark, new_folder(spark), batch("doc_id % 4 <> 0"), ingest.whole_texts)
        ingest.ingest_batch(store, batch("doc_id % 2 = 0", "concat(text, ' (b)')"), "one", ingest.whole_texts)
        ingest.ingest_batch(store, batch("doc_id % 3 = 0"), "two", ingest.whole_texts)
        _libraries[key] = store
    return _libraries[key]


@query("i1_micro_batches", f"WITH {LIVING_SQL} SELECT doc_id, layer, sha256(text) AS text_sha256 FROM living")
def i1(spark, sf_dir):
    store = library(spark, sf_dir)
    rows = ingest.living(store, store.current())
    return rows.select(F.col("key").cast("long").alias("doc_id"), "layer", F.col("digest").alias("text_sha256"))


@query("i4_layer_tombstones", f"""WITH d AS (SELECT doc_id, {sql_strip("coalesce(text, '')")} <> '' AS said FROM documents),
t AS (SELECT 1 AS layer, count(*) AS n FROM d WHERE doc_id % 4 = 2 AND said UNION ALL SELECT 2, count(*) FROM d WHERE doc_id % 6 = 0 AND said)
SELECT layer::BIGINT AS layer, unnest(['doc_version', 'chunk']) AS entity_type, n FROM t WHERE n > 0""")
def i4(spark, sf_dir):
    store = library(spark, sf_dir)
    return ingest.tombstones(store, store.current()).groupBy("layer", "entity_type").agg(F.count("*").alias("n"))


@query("k3_layered_search", f"WITH {LIVING_SQL}, {bm25_sql(TERMS, True, chunks='living')} SELECT layer, doc_id, round(score, 6) AS score FROM scored")
def k3_layers(spark, sf_dir):
    """The statistics of each layer are those of its living chunks."""
    store = library(spark, sf_dir)
    manifest = store.current()
    found = postings.bm25(ingest.search_index(store, manifest), asked(spark, TERMS), "strict_groups")
    keys = ingest.all_rows(store, manifest, "documents").select("layer", "doc_id", "key")  # a living chunk's document is in its layer
    return found.join(keys, ["layer", "doc_id"]).select("layer", F.col("key").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query("i9_i10_enrichment", "SELECT vec_id, len(embedding)::INTEGER AS dim, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def i9(spark, sf_dir):
    """Vectors asked for in batches; the service reads them from what it is sent."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.to_json("embedding").alias("text"))
    folder = new_folder(spark)
    try:
        got = kept(enrichment.enrich(rows, lambda texts: [(i, json.loads(t)) for i, t in enumerate(texts)], 64, folder))
    finally:
        remove(spark, folder)
    return got.select(F.col("chunk_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))


@query("k11_changed_rows", "SELECT count(*) AS n FROM documents WHERE lang = 'de' AND text IS NOT NULL")
def k11(spark, sf_dir):
    """How many rows a comparison of trees leads to, when the German texts are another's: those in the nodes that differ, and of
    them the ones whose own hash the other side lacks."""
    one = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    other = one.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    nodes = address.differing(one, other)
    within = lambda rows: address.rows_hashed(rows).join(nodes.withColumnRenamed("name", "node"), F.substring("name", 1, address.DIGITS) == F.col("node"), "left_semi")
    return within(one).join(within(other), "name", "left_anti").agg(F.count("*").alias("n"))


@query("k10_stored_knn", f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT b.vec_id AS query_id, a.vec_id, {DOT_SQL} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {DOT_SQL} DESC, a.vec_id)::INTEGER AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0) WHERE rank <= 5""")
def k10(spark, sf_dir):
    """The vectors are stored by cluster and searched with bounds."""
    e = read(spark, sf_dir, "embeddings")
    folder = new_folder(spark)
    try:
        found, _ = VectorStore(spark, folder).write(e).search(e.filter("vec_id % 20 = 0"), 5)
        found = kept(found)
    finally:
        remove(spark, folder)
    return found.withColumn("score", F.round("score", 6))
