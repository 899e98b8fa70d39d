"""Micro-batch ingestion: each batch becomes one delta layer of documents, chunks, postings, vectors, failures and tombstones,
published once by a compare-and-swap. Layers are never changed; a compaction writes a new base, a cleanup deletes what no
manifest names any more."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import ids, text as T
from corvane.operators import chunking, postings, structure
from corvane.operators.address import address
from corvane.operators.layers import classify, ids_by_place, newest, placed
from corvane.operators.storage import kept
from corvane.plans.manifest import Layer, Manifest, ManifestStore
from corvane.sources import files

#: What a layer consists of; the index lies beside.
TABLES = {
    "documents": "key string, text string, digest string, doc_id string, version_id string",
    "chunks": "doc_id string, chunk_index long, chunk_id string, text string, vector_id long",
    "vectors": "chunk_id string, vector_id long, embedding array<float>",
    "failures": "key string, doc_id string, error string",
    "tombstones": "entity_type string, entity_id string",
}
KINDS = {"doc_version": ("documents", "version_id"), "chunk": ("chunks", "chunk_id"), "vector": ("vectors", "vector_id")}

#: doc_id, text to doc_id, chunk_index, text.
Chunker = Callable[[DataFrame], DataFrame]
#: chunk_id, text to chunk_id, embedding.
Embedder = Callable[[DataFrame], DataFrame]


def structured_chunks(docs: DataFrame) -> DataFrame:
    """A text's paragraphs, annotated with their structure and packed into chunks."""
    blocks = files.paragraphs(docs).withColumnRenamed("paragraph", "block_index")
    packed = chunking.build_chunks(structure.drop_heading_runs(structure.section_paths(blocks)))
    return packed.select("doc_id", "chunk_index", F.col("chunk_text").alias("text"))


def whole_texts(docs: DataFrame) -> DataFrame:
    """A chunk for each text that is not blank."""
    return docs.filter(T.strip(F.coalesce("text", F.lit(""))) != "").select("doc_id", F.lit(0).cast("long").alias("chunk_index"), "text")


def versioned(rows: DataFrame) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    doc = ids.incremental_doc_id(F.col("key"))
    return rows.select("key", "text", digest.alias("digest"), doc.alias("doc_id"), ids.version_id(doc, digest).alias("version_id"))


def active(rows: DataFrame) -> DataFrame:
    """The newest version of each key over all layers."""
    return newest(rows, "key", [F.desc("layer"), F.asc("version_id")])


def initialise(spark: SparkSession, root: str, rows: DataFrame, chunker: Chunker = structured_chunks, embed: Embedder | None = None) -> ManifestStore:
    """Writes the base layer and the first manifest. rows: key, text."""
    store = ManifestStore(spark, root)
    digest, following = write_layer(store, "base", versioned(rows), empty(spark, "tombstones"), 0, chunker, embed)
    store.publish(Manifest(1, Layer("base", "base", digest), (), following), 0)
    return store


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def write_layer(store: ManifestStore, path: str, docs: DataFrame, dead: DataFrame, first_vector: int, chunker: Chunker, embed: Embedder | None) -> tuple[str, int]:
    """The layer's content address and the next vector id. docs as versioned(), a row for each doc_id; those that give no chunk are
    failures. Texts are written as chunks and as documents and are neither sorted nor dealt here; docs is read several times."""
    spark, folder = store.spark, f"{store.root}/{path}"
    write = lambda df, name: df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
    read = lambda name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
    found = chunker(docs.select("doc_id", "text"))
    placed(found.withColumn("chunk_id", ids.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")))).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/cut")
    write(ids_by_place(spark.read.parquet(f"{folder}/cut"), first_vector), "chunks")
    postings.remove(spark, f"{folder}/cut")
    chunks = read("chunks")
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    told = docs.select("key", "doc_id", F.when(blank, "EMPTY_TEXT").otherwise("NO_CHUNKS").alias("error"))
    write(told.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti"), "failures")
    failed = read("failures").select("doc_id")
    write(docs.join(few(failed), "doc_id", "left_anti"), "documents")
    vectors = empty(spark, "vectors") if embed is None else embed(chunks.select("chunk_id", "text")).join(chunks.select("chunk_id", "vector_id"), "chunk_id")
    write(vectors, "vectors")
    postings.remove(spark, f"{folder}/index")  # of an attempt that did not come to its end
    postings.write_index(chunks.select(F.lit(0).cast("long").alias("layer"), "vector_id", "text"), "vector_id", ["text"], f"{folder}/index")
    write(dead.join(few(failed), "doc_id", "left_anti") if "doc_id" in dead.columns else dead, "tombstones")
    following = chunks.agg(F.max("vector_id")).first()[0]
    return layer_address(store, path), first_vector if following is None else following + 1


def few(rows: DataFrame) -> DataFrame:
    """rows, stored ones of few columns, to be sent whole where they are few."""
    return F.broadcast(rows) if rows.count() <= postings.MOST_BROADCAST else rows


def layer_address(store: ManifestStore, path: str) -> str:
    """Merkle roots of all tables of a layer as one digest."""
    roots = [f"{name}:{address(store.spark.read.schema(schema).parquet(f'{store.root}/{path}/{name}'))}" for name, schema in sorted(TABLES.items())]
    return hashlib.sha256("\n".join(roots).encode()).hexdigest()


def tampered(store: ManifestStore, manifest: Manifest) -> list[str]:
    """The layers whose tables are not what the manifest says. An implicit base says nothing."""
    return [x.layer_id for x in manifest.layers if x.digest != "0" * 64 and layer_address(store, x.path) != x.digest]


def ingest_batch(store: ManifestStore, batch: DataFrame, name: str, chunker: Chunker = structured_chunks, embed: Embedder | None = None) -> Manifest:
    """New and changed documents of a batch (key, text) as one delta, with tombstones of the versions, chunks and vectors that they
    replace. Of rows that share a key one counts. A document that gives no chunk is a failure, and its old version lives on. A
    batch that was published before is not published again; one that lost the race starts again from the new revision.
    """
    manifest = store.current()
    if any(x.layer_id == name for x in manifest.deltas):
        return manifest
    every = versioned(batch)
    incoming = kept(every.groupBy("key").agg(F.min(F.struct("version_id", "digest", "doc_id")).alias("v"), F.count("*").alias("rows")).select("key", "v.*", "rows"))
    # only what the batch may replace is met: rows of its keys, without their texts
    known = kept(living(store, manifest).select("key", "digest", "doc_id", "version_id").join(incoming.select("key"), "key", "left_semi"))
    taken = kept(classify(incoming.select("key", "digest"), known.select("key", "digest")).filter("action <> 'DUPLICATE_UNCHANGED'").select("key", "action"))
    updated = known.join(taken.filter("action = 'UPDATE'"), "key", "left_semi").select("doc_id")
    docs = texts_of(every, incoming, taken, f"{store.root}/{name}/taken")
    digest, following = write_layer(store, name, docs, dead_of(store, manifest, updated), manifest.next_vector_id, chunker, embed)
    postings.remove(store.spark, f"{store.root}/{name}/taken")
    return store.publish(Manifest(manifest.revision + 1, manifest.base, (*manifest.deltas, Layer(name, name, digest)), following), manifest.revision)


def texts_of(every: DataFrame, incoming: DataFrame, taken: DataFrame, folder: str) -> DataFrame:
    """One row of every for each key of taken, of the version that counts. Keys that are left out and those of several rows are
    mostly few: then the other texts stay where they are. Else texts meet the keys once, and the result is stored in folder."""
    left = kept(incoming.select("key").join(taken.select("key"), "key", "left_anti"))
    several = kept(incoming.filter("rows > 1").select("key").join(taken.select("key"), "key", "left_semi"))
    if left.count() + several.count() <= postings.MOST_BROADCAST:
        plain = every.filter("key is not null").join(F.broadcast(left.unionByName(several)), "key", "left_anti")
        return plain.unionByName(newest(every.join(F.broadcast(several), "key", "left_semi"), "key", [F.asc("version_id")]))
    newest(every.join(taken.select("key"), "key", "left_semi"), "key", [F.asc("version_id")]).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return every.sparkSession.read.schema(TABLES["documents"]).parquet(folder)


def delete(store: ManifestStore, keys: DataFrame, name: str) -> Manifest:
    """A delta that takes the documents of keys (key) away and brings none."""
    manifest = store.current()
    gone = living(store, manifest).join(keys.select("key").distinct(), "key", "left_semi").select("doc_id")
    dead = dead_of(store, manifest, gone).select("entity_type", "entity_id")
    digest, following = write_layer(store, name, empty(store.spark, "documents"), dead, manifest.next_vector_id, whole_texts, None)
    return store.publish(Manifest(manifest.revision + 1, manifest.base, (*manifest.deltas, Layer(name, name, digest)), following), manifest.revision)


def dead_of(store: ManifestStore, manifest: Manifest, gone: DataFrame) -> DataFrame:
    """doc_id, entity_type, entity_id: the living versions, chunks and vectors of documents (doc_id)."""
    chunks = living(store, manifest, "chunks").join(gone, "doc_id", "left_semi")
    versions = living(store, manifest).join(gone, "doc_id", "left_semi")
    vectors = living(store, manifest, "vectors").select("vector_id").join(chunks.select("doc_id", "vector_id"), "vector_id")
    named = lambda rows, kind: rows.select("doc_id", F.lit(kind).alias("entity_type"), F.col(KINDS[kind][1]).cast("string").alias("entity_id"))
    return kept(named(versions, "doc_version").unionByName(named(chunks, "chunk")).unionByName(named(vectors, "vector")).distinct())


def tombstones(store: ManifestStore, manifest: Manifest) -> DataFrame:
    """entity_type, entity_id, layer of all layers."""
    return all_rows(store, manifest, "tombstones")


def all_rows(store: ManifestStore, manifest: Manifest, table: str) -> DataFrame:
    """A table of all layers, with layer 0 for the base. A layer without it, as an implicit base may be, has no rows of it."""
    parts = []
    for i, x in enumerate(manifest.layers):
        there = store.fs.exists(store.path(f"{x.path}/{table}"))
        rows = store.spark.read.schema(TABLES[table]).parquet(f"{store.root}/{x.path}/{table}") if there else empty(store.spark, table)
        parts.append(rows.withColumn("layer", F.lit(i).cast("long")))
    return reduce(DataFrame.unionByName, parts)


def living(store: ManifestStore, manifest: Manifest, table: str = "documents") -> DataFrame:
    """Rows of all layers without those that a tombstone of a higher layer names; no key is ranked for that. What was
    replaced and comes back later lives again."""
    kind, key = next((k, c) for k, (t, c) in KINDS.items() if t == table)
    rows = all_rows(store, manifest, table)
    dead = tombstones(store, manifest).filter(F.col("entity_type") == kind).select(F.col("entity_id"), F.col("layer").alias("by"))
    return rows.join(dead, (rows[key].cast("string") == dead["entity_id"]) & (dead["by"] > rows["layer"]), "left_anti")


def search_index(store: ManifestStore, manifest: Manifest) -> postings.LayeredIndex:
    """The segments of all layers as one index of living chunks. Its postings know chunks by their vector ids; what is found has
    chunk_id and doc_id."""
    chunks = all_rows(store, manifest, "chunks").select("layer", "vector_id", "chunk_id", "doc_id")
    dead = tombstones(store, manifest).filter("entity_type = 'chunk'").select(F.col("entity_id").alias("chunk_id"), F.col("layer").alias("by"))
    dead = chunks.join(dead, "chunk_id").filter("by > layer").groupBy("vector_id").agg(F.max("by").alias("layer"))
    return postings.LayeredIndex([postings.Index(store.spark, f"{store.root}/{x.path}/index", "vector_id") for x in manifest.layers], dead, chunks)


def compact(store: ManifestStore, name: str) -> Manifest:
    """All that lives as a new base without deltas; readers of older revisions keep theirs until a cleanup."""
    manifest = store.current()
    folder = f"{store.root}/{name}"
    for table in TABLES:
        rows = empty(store.spark, table) if table in ("failures", "tombstones") else living(store, manifest, table).drop("layer")
        rows.write.mode("overwrite").parquet(f"{folder}/{table}")
    postings.remove(store.spark, f"{folder}/index")
    search_index(store, manifest).merged(f"{folder}/index")
    return store.publish(Manifest(manifest.revision + 1, Layer(name, name, layer_address(store, name)), (), manifest.next_vector_id), manifest.revision)


def clean(store: ManifestStore, revisions: int, older_than: float = 3600.0) -> list[str]:
    """Deletes manifests but the last revisions ones, and layers that none of these names; gives their paths. Layers younger than
    older_than seconds stay, as a publish that is under way has written them before its manifest."""
    kept_revisions = store.revisions()[-max(1, revisions) :]
    named = {x.path for r in kept_revisions for x in store.at(r).layers}
    gone = []
    for status in store.fs.listStatus(store.path("manifest").getParent()):
        name = status.getPath().getName()
        if status.isDirectory() and name != "manifest" and name not in named and time.time() - status.getModificationTime() / 1000 >= older_than:
            gone.append(name)
    for r in store.revisions():
        if r < kept_revisions[0]:  # first, so that nobody finds a manifest without its layers
            store.fs.delete(store.path(f"manifest/{r:012d}.json"), False)
    for name in gone:
        store.fs.delete(store.path(name), True)
    return sorted(gone)


def ingest_stream(store: ManifestStore, stream: DataFrame, checkpoint: str, chunker: Chunker = structured_chunks, embed: Embedder | None = None) -> StreamingQuery:
    """Runs through what has arrived and stops. stream: key, text."""
    take = lambda batch, number: ingest_batch(store, batch, f"delta-{number:06d}", chunker, embed)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(rows: DataFrame, days: int, now: str, kept_states: tuple[str, ...] = ("FAILED", "RUNNING")) -> DataFrame:
    """rows (state, updated_at) that a cleanup at now would keep: younger than days, or in a state that is always kept."""
    return rows.filter(F.col("state").isin(*kept_states) | (F.col("updated_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")))
