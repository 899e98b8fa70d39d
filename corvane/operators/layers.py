"""Layers of a growing corpus: a base and ordered deltas, tombstones, identities, keyed writes and id assignment."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.functions import text as T
from corvane.operators.storage import kept


def stacked(layers: list[DataFrame]) -> DataFrame:
    """All rows, with layer 0 for the base, 1.. for the deltas; columns that a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("layer", F.lit(i).cast("long")) for i, df in enumerate(layers)])


def effective(rows: DataFrame, tombstones: DataFrame, id_col: str) -> DataFrame:
    """rows without those whose id a tombstone names."""
    return rows.join(tombstones.select(F.col("entity_id").alias(id_col)), id_col, "left_anti")


def repeated_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).count().filter("count > 1")


def newest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, then new: no window, as new has each key once."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    return old.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new)


def update_by_key(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    c = changes.select(key, F.col(column).alias("_new"))
    return rows.join(c, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def classify(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming (key, digest) against known (key, digest): action, and whether the digest is known under another key."""
    k = known.select("key", F.col("digest").alias("known_digest"))
    other = known.groupBy("digest").agg(F.min("key").alias("_low"), F.max("key").alias("_high"))
    both = incoming.join(k, "key", "left").join(other, "digest", "left")
    action = F.when(F.col("known_digest").isNull(), "NEW").when(F.col("known_digest") == F.col("digest"), "DUPLICATE_UNCHANGED").otherwise("UPDATE")
    elsewhere = F.coalesce((F.col("_low") != F.col("key")) | (F.col("_high") != F.col("key")), F.lit(False))
    return both.select("key", "digest", action.alias("action"), elsewhere.alias("known_elsewhere"))


def assign_ids(rows: DataFrame, first: int, order: list[str], bucket_rows: int = 100_000) -> DataFrame:
    """vector_id from first on, without gaps, in order: rows are ranged and numbered by range, so no task numbers all."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    rows = kept(rows)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    sizes = rows.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.join(F.broadcast(sizes), "_part").withColumn("vector_id", F.col("_before") + F.col("_at") + first).drop("_part", "_at", "_before")


def placed(rows: DataFrame) -> DataFrame:
    """rows with _part and _at, their places in the files that they are about to be written to."""
    return rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))


def ids_by_place(stored: DataFrame, first: int) -> DataFrame:
    """stored, as placed() gave it and as it was written, with vector_id from first on, without gaps, in order of places. Only the
    sizes of parts are added up and sent, so rows of any width stay where they are."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    sizes = kept(stored.groupBy("_part").count()).withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return stored.join(F.broadcast(sizes), "_part").withColumn("vector_id", F.col("_before") + F.col("_at") + first).drop("_part", "_at", "_before")


def tombstones_for(updated: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """entity_type, entity_id for the old version, chunks and vectors of updated documents (doc_id)."""
    docs = updated.select("doc_id").distinct()
    old = chunks.join(docs, "doc_id", "left_semi")
    parts = [versions.join(docs, "doc_id", "left_semi").select(F.lit("doc_version").alias("entity_type"), F.col("version_id").cast("string").alias("entity_id")), old.select(F.lit("chunk"), F.col("chunk_id").cast("string")), old.filter("vector_id is not null").select(F.lit("vector"), F.col("vector_id").cast("string"))]
    return reduce(DataFrame.union, parts).distinct()


def name_key(path: Column) -> Column:
    """The file's name as an identity: composed form, case folded."""
    return T.mapped(F.regexp_extract(path, r"([^/\\]+)$", 1), lambda n: unicodedata.normalize("NFC", unicodedata.normalize("NFC", n).casefold()))


def legacy_identities(documents: DataFrame) -> DataFrame:
    """documents (doc_id, path, digest) to one row for each name key: key, n, doc_id, digest, collides.

    A key that several documents share collides, which is an error to whoever loads them; the row shows the smallest id.
    """
    named = documents.withColumn("key", name_key(F.col("path")))
    one = named.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest")).alias("first"))
    return one.select("key", "n", "first.doc_id", "first.digest", (F.col("n") > 1).alias("collides"))


def checked_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, block_index, text, vector_id, ...) that may enter a delta, and those refused with their first fault."""
    wrong = lambda c: F.col(c).isNull() | (F.col(c) < 0)
    fault = F.when(F.col("doc_id").isNull(), "no document").when(wrong("block_index"), "block index").when(T.strip(F.coalesce("text", F.lit(""))) == "", "no text").when(wrong("vector_id"), "vector id")
    checked = rows.withColumn("fault", fault)
    return checked.filter("fault is null").drop("fault"), checked.filter("fault is not null")


def insert_checked(rows: DataFrame, folder: str) -> DataFrame:
    """Appends the rows that may enter to a delta's folder and gives the refused ones."""
    good, refused = checked_rows(rows)
    good.write.mode("append").parquet(folder)
    return refused
