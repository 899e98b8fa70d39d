"""Exact de-duplication against a persistent digest index, with DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest. Each batch's digests are shuffled to the same buckets and meet it
by a sort-merge anti-join for which the index is not shuffled; digests it lacks are appended as new ones, the others as further
counts. Texts are compared after white space is deleted.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.common import checkpointed, exists, join_hot_safe, table

#: The characters that are deleted before texts are compared.
SPACE = " \t\n\x0b\x0c\r"
#: Digests for each bucket when an index is made.
BUCKET_ROWS = 2_000_000
MOST_BUCKETS = 4_096
#: first: the batch that brought the digest. Its row names the document that stays; later ones add to the group's size.
COLUMNS = "digest BINARY, keep_id BIGINT, keep_length INT, group_size BIGINT, first BOOLEAN"
#: Batches in which the query hands all documents to its index.
BATCHES = 2


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def length(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text, SHA-256 of the normalised text."""
    return docs.select("doc_id", length(F.col("text")).alias("length"), digest(F.col("text")).alias("digest"))


def rank(length: str, doc_id: str) -> Column:
    """The longest original text comes first, then the smallest id; null ids come last."""
    return F.struct((-F.col(length)).alias("shorter"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the first by rank stays."""
    best = rows.groupBy("digest").agg(F.min(rank("length", "doc_id")).alias("best"), F.count("*").alias("group_size"))
    return best.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.shorter")).alias("keep_length"), "group_size")


class DigestIndex:
    """A table of the digests seen so far, in the catalogue under name and, with path, at a place that later sessions reopen.

    It is partitioned by batch and bucketed by digest. A batch leaves one file for each bucket; where there are several, a
    join sorts its bucket anew, which compact() ends.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 16):
        if not re.fullmatch(r"\w+(\.\w+)?", name):
            raise ValueError(f"not a table name: {name}")
        self.spark, self.name = spark, name
        place = "LOCATION '{}'".format(path.replace("'", "\\'")) if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {place}")
        if path and exists(spark, path):
            spark.sql(f"MSCK REPAIR TABLE {name}")  # batches of earlier sessions
        self.buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Num Buckets"))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def batches(self) -> set[str]:
        return {r.partition.split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()}

    def append(self, groups: DataFrame, batch: str) -> bool:
        """Adds a batch's groups, which are checkpointed: by anti-join with the index those with a new digest as first ones,
        the others as updates, which carry their count and their best document. A batch that the index has is left as it is."""
        if batch in self.batches():
            return False
        known = self.rows().filter("first").select("digest").hint("merge")
        new, old = groups.join(known, "digest", "left_anti"), groups.join(known, "digest", "left_semi")
        both = new.withColumn("first", F.lit(True)).unionByName(old.withColumn("first", F.lit(False))).withColumn("batch", F.lit(batch))
        both = both.repartition(self.buckets, "digest").select(*self.rows().columns)
        both.write.format("parquet").partitionBy("batch").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)
        return True

    def of(self, groups: DataFrame | None = None, best: bool = False) -> DataFrame:
        """digest, keep_id, keep_length, group_size over all batches so far of the digests of groups (None: all that the
        index has), and n, their rows in groups. What the anti-join let in names the digests; updates add to it.

        best: of all batches the first document by rank stays, not that of the batch that brought the digest.
        """
        firsts = self.rows().filter("first").hint("merge")
        updates = self.rows().filter("not first").groupBy("digest").agg(F.min(rank("keep_length", "keep_id")).alias("better"), F.sum("group_size").alias("more"))
        if groups is not None:
            firsts = firsts.join(groups.select("digest", F.col("group_size").alias("n")), "digest")
        met = firsts.join(updates.hint("merge"), "digest", "left")
        kept = rank("keep_length", "keep_id")
        size = F.col("group_size") + F.coalesce("more", F.lit(0))
        one = met.select("digest", (F.least(kept, F.col("better")) if best else kept).alias("kept"), size.alias("group_size"), (F.col("n") if groups is not None else size).alias("n"))
        return one.select("digest", F.col("kept.doc_id").alias("keep_id"), (-F.col("kept.shorter")).alias("keep_length"), "group_size", "n")

    def compact(self, batch: str) -> None:
        """Makes all batches one of this name, with a file for each bucket: the first documents stay and counts are added up.
        Not beside a running append. The table moves to a place that the catalogue chooses; batch ids of before are forgotten."""
        fresh = f"{self.name}_{uuid.uuid4().hex}"
        merged = self.of().withColumn("first", F.lit(True)).withColumn("batch", F.lit(batch)).select(*self.rows().columns)
        merged.repartition(self.buckets, "digest").write.format("parquet").partitionBy("batch").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(fresh)
        self.drop()
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.name}")
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def answered(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    out = join_hot_safe(rows, found, "digest", "n", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """One row per document of a batch, compared with all that index has seen: doc_id, keep_id, group_size, kept, text_sha256.

    Texts that the index already holds lose to the document it names, and group_size counts the rows of all batches up to
    this one. A batch that is handed over again under its name adds nothing. Otherwise as dedup_exact().
    """
    rows = checkpointed(digests(docs))
    groups = checkpointed(grouped(rows))
    index.append(groups, batch)
    return answered(rows, checkpointed(index.of(groups)), rows.count())


def decided(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """digest, keep_id, keep_length, group_size, n of all digests of rows (doc_id, length, digest), through an index for this call.

    The rows go to the index in batches by a hash of the id, so that copies meet across them.
    """
    spark = rows.sparkSession
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", buckets=min(MOST_BUCKETS, max(8, rows.count() // BUCKET_ROWS)))
    try:
        for batch in range(batches):
            index.append(checkpointed(grouped(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch))), str(batch))
        return checkpointed(index.of(best=True))
    finally:
        index.drop()


def dedup_exact(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text equals empty text. Of equal texts the longest original stays, among ties the smallest doc_id; a null doc_id
    only if all are null. Rows that repeat a doc_id are one document listed twice: each gets the same answer. Further
    columns are ignored; an empty table gives no rows.
    """
    rows = checkpointed(digests(docs))
    return answered(rows, decided(rows), rows.count())


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """rows (row, key) with one row for each key, that with the least JSON. Only rows of keys that repeat are compared whole."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    twice = checkpointed(counts.filter("n > 1"))
    total = twice.agg(F.sum("n")).first()[0]
    if total is None:
        return rows
    met = join_hot_safe(rows, twice, key, "n", total, "left")
    # an order of its own, as a row may hold a map, which none is defined for
    best = met.filter("n is not null").groupBy(key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return met.filter("n is null").select("row", key).unionByName(best.select("row", key))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs, with its columns, where of equal texts the longest original stays, among ties the smallest doc_id, in one row.

    All is decided for ids, lengths and digests; whole rows, packed so that no name of theirs matters, are read and shuffled
    once, to take away those that lost. Of rows that agree in id and text the one with the least JSON stays.
    """
    rows = checkpointed(digests(docs))
    met = join_hot_safe(rows, decided(rows), "digest", "n", rows.count())
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    gone = checkpointed(met.filter(~stays).select(F.col("doc_id").alias("gone_id"), F.col("length").alias("gone_length"), F.col("digest").alias("gone_digest")).distinct())
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("digest"), length(F.col("text")).alias("length"))
    lost = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")) & (F.col("length") == F.col("gone_length"))
    return one_of_each(packed.join(gone, lost, "left_anti").select("row", "digest"), "digest").select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"))


def exact_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as three batches that follow one another: for each document its batch's answer at that time."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.col("doc_id") % 3, F.lit(0)).alias("batch"))
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", buckets=8)
    try:
        parts = [checkpointed(dedup_batch(docs.filter(F.col("batch") == b), index, str(b)).withColumn("batch", F.lit(b).cast("long"))) for b in range(3)]
    finally:
        index.drop()
    return reduce(DataFrame.unionByName, parts)


EXACT_INCREMENTS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id % 3, 0) AS batch, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, count(*) OVER (PARTITION BY h ORDER BY batch) AS group_size, first_value(doc_id) OVER (PARTITION BY h ORDER BY batch, n DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256, batch FROM r
"""
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS group_size, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
