"""Labelled rows for the trained classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import checkpointed, fold

#: doc_id's crc32 modulo this is 0 for rows whose labels are never learnt from.
FOLDS = 5


def held_out() -> F.Column:
    """False also for a null id, which has no label to learn from."""
    return fold("doc_id", FOLDS) == 0


def training_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id, label: at most most labelled rows outside the held-out fold, chosen by a hash of the id. Repeated ids: the larger label."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
    once = usable.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return checkpointed(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, label, text: one row for each id of a sample of bounded size that docs have. Repeated ids: the greatest text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    return checkpointed(rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")))
