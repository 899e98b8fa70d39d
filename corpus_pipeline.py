"""A training-data pipeline over documents: toxicity, exact copies, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Decisions are made for rows, not for ids:
toxicity and decontamination carry whole rows through their one pass, the exact stage decides by digest, id and length, the
near stage by id and text. So a text whose id repeats, or that has none, is judged for itself. Rows that are equal in id and
text are one document listed twice; the exact and the near stage keep one of them. Null and empty texts are texts like any
other; an empty table passes through all stages; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import checkpointed, forget, stored, table
from corvane.llm.decontaminate import COLUMNS, contamination, is_contaminated
from corvane.llm.exact_dedup import one_of_each, without_copies
from corvane.llm.packing import pack
from corvane.llm.simhash import near_duplicates
from corvane.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), carried=F.struct("*"))
    return scored.filter("predicted = 0").select("carried.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the longest original stays, then the smallest id."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near documents the smallest id stays; rows that agree in id and text are one document."""
    key = F.coalesce(F.sha2("text", 256), F.lit(""))
    decided = near_duplicates(docs.select("doc_id", "text", key.alias("key")), F.col("key")).filter("not kept")
    dropped = checkpointed(decided.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct())
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), key.alias("key"))
    rest = packed.join(dropped, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    own = F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "key"), 256)
    return one_of_each(rest.select("row", own.alias("key")), "key").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are in benchmark windows go."""
    own = [c for c in docs.columns if c in COLUMNS]  # columns of docs by the names that the search gives
    hidden = docs.withColumnsRenamed({c: f"{c} of docs" for c in own})
    found = contamination(hidden, table(spark, sf_dir, "benchmark")).filter(~is_contaminated())
    return found.select(*[F.col(f"`{c} of docs`" if c in own else f"`{c}`").alias(c) for c in docs.columns])


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_rest),
]
#: The toxicity classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables between stages are in the shared folder until the last stage has read them."""
    docs, places = table(spark, sf_dir, "documents"), []
    try:
        for _, stage in STAGES[:-1]:
            docs, place = stored(stage(spark, docs, sf_dir))
            places.append(place)
        return STAGES[-1][1](spark, docs, sf_dir)  # which has read them when it returns, as it keeps its own pieces
    finally:
        forget(spark, places)
