"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learnt from a bounded sample of labelled texts and joined with a short list of common insults. One pass over
all texts measures lexicon densities, nearness to second-person words, capitals, punctuation and obfuscation. Spark's
boosted trees learn from the sample's features; its isotonic regression calibrates them on rows that the trees have not seen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from corvane.llm.common import BREAKS, TO_SPACE, checkpointed, table
from corvane.llm.labels import held_out, labelled_texts, training_labels

#: Labelled rows that are learnt from at most.
SAMPLE = 20_000
#: A word is in the lexicon if toxic rows have it more often than their share explains, by this log-likelihood ratio, which
#: chance gives to about one word in a million.
SURPRISE, MOST_WORDS = 24.0, 500
#: The log odds of an insult that the sample lacks.
INSULT_WEIGHT = 4.0
INSULTS = ("idiot", "idiots", "stupid", "moron", "morons", "dumb", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "fool", "imbecile", "cretin", "jerk", "vermin", "filth")
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos usted ustedes tú tus ti vosotros".split())
#: Words to either side in which a second-person word counts as near.
NEAR = 5
LOOKALIKES = bytes.maketrans(b"013457@$!", b"oieastasi")
SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")
REPEATED = re.compile(rb"[!?]{2,}")
CAPITALS = bytes(range(0x41, 0x5B))
PUNCTUATION = bytes(b for b in BREAKS if b > 0x20 and not 0x41 <= b <= 0x5A)
FEATURES = ("lexicon_most", "lexicon_sum", "lexicon_density", "lexicon_count", "lexicon_kinds", "insult_density", "disguised_density", "near_density", "second_density", "capitals", "shouted", "punctuation", "repeated", "obfuscation", "length")
LABELLED_SPLIT = 3
#: What disguised words are made of, and what stands for letters in them.
MARKS = b"0123456789@$!*"
TO_RUNS = bytes(b if 0x61 <= b <= 0x7A or b in MARKS else 0x20 for b in range(256))


def disguised_words(low: bytes) -> list[bytes]:
    """Runs of letters and marks that begin with a letter, @ or $, end with a letter and have a mark between."""
    runs = (w.lstrip(b"0123456789!*").rstrip(MARKS) for w in low.translate(TO_RUNS).split() if not w.isalpha())
    return [w for w in runs if len(w) > 1 and not w[1:].isalpha()]


def measure(text: str | None, lexicon: dict[bytes, float], insults: frozenset[bytes]) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    low = (text or "").lower().encode("utf-8", "replace")
    words = low.translate(TO_SPACE).split()
    hits = [i for i, w in enumerate(words) if w in lexicon]
    kinds = {words[i] for i in hits}
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    odd = disguised_words(low)
    disguised = sum(w not in lexicon and (w.translate(LOOKALIKES, b"*") in lexicon) for w in odd)
    capitals, punctuation = len(raw) - len(raw.translate(None, CAPITALS)), len(raw) - len(raw.translate(None, PUNCTUATION))
    n, size = len(words) + 1, len(raw) + 1
    return [
        max((lexicon[w] for w in kinds), default=0.0), sum(lexicon[w] for w in kinds), 100 * len(hits) / n, math.log1p(len(hits)), float(len(kinds)), 100 * sum(words[i] in insults for i in hits) / n,
        100 * disguised / n, 100 * near / n, 100 * len(second) / n, capitals / size, 100 * len(SHOUTED.findall(raw)) / n if capitals > 2 else 0.0,
        punctuation / size, 100 * len(REPEATED.findall(raw)) / n, 100 * len(odd) / n, math.log(n),
    ]


def features(docs: DataFrame, lexicon: dict[str, float], carried: Column | None = None) -> DataFrame:
    """doc_id, carried, features; the lexicon has MOST_WORDS words at most, besides the insults."""
    insults = frozenset(w.encode() for w in INSULTS)
    words = {w: INSULT_WEIGHT for w in insults} | {w.encode(): weight for w, weight in lexicon.items()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), words, insults) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "carried", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if carried is None else carried).alias("carried"), "text")
    return rows.mapInArrow(of, StructType([*rows.schema.fields[:2], StructField("features", ArrayType(DoubleType()))]))


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words that occur in far more toxic rows of the sample (label, text) than its share of toxic rows explains, and their log odds."""
    words = labelled.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("word"))
    rows, toxic = labelled.agg(F.count("*"), F.sum("label")).first()
    share = (toxic or 0) / max(1, rows)
    counted = words.filter("word <> ''").groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).filter(F.col("toxic") > F.col("n") * share)
    part = lambda k, expected: F.when(k > 0, k * F.log(k / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)
    surprise = 2 * (part(F.col("toxic"), F.col("n") * share) + part(F.col("n") - F.col("toxic"), F.col("n") * (1 - share)))
    found = counted.withColumn("surprise", surprise).filter(F.col("surprise") >= SURPRISE).orderBy(F.desc("surprise"), "word").limit(MOST_WORDS).collect()
    return {r.word: math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.n - r.toxic + 0.5) / (rows - toxic + 1)) for r in found}


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, carried: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and carried, an expression over docs, if it is given.

    The sample's rows are measured first, so all documents are read, measured and scored in one pass that shuffles nothing.
    Null and empty texts are scored by their features, all near zero. If the sample lacks toxic or clean rows the score is
    the share of toxic rows, 0 without any. Rows that repeat get the same score; of a labelled id that repeats, the greatest
    text by order is learnt from. Labels of unknown ids, null labels and labels of the held-out fold are not used. Further
    columns are ignored; an empty table gives no rows.
    """
    labelled = labelled_texts(docs, training_labels(labels, "toxic", most))
    lexicon = learn_lexicon(labelled)
    known = features(labelled, lexicon, F.col("label")).select("doc_id", F.col("carried").alias("label"), array_to_vector("features").alias("features"), F.pmod(F.xxhash64("doc_id"), F.lit(LABELLED_SPLIT)).alias("part"))
    known = checkpointed(known.orderBy("doc_id").coalesce(2)).cache()  # in an order of its own, so that the trees are the same each time
    counts = {(r.part > 0, r.label): r["count"] for r in known.groupBy("part", "label").count().collect()}
    positive, total = (sum(n for (_, y), n in counts.items() if y or not only) for only in (True, False))
    score = F.lit(positive / total if total else 0.0)
    if all((True, y) in counts for y in (0, 1)):
        rows = features(docs, lexicon, carried).withColumn("features", array_to_vector("features"))
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, maxBins=128, seed=8, minInstancesPerNode=8).fit(known.filter("part > 0"))
        rows = trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
        score = F.col("raw")
        if all((False, y) in counts for y in (0, 1)):
            unseen = trees.transform(known.filter("part = 0")).select(vector_to_array("probability")[1].alias("raw"), F.col("label").cast("double").alias("label"))
            steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="step").fit(unseen)
            rows = steps.transform(rows)
            score = 0.99 * F.col("step") + 0.01 * F.col("raw")  # the trees' order within a step stays
    else:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if carried is None else carried).alias("carried"))
    known.unpersist()
    out = rows.select("doc_id", "carried", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), F.lit(0.0)).alias("score"))
    more = [] if carried is None else ["carried"]
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
