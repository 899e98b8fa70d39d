"""Quality by naive Bayes support vectors: n-gram indicators times class log-count ratios, then a linear hinge-loss model.

Indicators of hashed unigrams and bigrams are weighted by the log ratio of their counts in the two classes of a bounded
labelled sample. A support vector machine is fitted to them by dual coordinate descent; its margin is mapped to (0, 1) by a
logistic curve fitted on sample rows it has not seen. All documents are scored in one pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import checkpointed, table
from corvane.llm.labels import held_out, labelled_texts, training_labels

#: Labelled rows that are learnt from at most, and n-grams of all of them together, which are held by the driver.
SAMPLE, MOST_GRAMS = 8_000, 16_000_000
HASHES = 1 << 18
COST, ROUNDS, SMOOTHING = 1.0, 12, 1.0
#: One in so many sample rows is kept for the logistic curve.
CALIBRATE = 4
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]")


def ngrams(text: str | None) -> np.ndarray:
    """Sorted hashes of the words and single signs of a text and of each two in a row."""
    tokens = TOKEN.findall((text or "").encode("utf-8", "replace").lower())
    one = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(11)
    return np.unique(np.concatenate([one, two]) % np.uint64(HASHES)).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    good, bad = (np.full(HASHES, SMOOTHING) for _ in range(2))
    for x, positive in zip(rows, y > 0, strict=True):
        (good if positive else bad)[x] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (last: bias) and duals of the hinge-loss machine over ratio-scaled indicators of unit length; cost bounds the duals."""
    scale = [ratio[x] / max(1e-9, np.sqrt((ratio[x] ** 2).sum())) for x in rows]
    weights, dual, rng = np.zeros(HASHES + 1), np.zeros(len(rows)), np.random.default_rng(9)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (weights[rows[i]] @ scale[i] + weights[-1]) - 1
            new = min(max(dual[i] - gradient / 2.0, 0.0), cost[i])  # squared length: 1 and the bias's 1
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                weights[rows[i]] += step * scale[i]
                weights[-1] += step
                moved, dual[i] = max(moved, abs(new - dual[i])), new
        if moved < 1e-3:
            break
    return weights, dual


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of most likelihood, by Newton's method with smoothed targets."""
    a, b = 1.0, 0.0
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - goal, np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hessian, [(g * margin).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return float(a), float(b)


class NbSvm:
    """The fitted model: table[n-gram] is ratio times weight."""

    def __init__(self, rows: list[np.ndarray], label: np.ndarray):
        y = np.where(label > 0, 1.0, -1.0)
        hold = np.arange(len(rows)) % CALIBRATE == 0
        if min((y[~hold] > 0).sum(), (y[~hold] < 0).sum(), (y[hold] > 0).sum(), (y[hold] < 0).sum()) == 0:
            hold = np.zeros(len(rows), dtype=bool)
        fit = [r for r, h in zip(rows, hold, strict=True) if not h]
        share = (y[~hold] > 0).mean()
        self.ratio = log_count_ratios(fit, y[~hold])
        weights, _ = dual_coordinate_descent(fit, y[~hold], self.ratio, np.where(y[~hold] > 0, COST / (2 * share), COST / (2 * (1 - share))))
        self.table, self.bias = self.ratio * weights[:-1], weights[-1]
        seen = hold if hold.any() else ~hold
        self.slope, self.shift = logistic(np.array([self.margin(r) for r, h in zip(rows, seen, strict=True) if h]), y[seen])

    def margin(self, x: np.ndarray) -> float:
        return self.table[x].sum() / max(1e-9, np.sqrt((self.ratio[x] ** 2).sum())) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30))))


def learnt_rows(docs: DataFrame, labels: DataFrame, most: int, most_grams: int = MOST_GRAMS) -> tuple[list[np.ndarray], np.ndarray]:
    """n-grams and labels of at most most labelled rows, in the order of a hash of their ids, until they have most_grams n-grams."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngrams(t.as_py()).astype(np.int32) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["doc_id", "label", "n", "grams"])

    texts = labelled_texts(docs, training_labels(labels, "quality", most))
    rows = checkpointed(texts.mapInArrow(hashed, "doc_id long, label int, n long, grams binary")).withColumn("at", F.xxhash64("doc_id"))
    sizes, held, last = rows.select("at", "n").collect(), 0, None  # at most most pairs of numbers
    for r in sorted(sizes):
        if (held := held + r.n) > most_grams:
            break
        last = r.at
    got = sorted(rows.filter(F.col("at") <= F.lit(last)).select("doc_id", "label", "grams").collect()) if last is not None else []
    return [np.frombuffer(r.grams, dtype=np.int32).astype(np.int64) for r in got], np.array([r.label for r in got])


def score_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no n-grams and get the bias's score. If the sample has one class alone, the score is its
    label; 0 without any labelled row. Rows that repeat get the same score; of a labelled id that repeats, the greatest text
    by order is learnt from. Further columns are ignored; an empty table gives no rows.
    """
    rows, label = learnt_rows(docs, labels, most)
    model = NbSvm(rows, label) if len(set(label.tolist())) > 1 else None
    constant = float(label[0] > 0) if len(label) else 0.0

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(ngrams(t.as_py())) if model else constant for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
