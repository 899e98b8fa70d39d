"""Packing of tokenised documents into sequences by cutting-stock column generation.

Each document is cut into whole sequences and a rest. The rests' lengths, in classes of a few tokens, form a histogram of
bounded size. A linear program over cutting patterns of that histogram is solved by column generation, where a knapsack
dynamic program prices new patterns. Rounded patterns are dealt to the documents by their rank within their class, which
Spark computes in buckets, so neither documents nor lengths pass through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvane.llm.common import checkpointed, table
from corvane.llm.word_bpe import word_bpe

CAPACITY = 2048
#: Lengths of one class differ by less than this; a pattern keeps room for the longest.
CLASS_WIDTH = 8
END_ID = 1
#: Rows that are ranked together.
RANKED_TOGETHER = 2_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenises each text and cuts it at every capacity-th token. Null text is empty, so it has the end id alone."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = word_bpe(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(bpe.encode(text.as_py() or "") + end)
                n = len(ids) // 4
                out += [(doc, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_pattern(value: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The knapsack dynamic program: the most value that fits into units, and how many items of each size 1..units give it."""
    best, last = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    for room in range(1, units + 1):
        gains = value[1 : room + 1] + best[room - 1 :: -1][:room]
        k = int(np.argmax(gains))
        best[room], last[room] = (gains[k], k + 1) if gains[k] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    counts, room = np.zeros(units + 1, dtype=np.int64), units
    while room > 0:
        if last[room]:
            counts[last[room]] += 1
            room -= last[room]
        else:
            room -= 1
    return float(best[units]), counts


def cutting_stock(demand: np.ndarray, tolerance: float = 1e-3, most_rounds: int = 2_000) -> list[tuple[np.ndarray, int]]:
    """Patterns (items of each size) and how often to use each, so that all of demand, by size 1..units, is met exactly.

    Revised simplex on the covering program; it ends when the bound by the best pattern's price proves the sum of patterns
    within tolerance of the optimum, or within one sequence. Fractions are rounded down and what remains, a bounded number of items, is placed best-fit.
    """
    units = len(demand) - 1
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    columns = [np.where(np.arange(units + 1) == s, units // s, 0) for s in sizes]
    inverse = np.diag([1 / (units // s) for s in sizes])
    x = inverse @ demand[sizes].astype(float)
    for _ in range(most_rounds):
        price = np.zeros(units + 1)
        price[sizes] = np.maximum(inverse.sum(0), 0)
        worth, pattern = best_pattern(price, units)
        bound = x.sum() / worth  # no packing takes fewer
        if x.sum() - bound <= max(1.0, tolerance * bound):
            break
        step = inverse @ pattern[sizes]
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x, x[out] = x - ratio[out] * step, ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out] = pattern
    left, plan = demand.copy(), []
    for pattern, times in sorted(zip(columns, np.floor(x + 1e-9).astype(np.int64), strict=True), key=lambda p: -p[1]):
        used = pattern > 0
        if times > 0 and (times := int(min(times, (left[used] // pattern[used]).min()))) > 0:
            plan.append((pattern, times))
            left -= times * pattern
    return plan + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Fills one pattern after another with the largest items that still fit; equal patterns are counted."""
    left, plan = left.copy(), []
    while left.any():
        pattern, room = np.zeros_like(left), len(left) - 1
        while room and len(fits := np.flatnonzero(left[: room + 1])):
            s = int(fits[-1])
            n = int(min(left[s] - pattern[s], room // s))
            if n == 0:  # all of that size are in this pattern
                smaller = [t for t in fits[::-1] if left[t] > pattern[t]]
                if not smaller:
                    break
                s = int(smaller[0])
                n = int(min(left[s] - pattern[s], room // s))
            pattern[s] += n
            room -= n * s
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """Adds rank, from 0 without gaps within each class: rows are numbered in hashed buckets, and buckets follow one another.

    pieces are checkpointed, so a row's place in them is its own and stays: equal rows, and rows without an id, go to all buckets.
    """
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, n // RANKED_TOGETHER))))
    in_bucket = W.partitionBy("class", "bucket").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    before = W.partitionBy("class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = dealt.groupBy("class", "bucket").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return dealt.withColumn("row", F.row_number().over(in_bucket)).join(first, ["class", "bucket"]).withColumn("rank", F.col("first") + F.col("row") - 1).drop("bucket", "row", "first")


def assign(pieces: DataFrame, capacity: int = CAPACITY, width: int = CLASS_WIDTH) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most capacity tokens."""
    classed = pieces.withColumn("class", F.ceil(F.col("length") / width).cast("long"))
    demand = np.zeros(-(-capacity // width) + 1, dtype=np.int64)
    for c, n in classed.groupBy("class").count().collect():  # as many rows as classes at most
        demand[c] = n
    starts, firsts, takes, alone, sequence = [], [], [], [], 0
    reached = np.zeros_like(demand)
    for pattern, times in cutting_stock(demand):
        for c in np.flatnonzero(pattern)[::-1]:
            starts.append((int(c) << 40) + int(reached[c]))
            firsts.append(sequence)
            takes.append(int(pattern[c]))
            alone.append(pattern.sum() == 1)
            reached[c] += times * pattern[c]
        sequence += times
    order = np.argsort(np.array(starts, dtype=np.int64))
    starts, firsts, takes, alone = (np.array(a)[order] if a else np.array([0]) for a in (starts, firsts, takes, alone))

    @F.pandas_udf("sequence_id long, slot long, alone boolean")
    def place(classes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        key = (classes.to_numpy(dtype=np.int64) << 40) + ranks.to_numpy(dtype=np.int64)
        at = np.searchsorted(starts, key, "right") - 1
        behind = key - starts[at]
        return pd.DataFrame({"sequence_id": firsts[at] + behind // takes[at], "slot": behind % takes[at], "alone": alone[at].astype(bool)})

    placed = ranked(classed, int(demand.sum())).withColumn("place", place("class", "rank")).select(*pieces.columns, "class", "place.*")
    placed = checkpointed(placed)
    before = W.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(W.unboundedPreceding, -1)
    whole = placed.filter("alone").withColumn("offset", F.lit(0).cast("long"))
    shared = placed.filter("not alone").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return whole.unionByName(shared).drop("class", "slot", "alone")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, width: int = CLASS_WIDTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: one piece of the end id. An empty table: no rows. Repeated rows are documents of their own. Long
    texts give several pieces. A null doc_id is kept as null. Further columns of docs are not read.
    """
    return assign(checkpointed(cut_pieces(docs, vocabulary, capacity, end_id)), capacity, width)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The token ids of each sequence, in order: sequence_id, input_ids. doc_id must be unique in docs."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    @F.pandas_udf("array<long>")
    def ids(texts: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        bpe, end = word_bpe(path), np.array([end_id], dtype="<u4").tobytes()
        return pd.Series([np.frombuffer(bpe.encode(t or "") + end, dtype="<u4")[s : s + n].astype(np.int64) for t, s, n in zip(texts, start, length, strict=True)])

    pieces = packed.join(docs.select("doc_id", "text"), "doc_id").select("sequence_id", "offset", ids("text", "start", "length").alias("ids"))
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("input_ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
