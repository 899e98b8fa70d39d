"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is three segments of at most 23 bits. The perfect binary Golay code has exactly one codeword within
three bits of every 23-bit word. A segment's keys are the codewords of itself and of its one-bit neighbours, six at most;
if two segments differ in at most one bit, each one's own codeword is among the other's keys. Fingerprints at most three
bits apart differ in at most one bit in two of the three segments, so they meet under a pair of keys. Those that meet are
compared; links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.common import checkpointed, forget, join_counted, join_hot_safe, stored, table
from corvane.llm.components import connected_components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
#: Fingerprints that are compared in one block.
BLOCK = 4_096
#: Crowded keys that are broadcast, of 16 bytes each; if there are more, keys meet their rows by a shuffle.
MOST_BROADCAST = 100_000
#: Shingles hashed at a time.
HASHED = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_digest, max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, n, HASHED):
        end = min(n, begin + HASHED)
        shingles = map(b" ".join, zip(*(words[begin + i : end + i] for i in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(words)]
        raw = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, row_key, fp: the fingerprint as a signed long. Null and blank texts have fingerprint 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())], names=["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit("") if key is None else key.cast("string")).alias("row_key"), "text")
    return rows.mapInArrow(of, "doc_id long, row_key string, fp long")


def remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= ((words >> bit) & 1) * (GENERATOR << (bit - 11))
    return words


def error_table() -> np.ndarray:
    """For each remainder the error of at most three bits that has it."""
    errors = np.array([sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(23), k)], dtype=np.int64)
    at = np.zeros(2048, dtype=np.int64)
    at[remainder(errors)] = errors
    return at


def codewords(segment: np.ndarray, bits: int, errors: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords of each segment, first column, and of its one-bit neighbours; -1 where one repeats."""
    own = remainder(segment)
    flips = np.array([0, *(1 << b for b in range(bits))], dtype=np.int64)
    found = (segment[:, None] ^ flips ^ errors[own[:, None] ^ remainder(flips)]) >> 11
    first, rest = found[:, :1], np.sort(found[:, 1:], axis=1)
    rest[:, 1:][rest[:, 1:] == rest[:, :-1]] = -1
    rest[rest == first] = -1
    return np.concatenate([first, rest], axis=1)


def keyed(fps: DataFrame) -> DataFrame:
    """fp to its rows (key, fp): for each two segments, the own codeword of one with every key of the other, both ways."""
    errors = error_table()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 8_192):
                fp = whole.column(0).slice(begin, 8_192).to_numpy(zero_copy_only=False).astype(np.int64)
                bits = fp.view(np.uint64)
                codes = [codewords(((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64), n, errors) for low, n in SEGMENTS]
                key, of = [], []
                for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
                    a, b = codes[i], codes[j]
                    for left, right, kept in ((a[:, :1], b, b >= 0), (a[:, 1:], b[:, :1], a[:, 1:] >= 0)):
                        key.append(((pair << 24) | (left << 12) | right)[kept])
                        of.append(np.broadcast_to(fp[:, None], kept.shape)[kept])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key), pa.int32()), pa.array(np.concatenate(of), pa.int64())], names=["key", "fp"])

    return fps.select("fp").mapInArrow(keys, "key int, fp long")


def near(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= MOST_BITS


def star_links(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join the same fingerprints as all near pairs do: a search from the first unseen one, over unseen ones only."""
    unseen, a, b = np.sort(fps), [], []
    while len(unseen):
        root, queue, unseen = unseen[0], [unseen[0]], unseen[1:]
        while queue and len(unseen):
            hit = near(unseen, queue.pop())
            if hit.any():
                found, unseen = unseen[hit], unseen[~hit]
                queue += list(found)
                a.append(np.full(len(found), root))
                b.append(found)
    return a, b


def linked(rows: DataFrame) -> DataFrame:
    """Rows dealt and sorted by (key, block) to links (a, b) within each (key, block)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: list, b: list) -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

        def within(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
            size, a, b = end - begin, [], []
            small = np.repeat(size <= 8, size)
            group = np.repeat(np.arange(len(size)), size)
            for d in range(1, min(8, len(fp))):
                hit = small[d:] & (group[d:] == group[:-d]) & near(fp[d:], fp[:-d])
                a.append(fp[:-d][hit])
                b.append(fp[d:][hit])
            for k in np.flatnonzero(size > 8):
                x, y = star_links(fp[begin[k] : end[k]])
                a += x
                b += y
            return out(a, b)

        key, fp = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            k, block, f = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            key, fp = np.concatenate([key, np.stack([k, block], axis=1)]), np.concatenate([fp, f])
            ready = np.flatnonzero(np.any(key != key[-1], axis=1)) if len(key) else []
            if len(ready):  # the last group may go on in the next batch
                cut = int(ready[-1]) + 1
                yield within(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(fp):
            yield within(key, fp)

    return rows.select("key", "block", "fp").repartition("key", "block").sortWithinPartitions("key", "block", "fp").mapInArrow(link, "a long, b long")


def near_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints at most MOST_BITS apart. fps: distinct.

    A key with more than block fingerprints is split into blocks that meet two by two, so that no task holds more than two.
    Keys are made once and kept as a table until the links are there.
    """
    rows, place = stored(keyed(fps))
    crowded = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") * 2 / block).cast("int")))
    if few := crowded.count():
        if few <= MOST_BROADCAST:
            split = rows.join(F.broadcast(crowded), "key", "left")
        else:
            split = join_hot_safe(rows, crowded, "key", "n", rows.count(), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        two = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other) + 1)
        links = checkpointed(linked(split.select("key", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(two)).alias("block"))))
    else:
        links = checkpointed(linked(rows.withColumn("block", F.lit(0))))
    forget(fps.sparkSession, [place])
    return links


def near_duplicates(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached), row_key, kept.

    key tells rows apart that share a doc_id; it becomes row_key, empty if it is not given. kept is true for the rows of a
    component with its smallest doc_id and, under that id, its smallest row_key.

    Equal fingerprints are one node, so copies are never paired. Null, empty and blank texts have fingerprint zero and are
    linked like any other. A null doc_id takes part but is never a component's id unless no other is there. Rows that repeat
    are answered alike. Further columns are ignored; an empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, key))
    nodes = checkpointed(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("least")))
    roots = connected_components(near_links(nodes)).withColumnRenamed("node", "fp")
    linked_nodes = checkpointed(nodes.join(roots, "fp"))
    least = linked_nodes.groupBy("root").agg(F.min("least").alias("first"))
    joined = join_counted(linked_nodes, least, "root", linked_nodes.count()).select("fp", "first")
    classes = checkpointed(nodes.join(joined, "fp", "left").select("fp", "n", F.coalesce("first", "least").alias("first")))
    found = join_hot_safe(prints, classes, "fp", "n", prints.count())
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("row_key").eqNullSafe(F.col("first.row_key"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"), "row_key", kept.alias("kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
