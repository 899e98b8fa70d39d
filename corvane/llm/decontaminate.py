"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of documents within a partition. Its words become ids of the benchmark's vocabulary; words outside it
cannot be in any window, so only runs of known words as long as the shortest window enter the shard's text. The text's
suffix array gives its Burrows-Wheeler transform, held as a wavelet matrix with rank counts, and every sampled suffix
position. All windows are searched backwards together, their occurrences are located by walking to sampled positions, and
overlapping occurrences are merged into removal spans. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corvane.llm.common import batches_of, checkpointed, forget, join_hot_safe, stored, table, words_of

WINDOW = 13
#: Bytes of text in a shard, words of benchmark text searched at a time, distance of sampled suffix positions.
SHARD_BYTES = 16 << 20
BLOCK_WORDS = 200_000
SAMPLED = 16
COLUMNS = ("n_words", "n_hit", "spans", "items")
TYPES = "n_words long, n_hit long, spans array<bigint>, items array<string>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Windows:
    """The distinct windows of some items, as rows of word ids, longest first, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(item)
        rows = sorted(found, key=lambda w: (-len(w), w))
        self.length = np.array([len(w) for w in rows], dtype=np.int64)
        self.words = np.zeros((len(rows), window), dtype=np.int64)
        for i, w in enumerate(rows):
            self.words[i, : len(w)] = w
        self.items = [sorted(found[w]) for w in rows]
        self.shortest = int(self.length.min()) if rows else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorts the suffixes by prefix doubling: twice as many symbols are compared in each round."""
    n, step = len(text), 1
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(text[order][1:] != text[order][:-1])])
    while rank[order[-1]] < n - 1:
        behind = np.full(n, -1, dtype=np.int64)
        behind[: n - step] = rank[step:]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        step *= 2
    return order


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: ids below symbols. Inside, each is one more, so that the 0 at the end is the only one."""
        text, symbols = np.concatenate([text + 1, [0]]), symbols + 1
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros, level = [], [], self.bwt
        for bit in range(self.bits - 1, -1, -1):
            set_bits = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(set_bits)]).astype(np.int32))
            self.zeros.append(len(level) - int(set_bits.sum()))
            level = np.concatenate([level[set_bits == 0], level[set_bits == 1]])
        self.sampled = order % SAMPLED == 0
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before end, by a walk down the wavelet matrix."""
        begin = np.zeros_like(end)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> bit) & 1).astype(bool)
            b, e = self.ones[level][begin].astype(np.int64), self.ones[level][end].astype(np.int64)
            begin, end = np.where(one, self.zeros[level] + b, begin - b), np.where(one, self.zeros[level] + e, end - e)
        return end - begin

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of words (its first length ones), empty if none does."""
        low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(self.bwt), dtype=np.int64)
        for back in range(1, words.shape[1] + 1):
            live = np.flatnonzero((length >= back) & (low < high))
            symbol = words[live, length[live] - back] + 1
            low[live], high[live] = (self.before[symbol] + self.rank(symbol, edge[live]) for edge in (low, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: steps to the left until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        while len(walking := np.flatnonzero(~self.sampled[rows])):
            symbol = self.bwt[rows[walking]]
            rows[walking] = self.before[symbol] + self.rank(symbol, rows[walking])
            steps[walking] += 1
        return self.samples[self.sample_at[rows]] + steps


def known_runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least shortest ids above 0, with the 0 after each, and where each of their symbols was in ids. ids end in 0."""
    known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
    begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = end - begin >= shortest
    begin, size = begin[long], (end - begin)[long] + 1
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return ids[at], at


def merged(hit: np.ndarray) -> np.ndarray:
    """Begin and end of each run of hit words, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))


def search_shard(texts: Iterable[list[bytes]], windows: Windows) -> list[tuple[np.ndarray, list[str]]]:
    """For each document the merged spans of hit words and the items with a window in it. texts are read once, and no more than
    one document's words are held."""
    get = windows.vocabulary.get
    # one id more, 0, after each document, so that no window goes across
    coded = [np.fromiter(chain((get(w, 0) for w in words), (0,)), dtype=np.int32, count=len(words) + 1) for words in texts]
    out = [(np.zeros(0, dtype=np.int64), [])] * len(coded)
    start = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    ids = np.concatenate(coded).astype(np.int64) if coded else np.zeros(0, dtype=np.int64)
    if not windows.shortest:
        return out
    text, at = known_runs(ids, windows.shortest)
    if not len(text):
        return out
    index = FmIndex(text, len(windows.vocabulary) + 1)
    low, high = index.search(windows.words, windows.length)
    count = high - low
    if not count.any():
        return out
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    place = at[index.locate(rows)]
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + windows.length[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(start, place, "right") - 1
    pairs = np.unique(np.stack([doc, which]), axis=1)
    items: dict[int, set[str]] = {}
    for d, w in pairs.T.tolist():
        items.setdefault(d, set()).update(windows.items[w])
    for d, found in items.items():
        out[d] = merged(hit[start[d] : start[d + 1]]), sorted(found)
    return out


def union_spans(lists: list[list[int]]) -> list[int]:
    """Lists of begin and end, one after the other, merged where they meet or overlap."""
    spans, out = sorted((a, b) for x in lists for a, b in zip(x[::2], x[1::2], strict=True)), []
    for begin, end in spans:
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def with_hits(docs: DataFrame, windows: Windows) -> DataFrame:
    """docs with COLUMNS: word count, hit words, spans (begin and end of each, one after the other, in words), items found."""
    text = docs.columns.index("text")

    def counted(column: pa.Array, sizes: list[int]) -> Iterator[list[bytes]]:
        for t in column:
            words = words_of(t.as_py())
            sizes.append(len(words))
            yield words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", SHARD_BYTES):
            sizes: list[int] = []
            found = search_shard(counted(batch.column(text), sizes), windows)
            spans = [s.tolist() for s, _ in found]
            new = [pa.array(sizes, pa.int64()), pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([i for _, i in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *COLUMNS])

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, *StructType.fromDDL(TYPES).fields]))


def n_words() -> Column:
    """As many words as words_of() finds."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")


def block_by_block(docs: DataFrame, benchmark: DataFrame, window: int, blocks: int) -> DataFrame:
    """docs with COLUMNS, by a job for each block of items, which leaves nothing but the hits of the texts that have some."""
    spark, rows, places = docs.sparkSession, docs.select("text", digest(F.col("text")).alias("text_key")), []
    for block in range(blocks):
        hits, place = stored(with_hits(rows, Windows(items_of(benchmark, blocks, block), window)).filter("n_hit > 0").groupBy("text_key").agg(F.count("*").alias("n"), F.min("spans").alias("spans"), F.min("items").alias("items")))
        places.append((hits, place))
    lists = reduce(DataFrame.unionByName, [hits for hits, _ in places]).groupBy("text_key").agg(F.max("n").alias("n"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [union_spans(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted({*chain(*x)}) for x in batch.column(3).to_pylist()], pa.list_(pa.string()))], names=["text_key", "n", "spans", "items"])

    found = checkpointed(lists.mapInArrow(merge, "text_key binary, n long, spans array<bigint>, items array<string>"))
    forget(spark, [place for _, place in places])
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    met = join_hot_safe(docs.select(F.struct("*").alias("row"), digest(F.col("text")).alias("text_key"), n_words().alias("n_words")), found, "text_key", "n", docs.count(), "left")
    spans = F.coalesce("spans", F.array().cast("array<bigint>"))
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return met.select(*[c.alias(k) for k, c in own.items()], "n_words", n_hit.alias("n_hit"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def items_of(benchmark: DataFrame, blocks: int, block: int) -> list[tuple[str, str | None]]:
    """id and text of a block's items."""
    own = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    return [tuple(r) for r in own.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, with its columns, and n_words, n_hit, spans, items; columns of docs by these names are replaced.

    A window is any window consecutive words of an item, or the whole item if it has fewer words but has some. Items are
    searched in blocks of about block_words words; the driver and each task hold one block's windows at a time. One block
    takes one pass over docs, which shuffles nothing. More take a job each, and what they found is joined back by the text's
    digest. Null texts and texts without words have no hits; items without an id are searched as the item "". Items that
    repeat an id count once. Empty tables give no rows or no hits.
    """
    total = benchmark.select(F.sum(F.char_length("text"))).first()[0] or 0
    blocks, rest = max(1, -(-total // (5 * block_words))), docs.drop(*COLUMNS)
    return with_hits(rest, Windows(items_of(benchmark, 1, 0), window)) if blocks == 1 else block_by_block(rest, benchmark, window, blocks)


def is_contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def strip_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without the spans of words, each from its first word's begin to its last word's end."""
    if text is None or not spans:
        return text
    words = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    kept, at = [], 0
    for begin, end in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[at : words[begin][0]])
        at = words[end - 1][1]
    return "".join([*kept, text[at:]])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), is_contaminated().alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))
), found AS (SELECT doc_id, p.n, i, item FROM places p JOIN windows USING (n, gram)),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
