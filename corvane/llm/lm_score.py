"""Cross-entropy difference of two n-gram models.

Word bigram models of a target part of the corpus and of the rest share one vocabulary, all words of all documents, and one
smoothing. They are matched: the larger part's counts are scaled down to as many words as the smaller part has, so that no
row is left out and smoothing weighs the same in both. A document is scored by counts from which its own are taken away.
Neither words nor bigrams pass through the driver: each block of documents sends its distinct n-grams, with their
counts in the block, to parts by hash; a part adds the blocks' counts up and answers each block with the corpus's counts of
the n-grams that the block sent; so each block can score its own documents. A block sends nothing to a part of which it has no
n-grams, so no more rows are sent than there are n-grams in blocks, however many parts there are; the sizes of the vocabulary and of the models
are three sums over the same exchange.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.common import checkpointed, table, words_of

#: Hashes of what stands before a text's first word and of words outside a vocabulary that a caller bounds.
BEGIN, UNKNOWN = 0, 1
#: What a key counts, in its lowest bits: a word, or a document for BEGIN; a word after another one.
WORD, PAIR = 0, 1
#: Share of a text's characters that may be neither letters nor space, and that may be capitals, in running text.
MOST_SIGNS, MOST_CAPITALS = 0.1, 0.2
#: Weight of the unigram model in words seen after each word.
PRIOR = 50.0
#: Words of a block of documents at least, its task's last block apart, and parts of the keys at least; what a part holds is
#: added up together.
BLOCK, TOGETHER = 1 << 21, 512
#: Distinct words that a task keeps before it hands on its counts.
KEPT = 300_000


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs. docs: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
                if len(found) > KEPT:
                    yield handed(found)
                    found = Counter()
        yield handed(found)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray, kind: int) -> np.ndarray:
    """Keys of a kind: 62 bits of a hash (the finish of splitmix64) and the kind."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (kind + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & ~np.uint64(3)) | np.uint64(kind)


class Grams:
    """A block's n-grams. words: hashes, BEGIN first; index: of each token, a place in words; lengths: tokens of each document."""

    def __init__(self, words: np.ndarray, index: np.ndarray, lengths: np.ndarray):
        n = len(words)
        self.n, self.index, self.before = n, index, np.zeros_like(index)
        self.before[1:] = index[:-1]
        self.first = (np.cumsum(lengths) - lengths)[lengths > 0]
        self.before[self.first] = 0
        pairs, self.place = np.unique(self.before * n + index, return_inverse=True)
        self.h, self.w = np.divmod(pairs, n)
        keys = np.concatenate([mixed(words, WORD), mixed(words[self.h] * np.uint64(0xD6E8FEB86659FD93) + words[self.w], PAIR)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each of keys occurs in the chosen tokens."""
        words = np.bincount(self.index[chosen], minlength=self.n)
        words[0] = np.count_nonzero(chosen[self.first])
        return np.concatenate([words, np.bincount(self.place[chosen], minlength=len(self.h))])[self.order]


def within(of: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """For each place, how often its value, one of size, occurs in the places of the same document."""
    _, at, n = np.unique(of * size + value, return_inverse=True, return_counts=True)
    return n[at]


def packed(counts: np.ndarray) -> bytes:
    """A byte for each count; counts of 255 and more follow in full."""
    return np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, "u1", n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


def planes(numbers: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones and so on: where high bytes are zero, shuffles press them to nothing."""
    return numbers.view("u1").reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(size, -1).T).view(kind).ravel()


#: A block's keys in a part as planes of the steps from key to key, with the block's counts; or a block's documents, with hashes of their words and places in
#: these as planes.
SENT = "block long, part int, keys binary, target binary, other binary, ids array<long>, lengths array<long>, words binary, places binary"
#: The corpus's counts of the keys that the block sent; or documents as above, and in target which of them are of the target part.
ANSWERED = "block long, part int, n_keys long, target binary, other binary, ids array<long>, lengths array<long>, words binary, places binary"
#: Words of the vocabulary, and how often words occur in the target part and in the other one.
SIZES = ("size", "target_words", "other_words")
SENT_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "target", "other")), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("places", pa.binary())])


def sent(docs: DataFrame, parts: int, known: frozenset[bytes] | None) -> DataFrame:
    """SENT: of each block a row for each part of which it has keys, and a row of documents. docs: doc_id, text, target."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple:
            place: defaultdict = defaultdict(lambda: len(place))
            place[None]  # BEGIN
            return place, [], [], []

        def handed() -> pa.RecordBatch:
            words = np.array([BEGIN, *(int.from_bytes(blake2b(w, digest_size=8).digest(), "little") if w else UNKNOWN for w in list(place)[1:])], dtype=np.uint64)
            index, lengths = np.concatenate([*tokens, np.zeros(0, np.int32)]).astype(np.int64), np.array([len(t) for t in tokens], dtype=np.int64)
            grams, chosen = Grams(words, index, lengths), np.repeat(np.array(targets, dtype=bool), lengths)
            counts, cuts = [grams.counts(c) for c in (chosen, ~chosen)], [0, *np.searchsorted(grams.keys, bounds), len(grams.keys)]
            block = TaskContext.get().partitionId() << 32 | serial
            rows = [(block, p, planes(np.diff(grams.keys[a:b], prepend=np.uint64(0))), *(packed(c[a:b]) for c in counts), None, None, None, None) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            rows.append((block, int(words.sum() % np.uint64(parts)), None, np.array(targets, dtype="u1").tobytes(), None, ids, lengths, words.tobytes(), planes(index.astype("<u4"))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SENT_ARROW.types, strict=True)], schema=SENT_ARROW)

        (place, ids, targets, tokens), serial, n = fresh(), 0, 0
        for batch in batches:
            for doc, text, target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = words_of(text.as_py())
                if known is not None:
                    found = [w if w in known else b"" for w in found]
                tokens.append(np.array([place[w] for w in found], dtype=np.int32))
                ids.append(doc)
                targets.append(target)
                n += len(found)
                if n >= BLOCK:
                    yield handed()
                    (place, ids, targets, tokens), serial, n = fresh(), serial + 1, 0
        if ids:
            yield handed()

    return docs.select(F.col("doc_id").cast("long"), "text", "target").mapInArrow(send, SENT)


def keys_of(asked: pd.DataFrame) -> list[np.ndarray]:
    return [np.cumsum(from_planes(k, "<u8"), dtype=np.uint64) for k in asked["keys"]]


def answered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A part's answers, and the documents as they came."""
    asked, documents = rows[rows["keys"].notna()], rows[rows["keys"].isna()]
    out = [(r.block, r.part, 0, r.target, None, r.ids, r.lengths, r.words, r.places) for r in documents.itertuples()]
    if len(asked):
        keys = keys_of(asked)
        n = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = [np.bincount(place, np.concatenate([unpacked(d, m) for d, m in zip(asked[c], n, strict=True)]), len(distinct)).astype(np.int64) for c in ("target", "other")]
        out += [(r.block, r.part, m, *(packed(c[place[e - m : e]]) for c in counts), None, None, None, None) for r, m, e in zip(asked.itertuples(), n, np.cumsum(n), strict=True)]
    return pd.DataFrame(out, columns=["block", "part", "n_keys", "target", "other", "ids", "lengths", "words", "places"])


def sizes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A part's share of SIZES."""
    asked = rows[rows["keys"].notna()]
    begin, unknown = mixed(np.array([BEGIN, UNKNOWN], dtype=np.uint64), WORD)
    words, total = [np.zeros(0, np.uint64)], [0, 0]
    for keys, *counts in zip(keys_of(asked), asked["target"], asked["other"], strict=True):
        is_word = ((keys & np.uint64(3)) == WORD) & (keys != begin)
        words.append(keys[is_word & (keys != unknown)])
        total = [t + int(unpacked(c, len(keys))[is_word].sum()) for t, c in zip(total, counts, strict=True)]
    return pd.DataFrame([(len(np.unique(np.concatenate(words))), *total)], columns=SIZES)


def scored(rows: pd.DataFrame) -> pd.DataFrame:
    """Scores of a block's documents."""
    d = rows[rows["places"].notna()].iloc[0]
    answers = rows[rows["places"].isna()].sort_values("part")
    words, lengths = np.frombuffer(d["words"], np.uint64), np.array(d["lengths"], dtype=np.int64)
    index = from_planes(d["places"], "<u4").astype(np.int64)
    grams, n = Grams(words, index, lengths), len(words)
    size, *total = (int(d[c]) for c in SIZES)
    of = np.repeat(np.arange(len(lengths)), lengths)
    in_target, length = np.frombuffer(d["target"], "u1").astype(bool)[of], lengths[of]
    own_w, own_pair = within(of, index, n), within(of, grams.place, len(grams.h))
    own_h = np.ones_like(own_w)
    own_h[1:] = own_w[:-1]
    own_h[grams.first] = 1
    bits = []
    for k, name in enumerate(("target", "other")):
        counts = np.empty(len(grams.keys), dtype=np.int64)
        counts[grams.order] = np.concatenate([unpacked(a, m) for a, m in zip(answers[name], answers["n_keys"], strict=True)])
        own, scale = in_target == (k == 0), min(total) / max(1, total[k])
        less = lambda c, mine: (c - own * mine) * scale  # noqa: B023, E731
        unigram = (less(counts[index], own_w) + 1) / (less(np.full(len(index), total[k]), length) + size + 2)
        pair = less(counts[n:][grams.place], own_pair)
        bits.append(np.log2(pair + PRIOR * unigram) - np.log2(less(counts[grams.before], own_h) + PRIOR))  # Dirichlet smoothing
    sums = np.bincount(of, bits[1] - bits[0], len(lengths))
    return pd.DataFrame({"doc_id": pd.array(list(d["ids"]), dtype="Int64"), "n_words": lengths, "ce_diff": sums / np.maximum(lengths, 1)})


def cross_entropy_difference(docs: DataFrame, target: Column, words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, ce_diff (mean bits a word under the target model minus those under the other).

    target says which rows of docs train the target model (null: not); all other rows train the other one. If there are no
    words in one of the parts all scores are 0. A document's own counts are taken from its part's before it is scored; a copy
    of it is another document, whose counts stay. What follows a word may be the end of its document, which is counted but
    not scored. Texts without words, null ones among them, have no loss and score 0. Rows that repeat count as often and are
    answered alike. Further columns are ignored; an empty table gives no rows. All words of docs are the vocabulary; a caller
    who wants a small one gives words, and all but the words - 2 most frequent are then one word, by a set that goes through
    the driver.
    """
    rows, known = docs.select("doc_id", "text", F.coalesce(target, F.lit(False)).alias("target")), None
    if words is not None:
        known = frozenset(bytes(r.word) for r in checkpointed(word_counts(rows)).orderBy(F.desc("n"), "word").limit(words - 2).collect())
    parts = max(TOGETHER, rows.rdd.getNumPartitions())
    asked = sent(rows, parts, known).groupBy("part")  # both readers share its exchange
    whole = asked.applyInPandas(sizes, ", ".join(f"{c} long" for c in SIZES)).agg(*[F.sum(c).alias(c) for c in SIZES])
    counted = asked.applyInPandas(answered, ANSWERED).crossJoin(F.broadcast(whole))  # one row
    return counted.groupBy("block").applyInPandas(scored, "doc_id long, n_words long, ce_diff double")


def is_running_text(text: Column) -> Column:
    """Whether nearly all of a text is letters and space, and few letters are capitals: no tables, junk or shouting."""
    n = F.char_length(text)
    signs, capitals = F.regexp_count(text, F.lit(r"[^\p{L}\s]")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    return (n > 0) & (signs <= n * MOST_SIGNS) & (capitals <= n * MOST_CAPITALS)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: running text, in any language. What scores above zero reads more like the tables, junk and shouting of the rest."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), is_running_text(F.col("text")))
