"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed from left to right into the longest
phrases that occur in the language's text; the fewer phrases, weighted by the logarithm of the labelled text's length and
divided by the text's length, the lower its cross-entropy against that language. Automata become one transition table, so
many pieces of text are parsed in step, for all languages at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvane.llm.common import batches_of, checkpointed, fold, table

FOLDS, HELD_OUT = 3, 1
#: What is learnt from at most: labelled texts of each language, and characters of all languages together, in segments from
#: anywhere in those texts. A language has one segment at least, so beyond MOST_CHARS / SEGMENT languages each has one.
MOST_ROWS, MOST_CHARS, SEGMENT = 200, 160_000, 1_000
#: Bytes that are parsed without a break, and pieces that are parsed in step.
PIECE, LANES = 1_024, 4_096
UNDETERMINED = "und"
#: Parts of a language's texts from which the learnt ones are chosen, each by a task of its own.
CHOOSERS = 256
#: Runs of what is no letter: signs, digits, marks and spaces.
NO_LETTERS = re.compile(r"[\W\d_]+")


def automaton(text: np.ndarray, classes: int) -> np.ndarray:
    """Transitions (state, class) of the suffix automaton of text, -1 where there is none. State 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(step), classes), -1, dtype=np.int32)
    for state, to in enumerate(step):
        out[state, list(to)] = list(to.values())
    return out


def letters_alone(text: str) -> bytes:
    """The text in lower case as UTF-8, where each run of what is no letter has become one space."""
    return NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


class Parser:
    """Counts the phrases of texts against each language, byte by byte, so that letters of all scripts are told apart.

    The table has a row for each state, of which there are at most two for each learnt byte, and a column for each kind of
    byte that was learnt, 256 at most: some 2 kB for each byte, 0.3 GB for MOST_CHARS bytes if all kinds occur and half of
    that for languages of Latin letters.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        learnt = {k: letters_alone(t) for k, t in texts.items()}
        kinds = sorted(set().union(*learnt.values()))
        self.classes = len(kinds) + 1
        self.of_byte = np.full(256, len(kinds), dtype=np.uint8 if len(kinds) < 256 else np.int16)
        self.of_byte[kinds] = np.arange(len(kinds))
        tables, self.root, at = [], [], 0
        for language in self.languages:
            to = automaton(self.of_byte[np.frombuffer(learnt[language], dtype=np.uint8)], self.classes)
            alone = len(to)  # the state after a byte that the labelled text lacks, a phrase of its own
            to = np.concatenate([to, np.full((1, self.classes), -1, dtype=np.int32)])
            ends = to < 0  # the phrase ends before this byte, which begins the next one
            begins = np.where(to[0] < 0, alone, to[0])
            state = np.where(ends, begins[None, :], to).astype(np.int64) + at
            ends[0] = False  # nothing has been read at the root
            tables.append(((state * self.classes) << 1 | ends).astype(np.int32 if (at + len(to)) * self.classes * 2 < 1 << 31 else np.int64))
            self.root.append(at * self.classes)
            at += len(to)
        self.table = np.concatenate([*tables, np.zeros((0, self.classes), dtype=np.int32)]).ravel()
        self.weight = np.array([np.log2(max(2, len(learnt[x]))) for x in self.languages])

    def coded(self, text: str) -> np.ndarray:
        return self.of_byte[np.frombuffer(letters_alone(text), dtype=np.uint8)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text against each language, and parsed bytes. A text is parsed in pieces of PIECE."""
        codes = [self.coded(t) for t in texts]
        size = np.array([len(c) for c in codes], dtype=np.int64)
        pieces = -(-size // PIECE)
        of_text = np.repeat(np.arange(len(texts)), pieces)
        begin = np.concatenate([[0], np.cumsum(size)])[of_text] + (np.arange(len(of_text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        length = np.minimum(PIECE, np.repeat(np.cumsum(size), pieces) - begin)
        flat = np.concatenate([*codes, np.zeros(PIECE, dtype=self.of_byte.dtype)])
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        for lanes in (order[i : i + LANES] for i in range(0, len(order), LANES)):
            most, alive = length[lanes], len(lanes)
            grid = np.ascontiguousarray(flat[begin[lanes][:, None] + np.arange(most[0])].T)
            state = np.repeat(np.array(self.root, dtype=np.int64)[:, None], len(lanes), axis=1)
            ended = np.zeros(state.shape, dtype=np.int32)
            live = np.searchsorted(-most, -np.arange(most[0]), "left")  # pieces longer than t come first
            for t in range(most[0]):
                alive = live[t]
                now = state[:, :alive]
                got = self.table.take(now + grid[t, :alive])
                ended[:, :alive] += got & 1
                state[:, :alive] = got >> 1
            np.add.at(counts, of_text[lanes], ended.T + 1)  # the last phrase of a piece ends with it
        return counts, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of least cross-entropy, and the second's share of the sum of the two least; 1 with one language."""
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if known and self.languages:
            counts, size = self.phrases([texts[i] for i in known])
            bits = counts * self.weight / np.maximum(size, 1)[:, None]
            least = np.argsort(bits, axis=1, kind="stable")
            for row, i in enumerate(known):
                best = bits[row, least[row, 0]]
                second = bits[row, least[row, 1]] if len(self.languages) > 1 else None
                labels[i] = self.languages[least[row, 0]]
                scores[i] = 1.0 if second is None else float(min(1.0, second / (best + second))) if best + second else 0.5
        return labels, scores


def labelled_texts(docs: DataFrame) -> dict[str, str]:
    """Learnt text of each language, from rows outside the held-out fold.

    Of each language's different texts MOST_ROWS are chosen by a hash of the text, and of their segments, wherever they lie,
    as many by a hash as the language's share of MOST_CHARS has room for. Copies count once.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).select("lang", "text")
    texts = usable.withColumn("at", F.xxhash64("text"))
    first = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy("at"))
    # the first of each of CHOOSERS parts, then the first of these, so that no task sees more than a few of each task before
    some = texts.select("lang", "at", F.pmod("at", F.lit(CHOOSERS)).alias("part")).distinct().withColumn("row", first("part")).filter(F.col("row") <= MOST_ROWS)
    chosen = checkpointed(some.withColumn("row", first()).filter(F.col("row") <= MOST_ROWS).select("lang", "at"))
    languages = chosen.select("lang").distinct().count()
    once = texts.join(F.broadcast(chosen), ["lang", "at"]).groupBy("lang", "at").agg(F.max("text").alias("text"))  # MOST_ROWS a language

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [text[i : i + SEGMENT] for i in range(0, len(text), SEGMENT)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array([at] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], names=["lang", "at", "segment", "text"])

    room = max(1, MOST_CHARS // (SEGMENT * max(1, languages)))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("at", "segment"), "at", "segment"))
    segments = once.select("lang", "at", "text").mapInArrow(cut, "lang string, at long, segment long, text string").withColumn("place", place).filter(F.col("place") <= room)
    out: dict[str, list[str]] = {}
    for r in sorted(segments.select("lang", "place", "text").collect()):
        out.setdefault(r.lang, []).append(r.text)
    joined = {k: "\n".join(t) for k, t in out.items()}
    return {k: t for k, t in joined.items() if any(map(str.isalpha, t))}


_parsers: dict[int, tuple[dict[str, str], Parser]] = {}


def parser_of(texts: dict[str, str]) -> Parser:
    """One for each worker process: automata are built once, not for each task."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _parsers or _parsers[key][0] != texts:
        _parsers.clear()
        _parsers[key] = texts, Parser(texts)
    return _parsers[key][1]


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are und with score 0, as is every text if no labelled text was given. Equal
    cross-entropies: the first language by name. Rows that repeat are answered alike. Further columns are ignored; an
    empty table gives no rows.
    """
    texts = labelled_texts(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(texts)
        for batch in batches_of(batches, "text", 8 << 20):
            labels, scores = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
