"""Token counts of sections by offset-mapped attribution.

Each whole document is encoded once by a byte-level vocabulary, whose tokens tile the text. Their character spans are joined
with the spans of the document's sections, which tile it too. A token that crosses a boundary goes to the section that has
most of its bytes, the earlier one among equals, so a document's section counts add up to its own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import table

SCHEMA = "doc_id long, section long, begin long, end long, n_tokens long, n_crossing long"
RULES = ("most", "first")
#: Runs of white space as the vocabulary's pattern knows it, too long for its look-ahead, which keeps a place for each character.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


class ByteBpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """The pattern cuts before a run of white space and, unless the text ends with it, before its last character, so long
        runs are taken out there and merged as the one piece that they are."""
        parts, at = [], 0
        for run in LONG_SPACE.finditer(text):
            cut = run.end() - (run.end() < len(text))
            parts += [self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()), self.whole.encode_to_numpy(text[run.start() : cut], disallowed_special=())]
            at = cut
        return np.concatenate([*parts, self.encoding.encode_to_numpy(text[at:], disallowed_special=())])

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.size[self.ids(text)])


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def lines(raw: np.ndarray) -> np.ndarray:
    """Where each line ends, in bytes, its line feed included; a last line without one ends with the text."""
    ends = np.flatnonzero(raw == 0x0A) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross one of its boundaries. Both kinds of spans tile the same bytes."""
    if not len(token_ends):
        return np.zeros(len(section_ends), dtype=np.int64), np.zeros(len(section_ends), dtype=np.int64)
    begin = np.concatenate([[0], token_ends[:-1]])
    first, last = np.searchsorted(section_ends, begin, "right"), np.searchsorted(section_ends, token_ends, "left")
    owner = first.copy()
    crossing = np.flatnonzero(first < last)
    if rule == "most":
        starts = np.concatenate([[0], section_ends[:-1]])
        for t in crossing.tolist():
            sections = np.arange(first[t], last[t] + 1)
            shared = np.minimum(section_ends[sections], token_ends[t]) - np.maximum(starts[sections], begin[t])
            owner[t] = sections[int(np.argmax(shared))]
    n = len(section_ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "most") -> DataFrame:
    """One row per section (line) of each document: doc_id, section from 0, begin and end in code points, n_tokens, n_crossing.

    rule: "most", as above, or "first", where a token belongs to the section in which it begins. Null and empty texts have
    one empty section without tokens. A line feed belongs to the line that it ends. Rows that repeat are counted each;
    further columns are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            rows = []
            for text in batch.column(1):
                text = (text.as_py() or "").encode("utf-8", "replace")
                raw = np.frombuffer(text, dtype=np.uint8)
                ends = lines(raw)
                tokens, crossing = attribute(bpe.ends(text.decode()), ends, rule)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
                for part, values in zip(parts, (np.arange(len(ends)), np.concatenate([[0], points[:-1]]), points, tokens, crossing), strict=True):
                    part.append(values)
                rows.append(len(ends))
            at = pa.array(np.repeat(np.arange(batch.num_rows), rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(np.concatenate(p) if p else [], pa.int64()) for p in parts)], names=["doc_id", "section", "begin", "end", "n_tokens", "n_crossing"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
