"""Greedy packing of a document's blocks into chunks, one document at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corvane.functions import ids, text as T

TARGET, MOST = 700, 1200
SCHEMA = "doc_id string, chunk_index long, chunk_text string, section_path string, article_no string, article_range string, paragraph_start long, paragraph_end long, token_count long"


def tokens(text: str) -> int:
    return max(1, int(len(text) / T.CHARS_PER_TOKEN)) if text else 0


class Packer:
    """Holds the chunk that is being filled."""

    def __init__(self, target: int, most: int):
        self.target, self.most, self.rows = target, most, []
        self.clear(0)

    def clear(self, at: int) -> None:
        self.parts: list[str] = []
        self.size, self.start, self.headings_only = 0, at, True
        self.path = self.article = None
        self.articles: list[str] = []

    def emit(self, parts: list[str], start: int, end: int, articles: list[str]) -> None:
        body, one = "\n\n".join(parts), list(dict.fromkeys(articles))
        span = None if not one else one[0] if len(one) == 1 else f"{one[0]}-{one[-1]}"
        self.rows.append((body, self.path, self.article, span, start, end, tokens(body)))

    def flush(self, end: int) -> None:
        if self.parts:
            self.emit(self.parts, self.start, end, self.articles)

    def add(self, i: int, text: str, level: str | None, path: str | None, article: str | None) -> None:
        n, heading = tokens(text), level in T.HEADINGS
        full = not self.headings_only and self.size + n > self.most
        if self.parts and (heading or (level == "条" and self.size >= self.target * 0.5) or full):
            self.flush(i - 1)
            self.clear(i)
        self.parts.append(text)
        self.size += n
        self.headings_only &= heading
        self.path = path or self.path
        if article:
            self.article = article
            if self.articles[-1:] != [article]:
                self.articles.append(article)
        if self.size > self.most and n > self.most:
            self.cut_last(i)

    def cut_last(self, i: int) -> None:
        """The last part alone is too long: its first piece fills this chunk, the others make chunks of their own."""
        room = max(1, self.most - sum(map(tokens, self.parts[:-1])))
        first, *others = T.pieces(self.parts[-1], room)
        self.parts[-1] = first
        self.flush(i)
        left: list[str] = [first] if not others else []
        for piece in others:
            left = [piece]
            if tokens(piece) <= self.most:
                self.emit([piece], i, i, [self.article] if self.article else [])
                left = []
        self.parts, self.size, self.start = left, sum(map(tokens, left)), i
        if not left:
            self.size, self.start, self.headings_only, self.articles = 0, i + 1, True, []


def build_chunks(blocks: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """blocks (doc_id, block_index, text, law_level, section_path, article_no), without tables of contents, to chunks.

    A document's blocks are sorted by Spark and stream through its task, one at a time, so a document of any length has
    only its chunks in memory.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, packer, i = None, None, 0

        def done() -> list[tuple]:
            packer.flush(i - 1)
            return [(doc, k, body, path, article, span, start, end, n) for k, (body, path, article, span, start, end, n) in enumerate(packer.rows)]

        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if packer is None or row.doc_id != doc:
                    out += done() if packer else []
                    doc, packer, i = row.doc_id, Packer(target, most), 0
                if row.text:
                    packer.add(i, row.text, row.law_level, row.section_path, row.article_no)
                i += 1
            yield pd.DataFrame(out, columns=SCHEMA_NAMES)
        if packer:
            yield pd.DataFrame(done(), columns=SCHEMA_NAMES)

    rows = blocks.select(F.col("doc_id").cast("string"), "block_index", "text", "law_level", "section_path", "article_no")
    packed = rows.repartition("doc_id").sortWithinPartitions("doc_id", "block_index").mapInPandas(pack, SCHEMA)
    named = F.nullif(F.array_join(T.references("chunk_text"), "、"), F.lit(""))
    return packed.withColumn("article_range", F.coalesce("article_range", named)).withColumn("chunk_id", ids.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk_text")))


SCHEMA_NAMES = [part.split(" ")[0] for part in SCHEMA.split(", ")]
