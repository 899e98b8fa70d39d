"""Enrichment of rows by a service that answers in batches, with retries, committed part by part so that a restart goes on."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Texts sent together, tries of a batch, seconds before the second try and at most.
BATCH, TRIES, FIRST_DELAY, MOST_DELAY = 32, 5, 0.5, 30.0
#: Rows that one commit covers, about.
PART_ROWS = 200_000

#: Takes texts and gives, in any order, the place and the vector of each.
Service = Callable[[list[str]], list[tuple[int, list[float]]]]


class ServiceAnswerError(ValueError):
    """The service gave other places than it was asked for, or a vector of another length."""


def answered(service: Service, texts: list[str], dim: int, tries: int, first_delay: float, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """The vectors of texts, in their order. A failure is tried again after a delay that doubles up to MOST_DELAY."""
    for attempt in range(tries):
        try:
            found = dict(service(texts))
            if sorted(found) != list(range(len(texts))):
                raise ServiceAnswerError(f"{len(found)} answers to {len(texts)} texts")
            if any(len(v) != dim for v in found.values()):
                raise ServiceAnswerError(f"a vector has other than {dim} numbers")
            return [found[i] for i in range(len(texts))]
        except Exception:
            if attempt == tries - 1:
                raise
            sleep(min(MOST_DELAY, first_delay * 2**attempt))
    raise ValueError("no tries")


def committed(rows: DataFrame, folder: str) -> DataFrame | None:
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("chunk_id string, embedding array<float>").parquet(folder)


def enrich(chunks: DataFrame, service: Service, dim: int, folder: str, batch: int = BATCH, part_rows: int = PART_ROWS, tries: int = TRIES, first_delay: float = FIRST_DELAY) -> DataFrame:
    """chunk_id, embedding of chunks (chunk_id, text), kept in folder.

    Only chunks that folder lacks are sent, once for each chunk_id, part by part by a hash of the id: a part is committed as a
    whole or not at all, so a run that ends between leaves its finished parts, and the next one asks for the rest alone. Null
    texts are sent as empty ones; a null chunk_id is left out. Speculative or repeated tasks may ask twice; they commit once.
    """
    asked = chunks.filter("chunk_id is not null").select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    done = committed(asked, folder)
    left = asked if done is None else asked.join(done.select("chunk_id"), "chunk_id", "left_anti")
    parts = max(1, -(-left.count() // part_rows))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), batch):
                some = frame.iloc[begin : begin + batch]
                yield pd.DataFrame({"chunk_id": some["chunk_id"], "embedding": answered(service, some["text"].tolist(), dim, tries, first_delay)})

    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)) == part).dropDuplicates(["chunk_id"])
        done = committed(asked, folder)  # anew for each part: what is there now is not sent
        own = own if done is None else own.join(done.select("chunk_id"), "chunk_id", "left_anti")
        own.mapInPandas(send, "chunk_id string, embedding array<float>").write.mode("append").parquet(folder)
    return committed(asked, folder).join(asked.select("chunk_id").distinct(), "chunk_id", "left_semi")
