"""Helpers shared by the corpus operators: checkpoints, joins that survive hot keys, fold numbers, tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key counts as hot if it holds more than this share of all rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


#: Bytes that end a word; others are lower-case letters, digits and bytes of characters beyond ASCII.
BREAKS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
TO_SPACE = bytes.maketrans(BREAKS, b" " * len(BREAKS))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z in lower case. Null has none."""
    return (text or "").encode("utf-8", "replace").lower().translate(TO_SPACE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset one in the warehouse, which must be one that executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if not sc.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
                raise ValueError("spark.checkpoint.dir is not set, and the warehouse is a folder of one machine")
            place = f"{warehouse}/_checkpoints"
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, which outlives executors. For narrow tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written to the shared folder as Parquet and read again, and the place to forget() it at."""
    place = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place), place


def exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def forget(spark: SparkSession, places: list[str]) -> None:
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall in fold n, which is no fold's number."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(n))


def join_hot_safe(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join of rows with per_key, which has one row for each key and in count the number of that key's rows in rows.

    Keys with over HOT_SHARE of all rows, fewer than 1 / HOT_SHARE by counting, are broadcast; the rest meets by a shuffle
    in which no key has more than that share.
    """
    hot = per_key.filter(F.col(count) > max(1.0, total * HOT_SHARE))
    cold = per_key.filter(F.col(count) <= max(1.0, total * HOT_SHARE))
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(cold, key, how))


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """join_hot_safe() where nobody has counted yet. rows: checkpointed, about total of them, no null keys.

    A key with over HOT_SHARE of the rows is among the 1 / HOT_SHARE most frequent ones, which are looked up.
    """
    most = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(round(1 / HOT_SHARE)).collect()
    hot = [r[0] for r in most if r.n > max(1.0, total * HOT_SHARE)]
    if not hot:
        return rows.join(per_key, key, how)
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).join(F.broadcast(per_key.filter(is_hot)), key, how).unionByName(rows.filter(~is_hot).join(per_key, key, how))


def batches_of(source: Iterator[pa.RecordBatch], text: str, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each has about most_chars bytes of text; a longer text makes a batch alone."""
    for batch in source:
        column = batch.column(batch.schema.get_field_index(text))
        size, begin = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            if size and size + n > most_chars:
                yield batch.slice(begin, i - begin)
                size, begin = 0, i
            size += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
