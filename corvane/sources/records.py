"""Metadata records and vector files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import ids, text as T, vectors as V

RECORD = "bbbs string, title string, gbrq string, sxrq string, sxx int, zdjgName string, flxz string, zdjgCodeId string, flfgCodeId string, my_dir string, my_file string, my_status int, my_time string"
VECTOR = "vector_id long, chunk_id string, model string, dim int, normalized boolean, vector array<float>"


def read_records(spark: SparkSession, path: str, volume: str) -> DataFrame:
    """{"data": [...]} files; two numbers become text, and a record without its own id gets one from title and file."""
    rows = spark.read.schema(f"data array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split(' ') for c in RECORD.split(', ')))}>>").option("multiLine", True).json(path)
    r = rows.select(F.explode("data").alias("r")).select("r.*")
    key = F.coalesce(F.nullif("bbbs", F.lit("")), ids.fallback_record_id(F.coalesce("title", F.lit("")), F.coalesce("my_file", F.lit(""))))
    return r.select(key.alias("record_id"), *[F.col(c).cast("string") if c in ("sxx", "my_status") else F.col(c) for c in r.columns], F.lit(volume).alias("volume"))


def expected_path(folder: Column, file: Column, root: Column) -> Column:
    """root/docx/cleaned segments of folder/file; null without a file."""
    segments = F.filter(F.transform(F.split(F.translate(F.coalesce(folder, F.lit("")), "\\", "/"), "/"), lambda s: T.strip(s)), lambda s: (s != "") & (s != "."))
    return F.when(file.isNotNull() & (file != ""), F.array_join(F.concat(F.array(root, F.lit("docx")), segments, F.array(file)), "/"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR).json(path).filter("vector_id is not null or chunk_id is not null")


def vector_faults(vectors: DataFrame, dim: int) -> DataFrame:
    """One row of counts: all, repeated ids, blank chunk ids, wrong or not finite vectors. A load is sound if all but the first are 0."""
    ids_ = vectors.groupBy("vector_id").count().filter("count > 1").agg(F.count("*").alias("repeated_ids"))
    rows = vectors.agg(F.count("*").alias("n"), F.count(F.when(F.coalesce("chunk_id", F.lit("")) == "", 1)).alias("blank_chunks"), F.count(F.when(~V.is_valid(F.col("vector"), dim), 1)).alias("bad_vectors"))
    return rows.crossJoin(ids_)  # one row and one row
