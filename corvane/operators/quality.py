"""Counts, rates and reviews over corpus tables. Each is one pass where the figures allow it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corvane.functions import text as T
from corvane.operators.storage import kept


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """name, n: rows of each table, -1 for one that is missing."""
    some = next(df for df in tables.values() if df is not None)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") if df is not None else some.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(-1).cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [one(k, v) for k, v in tables.items()])


def group_counts(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(F.coalesce(column.cast("string"), F.lit("null")).alias(name)).agg(F.count("*").alias("n"))


def match_summary(records: DataFrame, files: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Matched and unmatched keys of either side, and blank fields of the records."""
    r, f = records.select(key).distinct().withColumn("_r", F.lit(1)), files.select(key).distinct().withColumn("_f", F.lit(1))
    both = r.join(f, key, "full_outer").agg(count_if(F.col("_r").isNotNull() & F.col("_f").isNotNull()).alias("matched"), count_if(F.col("_f").isNull()).alias("records_only"), count_if(F.col("_r").isNull()).alias("files_only"))
    blank = records.agg(*[count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"missing_{c}") for c in fields])
    return both.crossJoin(blank)  # one row and one row


def page_quality(lines: DataFrame, order: str | None = None) -> DataFrame:
    """lines (doc_id, page, text, confidence) to one row per page with its class ok, warning or severe.

    With order, a column by which lines follow one another, a page's confidences are added in that order, as doubles; rows sorted
    by it stream through the sum, so no page is held whole. Without it they are summed as decimals, so that a mean at a bound is
    the same in whatever order rows come.
    """
    size, kept_size = F.char_length("text"), F.char_length(F.regexp_replace("text", T.WS, ""))
    rows = lines.select("doc_id", "page", "confidence", kept_size.alias("chars"), (size - F.char_length(F.translate("text", "�", ""))).alias("odd"), size.alias("size"), *([F.col(order).alias("_order")] if order else []))
    if order:
        so_far = W.partitionBy("doc_id", "page").orderBy("_order").rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumn("_mean", F.avg("confidence").over(so_far))
        mean = F.max_by("_mean", "_order")
    else:
        exact = F.expr("try_cast(confidence AS decimal(24, 15))")
        mean = F.when(F.count("confidence") == F.count(exact), F.avg(exact).cast("double")).otherwise(F.avg("confidence"))  # one that is not finite has no decimal
    low = F.avg((F.col("confidence") < 0.80).cast("double"))  # of lines that have a confidence
    page = rows.groupBy("doc_id", "page").agg(mean.alias("mean"), low.alias("low"), F.sum("chars").alias("chars"), (F.sum("odd") / F.greatest(F.sum("size"), F.lit(1))).alias("odd"))
    severe = (F.col("mean") < 0.60) | (F.col("chars") == 0) | (F.col("odd") > 0.10)
    warning = (F.col("mean") < 0.80) | (F.col("low") > 0.30) | (F.col("chars") < 20) | (F.col("odd") > 0.02)
    return page.withColumn("quality", F.when(severe, "severe").when(warning, "warning").otherwise("ok"))


def failed_documents(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_severe, longest_run, failed: a fifth severe, five in a row or ten in all fail a document."""
    bad = F.col("quality") == "severe"
    by = W.partitionBy("doc_id").orderBy("page")
    run = F.row_number().over(by) - F.sum(F.when(bad, 1).otherwise(0)).over(by)
    runs = pages.withColumn("run", run).groupBy("doc_id", "run").agg(F.count("*").alias("n"), count_if(bad).alias("severe"))
    total = runs.groupBy("doc_id").agg(F.sum("n").alias("n_pages"), F.sum("severe").alias("n_severe"), F.max("severe").alias("longest_run"))
    return total.withColumn("failed", (F.col("n_severe") / F.col("n_pages") >= 0.20) | (F.col("longest_run") >= 5) | (F.col("n_severe") >= 10))


def embedding_consistency(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks (chunk_id, vector_id, status) against vectors (chunk_id, vector_id): one row of counts and the verdict."""
    done = chunks.filter("status = 'success'").select("vector_id", F.col("chunk_id").alias("db_chunk"))
    diff = done.join(vectors.select("vector_id", F.col("chunk_id").alias("file_chunk")), "vector_id", "full_outer")
    diff = diff.agg(count_if(F.col("db_chunk").isNull()).alias("unknown"), count_if(F.col("file_chunk").isNull()).alias("missing"), count_if(F.col("db_chunk") != F.col("file_chunk")).alias("mismatched"))
    base = chunks.agg(F.count("*").alias("chunks"), count_if(F.col("status") == "success").alias("success"), count_if(F.col("status") == "failed").alias("failed"), count_if(F.col("vector_id").isNotNull()).alias("mapped"), F.countDistinct("vector_id").alias("mapped_distinct"), count_if(F.col("vector_id") < 0).alias("negative"))
    both = base.crossJoin(diff)  # one row and one row
    return both.withColumn("consistent", (F.col("unknown") + F.col("missing") + F.col("mismatched") + F.col("negative") == 0) & (F.col("mapped") == F.col("mapped_distinct")))


#: What makes Spark take counts and bounds from Parquet's footers: the newer of its two readers, and leave to push down to it.
FROM_FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def from_footers(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in FROM_FOOTERS}
    for k, v in FROM_FOOTERS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def figures(spark: SparkSession, path: str, column: str) -> DataFrame:
    """n, filled, low, high of a whole-number column of a Parquet table; within from_footers() no row is read for it."""
    c = F.col(column)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count(c).alias("filled"), F.min(c).alias("low"), F.max(c).alias("high"))


def quick_consistency(spark: SparkSession, chunks: str, chunk_vector: str, vectors: str, vector_id: str) -> DataFrame:
    """One row of what footers tell of two Parquet tables: their counts, filled ids, bounds of ids, and whether nothing speaks
    against each mapped chunk having its vector. What it calls consistent may still not be; embedding_consistency() tells."""
    names = ("n", "filled", "low", "high")
    with from_footers(spark):
        a, b = (kept(figures(spark, *of)) for of in ((chunks, chunk_vector), (vectors, vector_id)))  # a row each, made while the settings hold
    a, b = a.toDF(*[f"chunk_{c}" for c in names]), b.toDF(*[f"vector_{c}" for c in names])
    alike = (F.col("chunk_filled") == F.col("vector_n")) & (F.col("vector_filled") == F.col("vector_n")) & F.col("chunk_low").eqNullSafe(F.col("vector_low")) & F.col("chunk_high").eqNullSafe(F.col("vector_high"))
    return a.crossJoin(b).withColumn("consistent", alike)  # one row each
