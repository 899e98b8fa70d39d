"""Statute structure: section paths, inherited articles, blocks of several articles, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.functions import ids, text as T


def in_order(doc: str, index: str):
    return W.partitionBy(doc).orderBy(index).rowsBetween(W.unboundedPreceding, W.currentRow)


def running(condition: Column, doc: str, index: str) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).over(in_order(doc, index))


def section_paths(blocks: DataFrame, doc: str = "doc_id", index: str = "block_index", text: str = "text") -> DataFrame:
    """Adds law_level, section_path and article_no.

    A heading opens a group; the path is the group's part, chapter and section. A chapter takes off what says 章 or 节, a
    section what says 节, titles included. An article holds until the next heading.
    """
    b = blocks.withColumn("_t", T.strip(text)).withColumn("law_level", T.level("_t"))
    level, by = F.col("law_level"), in_order(doc, index)
    part, chapter, section, article = (level == name for name in ("编", "章", "节", "条"))

    def latest(within: Column, value: Column) -> Column:
        """value at the last row of which within is true: all of it is read from one window in one order."""
        return F.last(F.when(within, F.struct(value.alias("v"))), ignorenulls=True).over(by)["v"]

    at = lambda of: F.coalesce(F.last(F.when(of, F.col(index)), ignorenulls=True).over(by), F.lit(-1))
    b = b.select(
        "*", latest(part, F.col("_t")).alias("_p"), latest(part | chapter, F.when(chapter, F.col("_t"))).alias("_c"), latest(part | chapter | section, F.when(section, F.col("_t"))).alias("_s"),
        latest(part | chapter | section | article, F.when(article, T.numbered("_t", "条"))).alias("article_no"), at(part).alias("_at_p"), at(chapter).alias("_at_c"), at(section).alias("_at_s"),
    )
    seen_c, seen_s, in_c = F.col("_at_c") > F.col("_at_p"), F.col("_at_s") > F.col("_at_p"), F.col("_at_s") > F.greatest("_at_p", "_at_c")
    first = F.when(~((seen_c & F.col("_p").rlike("[章节]")) | (seen_s & F.col("_p").contains("节"))), F.col("_p"))
    second = F.when(~(in_c & F.col("_c").contains("节")), F.col("_c"))
    path = F.nullif(F.concat_ws(" / ", first, second, F.col("_s")), F.lit(""))
    return b.withColumn("section_path", path).drop("_t", "_p", "_c", "_s", "_at_p", "_at_c", "_at_s")


def split_articles(blocks: DataFrame, doc: str = "doc_id", index: str = "block_index", text: str = "text") -> DataFrame:
    """Blocks with two or more lines that begin an article become one block for each, numbered index * 1000 + part."""
    starts = f"^第{T.CN_NUMERAL}条"
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), lambda line: T.strip(line))
    b = blocks.withColumn("_lines", lines).withColumn("_n", F.size(F.filter("_lines", lambda line: line.rlike(starts))))
    one = b.filter(F.col("_n") < 2).drop("_lines", "_n").withColumn("part", F.lit(None).cast("long"))
    starts_at = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(starts) & (i > 0), i)), lambda i: i.isNotNull())
    begin, end = F.concat(F.array(F.lit(0)), starts_at), F.concat(starts_at, F.array(F.size("_lines")))
    parts = F.zip_with(begin, end, lambda a, z: T.strip(F.array_join(F.slice("_lines", a + 1, z - a), "\n")))
    many = b.filter(F.col("_n") >= 2).select(*blocks.columns, F.posexplode_outer(parts).alias("_part", "_text")).filter("_text <> ''")
    split = many.select(*[(F.col("_text") if c == text else F.col(index) * 1000 + F.col("_part") if c == index else F.col(c)).alias(c) for c in blocks.columns], F.col("_part").cast("long").alias("part"))
    return one.unionByName(split)


def drop_heading_runs(blocks: DataFrame, doc: str = "doc_id", index: str = "block_index") -> DataFrame:
    """Drops each run of headings in which a level repeats, as in a table of contents. blocks have law_level."""
    heading = F.coalesce(F.col("law_level").isin(*T.HEADINGS), F.lit(False))
    b = blocks.withColumn("_run", F.coalesce(running(~heading, doc, index), F.lit(0))).withColumn("_h", heading)
    run = W.partitionBy(doc, "_run")
    levels = F.size(F.collect_set(F.when(F.col("_h"), F.col("law_level"))).over(run))
    b = b.withColumn("_repeats", F.sum(F.when(F.col("_h"), 1).otherwise(0)).over(run) > levels)
    return b.filter(~(F.col("_h") & F.col("_repeats"))).drop("_run", "_h", "_repeats")


def block_records(blocks: DataFrame, doc: str = "doc_id", index: str = "block_index") -> DataFrame:
    """blocks (doc, index, text, law_level, section_path, article_no) as records of a fixed set of columns; an unknown level is null."""
    known = F.when(F.col("law_level").isin(*dict(T.LEVELS)), F.col("law_level"))
    return blocks.select(ids.structured_block_id(F.col(doc), F.col(index)).alias("block_id"), doc, index, "text", known.alias("law_level"), "section_path", "article_no")
