"""Prompt context: history and evidence within token budgets, and the list of references."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.functions import text as T

HISTORY, CONTEXT, MOST_CHUNK, LEAST_CHUNK = 768, 4096, 1200, 80
SPOKEN = {"user": "用户：", "assistant": "助手："}


def latest_question(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question: the last user turn that is not blank."""
    asked = turns.filter((F.col("role") == "user") & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    return asked.groupBy("conv_id").agg(F.max(F.struct("turn", T.strip("text").alias("question"))).alias("m")).select("conv_id", "m.*")


def history_lines(turns: DataFrame) -> DataFrame:
    """Lines before the latest question, newest first, with the tokens left before each."""
    lines = turns.join(latest_question(turns).select("conv_id", F.col("turn").alias("asked_at")), "conv_id").filter(F.col("turn") < F.col("asked_at"))
    said = F.when(F.col("role") == "user", SPOKEN["user"]).when(F.col("role") == "assistant", SPOKEN["assistant"])
    lines = lines.withColumn("line", F.concat(said, T.strip("text"))).filter(said.isNotNull() & (T.strip("text") != "")).withColumn("tokens", T.tokens_by_bytes("line"))
    newer = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("before", F.coalesce(F.sum("tokens").over(newer), F.lit(0)).cast("long"))


def history_window(turns: DataFrame, budget: int = HISTORY, whole_only: bool = False) -> DataFrame:
    """conv_id, turn, line: as many newest lines as fit; the first that does not is cut to the rest, unless whole_only."""
    lines = history_lines(turns)
    whole = lines.filter(F.col("before") + F.col("tokens") <= budget).select("conv_id", "turn", "line", F.lit(False).alias("cut"))
    if whole_only:
        return whole

    def shortened(line: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([T.truncated(t, budget - int(b)) for t, b in zip(line, before, strict=True)])

    cut = F.pandas_udf(shortened, "string")
    first = lines.filter((F.col("before") + F.col("tokens") > budget) & (F.col("before") < budget)).withColumn("line", cut("line", "before"))
    return whole.unionByName(first.filter("line <> ''").select("conv_id", "turn", "line", F.lit(True).alias("cut")))


def evidence(no: int, title: str, location: str, content: str) -> str:
    return json.dumps({"evidence_no": no, "title": title, "location": location, "content": content}, ensure_ascii=False, separators=(",", ":"))


def fit(no: int, title: str, location: str, source: str, room: int, most: int, least: int) -> tuple[str, int, bool] | None:
    """The content that fits into room as an evidence line, its tokens and whether it was cut; None if too little fits."""
    cost = lambda content: T.count_by_bytes(evidence(no, title, location, content))
    content = T.truncated(source, most)
    if not content:
        return None
    if cost(content) > room:
        low, high, content = 1, most, ""
        while low <= high:
            middle = (low + high) // 2
            tried = T.truncated(source, middle)
            if tried and cost(tried) <= room:
                content, low = tried, middle + 1
            else:
                high = middle - 1
        if not content:
            return None
    cut = content != source
    if cut and T.count_by_bytes(content) < least:
        return None
    return content, cost(content), cut


PACKED = "query_id long, evidence_no long, chunk_id string, content string, tokens long, cut boolean"


def pack_evidence(hits: DataFrame, budget: int = CONTEXT, most: int = MOST_CHUNK, least: int = LEAST_CHUNK) -> DataFrame:
    """hits (query_id, rank, chunk_id, title, location, text) to numbered evidence within budget, query by query.

    A query's hits stream through a task in rank order; no query is held whole, and of a text only the characters go there that
    most tokens could show, and one more, which tells that it is cut. Hits without a query id are one query's.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, used, no = "none yet", 0, 0
        seen: set[str] = set()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                asks = None if pd.isna(r.query_id) else int(r.query_id)
                if asks != query:
                    query, used, no, seen = asks, 0, 0, set()
                source = r.text or ""
                if used >= budget or r.chunk_id in seen or not source:
                    continue
                seen.add(r.chunk_id)
                if got := fit(no + 1, r.title or "", r.location or "", source, budget - used, most, least):
                    no, used = no + 1, used + got[1]
                    out.append((query, no, r.chunk_id, *got))
            yield pd.DataFrame(out, columns=["query_id", "evidence_no", "chunk_id", "content", "tokens", "cut"]).astype({"query_id": "Int64"})

    shown = F.substring(T.strip("text"), 1, 2 * most + 1)
    rows = hits.select("query_id", "rank", F.col("chunk_id").cast("string"), "title", "location", shown.alias("text"))
    return rows.repartition("query_id").sortWithinPartitions("query_id", "rank").mapInPandas(pack, PACKED)


def reference_key(path: Column, doc_id: Column) -> Column:
    parts = F.filter(F.split(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.size(parts) > 0, F.concat(F.lit("path:"), F.lower(F.array_join(parts, "/")))).otherwise(F.concat(F.lit("doc:"), F.lower(doc_id)))


def reference_list(hits: DataFrame) -> DataFrame:
    """hits (query_id, evidence_no, path, doc_id, name, location) to one row per query and file, in order of first use."""
    rows = hits.withColumn("key", reference_key(F.col("path"), F.col("doc_id").cast("string")))
    used = F.array_sort(F.collect_list(F.struct("evidence_no", "location", "name")))
    files = rows.groupBy("query_id", "key").agg(used.alias("u"))
    files = files.select("query_id", "key", F.col("u")[0]["evidence_no"].alias("first"), F.col("u")[0]["name"].alias("name"), F.array_distinct(F.col("u.evidence_no")).alias("nos"), F.array_distinct(F.filter("u.location", lambda x: F.coalesce(x, F.lit("")) != "")).alias("places"))
    return files.withColumn("reference_no", F.row_number().over(W.partitionBy("query_id").orderBy("first")).cast("long"))


def reference_section(files: DataFrame) -> DataFrame:
    """query_id, section: the rendered list."""
    nos = F.array_join(F.transform("nos", lambda n: F.concat(F.lit("[资料"), n.cast("string"), F.lit("]"))), "、")
    places = F.when(F.size("places") > 0, F.concat(F.lit("\n    位置："), F.array_join("places", "；"))).otherwise("")
    entry = F.concat(F.lit("["), F.col("reference_no").cast("string"), F.lit("] "), F.col("name"), places, F.lit("\n    对应资料："), nos)
    entries = F.array_sort(F.collect_list(F.struct("reference_no", entry.alias("entry"))))
    return files.groupBy("query_id").agg(entries.alias("e")).select("query_id", F.concat(F.lit("参考文件：\n"), F.array_join(F.transform("e", lambda s: s["entry"]), "\n\n")).alias("section"))
