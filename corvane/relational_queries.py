"""Queries of selection, matching, counting, layers, context and reports over the driver's tables, and the SQL that states the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvane.functions import text as T
from corvane.operators import chunking, context, layers, quality, structure
from corvane.registry import long, query, read
from corvane.retrieval_queries import BLOCKS_SQL, LINES_SQL, STRUCTURED_SQL, sql_strip, sql_truncated, statute_documents, structured, texts
from corvane.sources import files

STATUS_SQL = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'pending' END"


def orders_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as source files: path, suffix, parse status."""
    s = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("v1", "v2", "x"))), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 4 == 0, ".DOC").when(F.col("o_custkey") % 4 == 1, ".txt").otherwise(".docx"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", s.alias("status"), path.alias("path"))


FILES_SQL = f"files AS (SELECT o_orderkey, o_custkey, o_totalprice, {STATUS_SQL} AS status, ['v1', 'v2', 'x'][(o_orderkey % 3 + 1)::INT] || '/' || o_orderkey || CASE o_custkey % 4 WHEN 0 THEN '.DOC' WHEN 1 THEN '.txt' ELSE '.docx' END AS path FROM orders)"


# ---- F, S: selection ----


@query("f1_parse_candidates", f"WITH {FILES_SQL} SELECT 'all' AS mode, count(*) AS n, min(path) AS first_path FROM files WHERE lower(path) LIKE '%.docx' UNION ALL SELECT 'resume', count(*), min(path) FROM files WHERE lower(path) LIKE '%.docx' AND (status IS NULL OR status NOT IN ('success', 'failed')) UNION ALL SELECT 'force', count(*), min(path) FROM files WHERE lower(path) LIKE '%.docx' AND (status IS NULL OR status <> 'success')")
def f1(spark, sf_dir):
    f = orders_as_files(spark, sf_dir).filter(files.suffix(F.col("path")) == ".docx")
    modes = {"all": F.lit(True), "resume": F.col("status").isNull() | ~F.col("status").isin("success", "failed"), "force": F.col("status").isNull() | (F.col("status") != "success")}
    return reduce(DataFrame.union, [f.filter(c).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).select(F.lit(m).alias("mode"), "n", "first_path") for m, c in modes.items()])


@query("f2_pending_embeddings", f"WITH {FILES_SQL} SELECT o_orderkey, path FROM files WHERE status IS NULL OR status <> 'success' ORDER BY o_custkey, o_orderkey LIMIT 500")
def f2(spark, sf_dir):
    return orders_as_files(spark, sf_dir).filter("status is null or status <> 'success'").orderBy("o_custkey", "o_orderkey").limit(500).select("o_orderkey", "path")


@query("s3_f5_volumes", f"WITH {FILES_SQL} SELECT CASE split_part(path, '/', 1) WHEN 'v1' THEN 'vol1' WHEN 'v2' THEN 'vol2' ELSE 'unknown' END AS volume, lower(regexp_extract(path, '\\.[^./]+$')) AS suffix, count(*) AS n, sum(o_custkey)::BIGINT AS bytes, count(*) FILTER (WHERE lower(path) NOT LIKE '%.txt') AS word_files FROM files GROUP BY 1, 2")
def s3(spark, sf_dir):
    f = orders_as_files(spark, sf_dir).select("path", F.col("o_custkey").alias("length"), files.volume(F.col("path"), {"v1": "vol1", "v2": "vol2"}).alias("volume"))
    return files.scan_summary(f)


@query("s2_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def s2(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("s1_file_scan")
def s1(spark, sf_dir):
    """Every file below the folder."""
    return files.scan(spark, sf_dir).select(files.base_name(F.col("path")).alias("name"), "length", "sha256", "suffix", "is_word")


@query("s7_paragraphs", f"WITH {LINES_SQL}, s AS (SELECT doc_id, i, {sql_strip('line')} AS s FROM lines), g AS (SELECT *, sum((s = '')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS paragraph FROM s) SELECT doc_id, paragraph::BIGINT AS paragraph, string_agg(s, ' ' ORDER BY i) AS text FROM g WHERE s <> '' GROUP BY 1, 2")
def s7(spark, sf_dir):
    return files.paragraphs(texts(spark, sf_dir))


PAGES_SQL = """lines AS (SELECT l_suppkey AS doc_id, l_partkey % 40 AS page, CASE WHEN l_quantity < 6 THEN '' ELSE repeat('x', l_quantity::INT) END AS text, (l_quantity + 40) / 100 AS confidence FROM lineitem),
p AS (SELECT doc_id, page, avg(confidence) AS mean, avg((confidence < 0.80)::INT::DOUBLE) AS low, sum(length(text)) AS chars FROM lines GROUP BY doc_id, page),
pages_q AS (SELECT *, CASE WHEN mean < 0.60 OR chars = 0 THEN 'severe' WHEN mean < 0.80 OR low > 0.30 OR chars < 20 THEN 'warning' ELSE 'ok' END AS quality FROM p)"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and their place in the table, whose rows no key puts in order."""
    q, place = F.col("l_quantity"), F.struct("_metadata.file_path", "_metadata.row_index")
    return read(spark, sf_dir, "lineitem").select(place.alias("place"), F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 40).alias("page"), F.when(q < 6, "").otherwise(F.repeat(F.lit("x"), q.cast("int"))).alias("text"), ((q + 40) / 100).alias("confidence"))


@query("s10_page_quality", f"WITH {PAGES_SQL} SELECT doc_id, page, chars::BIGINT AS chars, round(mean, 6) AS mean, quality FROM pages_q")
def s10(spark, sf_dir):
    return quality.page_quality(page_lines(spark, sf_dir), "place").select("doc_id", "page", "chars", F.round("mean", 6).alias("mean"), "quality")


@query("s11_failed_documents", f"""WITH {PAGES_SQL}, r AS (SELECT *, row_number() OVER w - sum((quality = 'severe')::INT) OVER w AS run FROM pages_q WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
g AS (SELECT doc_id, run, count(*) AS n, count(*) FILTER (WHERE quality = 'severe') AS severe FROM r GROUP BY doc_id, run)
SELECT doc_id, sum(n)::BIGINT AS n_pages, sum(severe)::BIGINT AS n_severe, max(severe)::BIGINT AS longest_run, sum(severe) / sum(n) >= 0.20 OR max(severe) >= 5 OR sum(severe) >= 10 AS failed FROM g GROUP BY doc_id""")
def s11(spark, sf_dir):
    return quality.failed_documents(quality.page_quality(page_lines(spark, sf_dir), "place"))


@query("s15_incoming_snapshot", "WITH f AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN '~$' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE 'f' || (c_custkey // 2) END || CASE WHEN c_custkey % 7 = 0 THEN '.xls' WHEN c_custkey % 2 = 0 THEN '.DOCX' ELSE '.docx' END AS name, c_custkey % 11 = 0 AS is_folder FROM customer) SELECT name, is_folder, CASE WHEN is_folder THEN 'IGNORED_FOLDER' WHEN lower(name) LIKE '%.xls' THEN 'UNSUPPORTED' WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN 'NAME_COLLISION' ELSE 'FROZEN' END AS state FROM f WHERE NOT starts_with(name, '~$')")
def s15(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 50 == 0, "~$").otherwise(""), F.when(k % 3 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit("f"), F.floor(k / 2).cast("string"))), F.when(k % 7 == 0, ".xls").when(k % 2 == 0, ".DOCX").otherwise(".docx"))
    return files.snapshot(read(spark, sf_dir, "customer").select(name.alias("name"), (k % 11 == 0).alias("is_folder")))


@query("s13_vector_file_check", "SELECT count(*) AS n, count(*) FILTER (WHERE label = 3) AS blank_chunks, count(*) FILTER (WHERE vec_id % 10 = 0) AS bad_vectors, (SELECT count(*) FROM (SELECT vec_id // 2 FROM embeddings WHERE vec_id < 20 GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids FROM embeddings")
def s13(spark, sf_dir):
    from corvane.sources.records import vector_faults

    v = F.col("vec_id")
    vectors = read(spark, sf_dir, "embeddings").select(F.when(v < 20, F.floor(v / 2)).otherwise(v).alias("vector_id"), F.when(F.col("label") == 3, "").otherwise("c").alias("chunk_id"), F.when(v % 10 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    return vector_faults(vectors, 64)


@query("s20_ordered_blocks", f"WITH {STRUCTURED_SQL} SELECT doc_id, block_index, text, law_level FROM structured ORDER BY doc_id, block_index")
def s20(spark, sf_dir):
    return structured(spark, sf_dir).orderBy("doc_id", "block_index").select("doc_id", "block_index", "text", "law_level")


LEGACY_SQL = "paths AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A\\b/' ELSE 'c/' END || CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '-' || (doc_id // 4) || '.TXT' AS path, sha256(coalesce(text, '')) AS digest FROM documents)"


@query("s21_legacy_identities", f"WITH {LEGACY_SQL}, k AS (SELECT lower(regexp_extract(path, '([^/\\\\]+)$', 1)) AS key, doc_id, digest FROM paths) SELECT key, count(*) AS n, min(doc_id) AS doc_id, arg_min(digest, doc_id) AS digest, count(*) > 1 AS collides FROM k GROUP BY key")
def s21(spark, sf_dir):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 3 == 0, "A\\b/").otherwise("c/"), F.when(i % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("-"), F.floor(i / 4).cast("string"), F.lit(".TXT"))
    return layers.legacy_identities(read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")))


@query("f14_latest_question", f"SELECT conv_id, turn, question FROM (SELECT conv_id, turn, {sql_strip('text')} AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user' AND {sql_strip('text')} <> '') WHERE k = 1")
def f14(spark, sf_dir):
    return context.latest_question(read(spark, sf_dir, "conversations"))


EDGES = [("view", "click"), ("click", "purchase"), ("view", "purchase"), ("signup", "view"), ("click", "view"), ("purchase", "view")]


@query("f15_illegal_transitions", "WITH t AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS a, event_type AS b FROM events) SELECT a AS from_state, b AS to_state, count(*) AS n FROM t WHERE a IS NOT NULL AND (a, b) NOT IN (" + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + ") GROUP BY a, b")
def f15(spark, sf_dir):
    steps = read(spark, sf_dir, "events").withColumn("from_state", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))).filter("from_state is not null").select("from_state", F.col("event_type").alias("to_state"))
    legal = spark.createDataFrame(EDGES, "from_state string, to_state string")
    return steps.join(F.broadcast(legal), ["from_state", "to_state"], "left_anti").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


# ---- J: joins ----


@query("j1_left_joins", "SELECT o_orderkey, c_name, l.quality::BIGINT AS quality FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN labels l ON o_orderkey = l.doc_id")
def j1(spark, sf_dir):
    o, c, labels = (read(spark, sf_dir, t) for t in ("orders", "customer", "labels"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(labels, o.o_orderkey == labels.doc_id, "left").select("o_orderkey", "c_name", long("quality").alias("quality"))


@query("j2_a10_match_summary", "WITH r AS (SELECT DISTINCT o_custkey AS k FROM orders), f AS (SELECT DISTINCT c_custkey AS k FROM customer) SELECT count(*) FILTER (WHERE r.k IS NOT NULL AND f.k IS NOT NULL) AS matched, count(*) FILTER (WHERE f.k IS NULL) AS records_only, count(*) FILTER (WHERE r.k IS NULL) AS files_only, (SELECT count(*) FILTER (WHERE o_orderstatus IS NULL OR o_orderstatus = '') FROM orders) AS missing_o_orderstatus, (SELECT count(*) FILTER (WHERE o_custkey % 9 = 0) FROM orders) AS missing_note FROM r FULL JOIN f ON r.k = f.k")
def j2(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k").withColumn("note", F.when(F.col("k") % 9 == 0, "").otherwise("x"))
    return quality.match_summary(o, read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), "k", ["o_orderstatus", "note"])


@query("j3_j4_hydrate_hits", "SELECT e.vec_id, d.source, d.lang, round(e.embedding[1]::DOUBLE, 6) AS score FROM (SELECT * FROM embeddings ORDER BY embedding[1] DESC, vec_id LIMIT 80) e JOIN documents d ON d.doc_id = e.vec_id JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1")
def j3(spark, sf_dir):
    hits = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("score")).orderBy(F.desc("score"), "vec_id").limit(80)
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return docs.join(F.broadcast(hits), docs.doc_id == hits.vec_id).join(labels, "doc_id").select("vec_id", "source", "lang", F.round("score", 6).alias("score"))  # 80 hits


@query("j7_docs_without_labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j7(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("j8_orphans", "SELECT 'lineitem' AS child, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def j8(spark, sf_dir):
    line, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
    a = line.join(o.filter("o_orderkey % 10 <> 0"), line.l_orderkey == o.o_orderkey, "left_anti")
    return one("lineitem", a).union(one("orders", o.join(c.filter("c_custkey % 10 <> 0"), o.o_custkey == c.c_custkey, "left_anti")))


@query("j9_j10_limited_semi", "WITH d AS (SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100) SELECT doc_id, source FROM d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def j9(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(100)
    return d.join(read(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("j11_docs_with_table_rows", "SELECT doc_id FROM documents WHERE contains(text, ' | ')")
def j11(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").contains(" | "))
    return read(spark, sf_dir, "documents").select("doc_id").join(rows, "doc_id", "left_semi")


CHUNKS_SQL = "chunks AS (SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 4 < 3 THEN doc_id END AS vector_id, CASE doc_id % 4 WHEN 3 THEN 'failed' ELSE 'success' END AS status FROM documents), vectors AS (SELECT CASE WHEN vec_id % 13 = 0 THEN 'x' ELSE vec_id::VARCHAR END AS chunk_id, vec_id AS vector_id FROM embeddings WHERE vec_id % 4 < 3 OR vec_id % 8 = 7)"


@query("j12_a19_d7_consistency", f"""WITH {CHUNKS_SQL}, d AS (SELECT c.chunk_id AS a, v.chunk_id AS b FROM (SELECT * FROM chunks WHERE status = 'success') c FULL JOIN vectors v USING (vector_id))
SELECT *, unknown + missing + mismatched + negative = 0 AND mapped = mapped_distinct AS consistent FROM (SELECT count(*) AS chunks, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(vector_id) AS mapped, count(DISTINCT vector_id) AS mapped_distinct, count(*) FILTER (WHERE vector_id < 0) AS negative FROM chunks),
(SELECT count(*) FILTER (WHERE a IS NULL) AS unknown, count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a <> b) AS mismatched FROM d)""")
def j12(spark, sf_dir):
    i, v = F.col("doc_id"), F.col("vec_id")
    chunks = read(spark, sf_dir, "documents").select(i.cast("string").alias("chunk_id"), F.when(i % 4 < 3, i).alias("vector_id"), F.when(i % 4 == 3, "failed").otherwise("success").alias("status"))
    vectors = read(spark, sf_dir, "embeddings").filter((v % 4 < 3) | (v % 8 == 7)).select(F.when(v % 13 == 0, "x").otherwise(v.cast("string")).alias("chunk_id"), v.alias("vector_id"))
    return quality.embedding_consistency(chunks, vectors)


@query("j13_newest_identity", "SELECT key, layer, digest FROM (SELECT source AS key, doc_id % 3 AS layer, sha256(text) AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3 DESC, doc_id DESC) AS k FROM documents) WHERE k = 1")
def j13(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("key"), (F.col("doc_id") % 3).alias("layer"), "doc_id", F.sha2("text", 256).alias("digest"))
    best = rows.groupBy("key").agg(F.max_by(F.struct("layer", "digest"), F.struct("layer", "doc_id")).alias("b"))  # combines before the shuffle, whatever a key's rows
    return best.select("key", "b.layer", "b.digest")


# ---- A: aggregates ----


@query("a1_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "labels", "events")) + " UNION ALL SELECT 'chunk_fts', -1")
def a1(spark, sf_dir):
    return quality.table_counts({t: read(spark, sf_dir, t) for t in ("documents", "pages", "labels", "events")} | {"chunk_fts": None})


@query("a2_a3_status_counts", f"WITH {FILES_SQL} SELECT coalesce(status, 'null') AS status, count(*) AS n FROM files GROUP BY 1")
def a2(spark, sf_dir):
    return quality.group_counts(orders_as_files(spark, sf_dir), F.col("status"), "status")


@query("a4_a5_a6_a8_chunk_figures", f"WITH {CHUNKS_SQL} SELECT count(DISTINCT chunk_id) AS docs, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE vector_id IS NULL) AS unmapped, count(vector_id) AS mapped, count(DISTINCT vector_id) AS mapped_distinct, coalesce(max(vector_id), -1) AS max_vector_id FROM chunks")
def a4(spark, sf_dir):
    i = F.col("doc_id")
    c = read(spark, sf_dir, "documents").select(i.cast("string").alias("chunk_id"), F.when(i % 4 < 3, i).alias("vector_id"), F.when(i % 4 == 3, "failed").otherwise("success").alias("status"))
    return c.agg(F.countDistinct("chunk_id").alias("docs"), quality.count_if(F.col("status") == "success").alias("success"), quality.count_if(F.col("vector_id").isNull()).alias("unmapped"), F.count("vector_id").alias("mapped"), F.countDistinct("vector_id").alias("mapped_distinct"), F.coalesce(F.max("vector_id"), F.lit(-1)).alias("max_vector_id"))


@query("a7_repeated_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def a7(spark, sf_dir):
    return layers.repeated_ids(read(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", F.col("count").alias("n"))


@query("a11_parse_figures", f"WITH {LINES_SQL}, d AS (SELECT doc_id, count(*) FILTER (WHERE line <> '') AS paragraphs, sum(length(line)) AS chars, count(*) FILTER (WHERE contains(line, ' | ')) AS rows FROM lines GROUP BY doc_id) SELECT count(*) AS docs, round(avg(paragraphs), 6) AS avg_paragraphs, round(avg(chars), 6) AS avg_chars, sum(rows)::BIGINT AS table_rows, count(*) FILTER (WHERE rows > 0) AS docs_with_tables FROM d")
def a11(spark, sf_dir):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    d = read(spark, sf_dir, "documents").select(F.size(F.filter(lines, lambda x: x != "")).alias("paragraphs"), (F.char_length(F.coalesce("text", F.lit(""))) - F.size(lines) + 1).alias("chars"), F.size(F.filter(lines, lambda x: x.contains(" | "))).alias("rows"))
    return d.agg(F.count("*").alias("docs"), F.round(F.avg("paragraphs"), 6).alias("avg_paragraphs"), F.round(F.avg("chars"), 6).alias("avg_chars"), F.sum("rows").alias("table_rows"), quality.count_if(F.col("rows") > 0).alias("docs_with_tables"))


@query("a13_chunk_sizes", "SELECT source, count(*) AS n, max(t) AS max_tokens, count(*) FILTER (WHERE t > 1200) AS over_max FROM (SELECT source, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 0.7::DOUBLE))::BIGINT END AS t FROM documents) GROUP BY source")
def a13(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", T.tokens_by_chars("text").alias("t"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.max("t").alias("max_tokens"), quality.count_if(F.col("t") > 1200).alias("over_max"))


@query("a14_final_states", "SELECT user_id, purchase, total, CASE WHEN purchase = total THEN 'COMPLETED' WHEN purchase > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS state FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) AS total FROM events GROUP BY user_id)")
def a14(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(quality.count_if(F.col("event_type") == "purchase").alias("purchase"), F.count("*").alias("total"))
    return e.withColumn("state", F.when(F.col("purchase") == F.col("total"), "COMPLETED").when(F.col("purchase") > 0, "PARTIAL").otherwise("FAILED"))


@query("a15_match_rates", "SELECT d.source, count(*) AS n, round(count(l.doc_id)::DOUBLE / count(*), 9) AS rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def a15(spark, sf_dir):
    d, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("found"))
    return d.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.round(F.count("found") / F.count("*"), 9).alias("rate"))


HITS_SQL = "hits AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS evidence_no, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'A/./' || (l_suppkey % 3) || '.TXT' END AS path, l_suppkey % 2 AS doc_id, 'n' || (l_suppkey % 3) AS name, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'p' || (l_partkey % 3) END AS location FROM lineitem)"


def reference_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    text = lambda c: c.cast("string")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), no.cast("long").alias("evidence_no"), F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("A/./"), text(s % 3), F.lit(".TXT"))).alias("path"), (s % 2).alias("doc_id"), F.concat(F.lit("n"), text(s % 3)).alias("name"), F.when(p % 4 == 0, "").otherwise(F.concat(F.lit("p"), text(p % 3))).alias("location"))


@query("a16_x11_h6_references", f"""WITH {HITS_SQL}, k AS (SELECT *, CASE WHEN path = '' THEN 'doc:' || doc_id ELSE 'path:' || lower(replace(path, '/./', '/')) END AS key FROM hits),
loc AS (SELECT query_id, key, location, min(evidence_no) AS pos FROM k WHERE location <> '' GROUP BY ALL),
places AS (SELECT query_id, key, string_agg(location, '；' ORDER BY pos) AS places FROM loc GROUP BY ALL),
f AS (SELECT query_id, key, min(evidence_no) AS first, arg_min(name, evidence_no) AS name, string_agg('[资料' || evidence_no || ']', '、' ORDER BY evidence_no) AS nos FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS no FROM f LEFT JOIN places USING (query_id, key))
SELECT query_id, '参考文件：' || chr(10) || string_agg('[' || no || '] ' || name || CASE WHEN places IS NULL THEN '' ELSE chr(10) || '    位置：' || places END || chr(10) || '    对应资料：' || nos, chr(10) || chr(10) ORDER BY no) AS section FROM r GROUP BY query_id""")
def a16(spark, sf_dir):
    return context.reference_section(context.reference_list(reference_hits(spark, sf_dir)))


@query("a17_block_hash", f"WITH {BLOCKS_SQL} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY block_index)) AS digest FROM blocks GROUP BY doc_id")
def a17(spark, sf_dir):
    return statute_documents(spark, sf_dir).select("doc_id", F.sha2(F.array_join("blocks", "\n"), 256).alias("digest"))


@query("a18_disk_needed", "SELECT ceil((sum(n_chars) + 3 * max(n_chars) + 1000) * 1.2::DOUBLE)::BIGINT AS bytes FROM documents")
def a18(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.ceil((F.sum("n_chars") + 3 * F.max("n_chars") + 1000) * F.lit(1.2)).cast("long").alias("bytes"))


@query("a20_issue_categories", f"WITH {LINES_SQL}, i AS (SELECT CASE WHEN contains(line, ' | ') THEN 'table' WHEN contains(line, '###') THEN 'junk' WHEN contains(line, 'License') THEN 'license' WHEN line = '' THEN 'blank' ELSE 'text' END AS category FROM lines) SELECT category, count(*) AS n FROM i GROUP BY category")
def a20(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    has = lambda s: F.col("line").contains(s)
    return quality.group_counts(lines, F.when(has(" | "), "table").when(has("###"), "junk").when(has("License"), "license").when(F.col("line") == "", "blank").otherwise("text"), "category")


# ---- K, I: keyed writes and layers ----


@query("k1_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name) || '!', c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def k1(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.upper("c_name"), F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return layers.upsert(old, new, "c_custkey")


@query("k2_k4_replace_children", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, 1, sum(l_quantity) FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey")
def k2(spark, sf_dir):
    old = read(spark, sf_dir, "lineitem").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_quantity")
    new = old.filter("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.lit(1).cast("long").alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    return layers.replace_children(old, new, new, "l_orderkey")


@query("k5_update_by_key", "SELECT d.doc_id, coalesce(l.quality, d.doc_id)::BIGINT AS vector_id FROM documents d LEFT JOIN labels l USING (doc_id)")
def k5(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("vector_id"))
    return layers.update_by_key(rows, read(spark, sf_dir, "labels").select("doc_id", long("quality").alias("vector_id")), "doc_id", "vector_id")


@query("k7_chunk_sample", "SELECT doc_id, source, lang FROM documents ORDER BY source, doc_id LIMIT 100")
def k7(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang").orderBy("source", "doc_id").limit(100)


@query("k8_k16_i5_vector_ids", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) + (SELECT max(vec_id) FROM embeddings) AS vector_id FROM documents")
def k8(spark, sf_dir):
    first = (read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    return layers.assign_ids(read(spark, sf_dir, "documents").select("doc_id", "source"), first, ["source", "doc_id"]).select("doc_id", long("vector_id").alias("vector_id"))


LAYERS_SQL = "base AS (SELECT doc_id, source, NULL::VARCHAR AS extension, 0 AS layer FROM documents WHERE doc_id % 5 <> 0), delta AS (SELECT doc_id, source, '.txt' AS extension, 1 AS layer FROM documents WHERE doc_id % 5 = 0), both_layers AS (SELECT * FROM base UNION ALL SELECT * FROM delta)"


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return layers.stacked([d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 5 = 0").withColumn("extension", F.lit(".txt"))])


@query("s17_f11_i8_effective_view", f"WITH {LAYERS_SQL} SELECT doc_id, source, extension, layer::BIGINT AS layer FROM both_layers WHERE doc_id % 7 <> 0")
def s17(spark, sf_dir):
    dead = read(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select(F.col("doc_id").alias("entity_id"))
    return layers.effective(layered(spark, sf_dir), dead, "doc_id").select("doc_id", "source", "extension", "layer")


@query("i8_cross_layer_repeats", "SELECT source, count(DISTINCT layer) AS n FROM (SELECT source, doc_id % 5 = 0 AS layer FROM documents) GROUP BY source HAVING count(DISTINCT layer) > 1")
def i8(spark, sf_dir):
    once = layered(spark, sf_dir).select("source", "layer").distinct()
    return layers.repeated_ids(once, "source").select("source", F.col("count").alias("n"))


@query("i8_cross_layer_repeats_whole", "SELECT kind, id, count(DISTINCT layer) AS n FROM (SELECT 'source' AS kind, source AS id, doc_id % 5 = 0 AS layer FROM documents UNION ALL SELECT 'lang', lang, doc_id % 5 = 0 FROM documents) GROUP BY kind, id HAVING count(DISTINCT layer) > 1")
def i8_whole(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("id")) for c in ("source", "lang")])).alias("of")).select("doc_id", "of.*")
    once = layers.stacked([d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 5 = 0")]).select(F.struct("kind", "id").alias("key"), "layer").distinct()
    return layers.repeated_ids(once, "key").select("key.kind", "key.id", F.col("count").alias("n"))


KNOWN_SQL = "incoming AS (SELECT url AS key, sha256(html) AS digest FROM pages), known AS (SELECT CASE WHEN page_id % 4 = 3 THEN url || '?' ELSE url END AS key, CASE WHEN page_id % 4 = 1 THEN 'old' ELSE sha256(html) END AS digest FROM pages WHERE page_id % 4 > 0)"


@query("f10_intake_classes", f"WITH {KNOWN_SQL} SELECT i.key, CASE WHEN k.key IS NULL THEN 'NEW' WHEN k.digest = i.digest THEN 'DUPLICATE_UNCHANGED' ELSE 'UPDATE' END AS action, EXISTS (SELECT 1 FROM known o WHERE o.digest = i.digest AND o.key <> i.key) AS known_elsewhere FROM incoming i LEFT JOIN known k ON k.key = i.key")
def f10(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("digest"))
    part = F.col("page_id") % 4
    known = p.filter(part > 0).select(F.when(part == 3, F.concat("url", F.lit("?"))).otherwise(F.col("url")).alias("key"), F.when(part == 1, "old").otherwise(F.col("digest")).alias("digest"))
    return layers.classify(p.select(F.col("url").alias("key"), "digest"), known).select("key", "action", "known_elsewhere")


@query("i4_tombstones", "SELECT 'doc_version' AS entity_type, 'v' || doc_id AS entity_id FROM documents WHERE doc_id % 10 = 0 UNION SELECT 'chunk', (doc_id * 10 + n)::VARCHAR FROM documents, range(2) r(n) WHERE doc_id % 10 = 0 UNION SELECT 'vector', doc_id::VARCHAR FROM documents WHERE doc_id % 10 = 0")
def i4(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    versions = d.select("doc_id", F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version_id"))
    chunks = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select("doc_id", (F.col("doc_id") * 10 + F.col("n")).alias("chunk_id"), F.when(F.col("n") == 0, F.col("doc_id")).alias("vector_id"))
    return layers.tombstones_for(d.filter("doc_id % 10 = 0"), versions, chunks)


@query("i6_delta_validation", "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS parents, count(*) FILTER (WHERE l_linenumber < 0) AS negative, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated FROM lineitem")
def i6(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    counts = line.agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("parents"), quality.count_if(F.col("l_linenumber") < 0).alias("negative"))
    repeated = line.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").agg(F.count("*").alias("repeated"))
    return counts.crossJoin(repeated)  # one row and one row


@query("i12_retention", "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase') OR ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 3 DAY")
def i12(spark, sf_dir):
    from corvane.streaming.ingest import retained

    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_type").alias("state"), F.col("ts").alias("updated_at"))
    return retained(e, 3, "2024-01-10 00:00:00", ("purchase",)).select("event_id", "event_type")


# ---- context ----


HISTORY_SQL = f"""q AS (SELECT conv_id, max(turn) AS asked FROM conversations WHERE role = 'user' AND {sql_strip('text')} <> '' GROUP BY conv_id),
l AS (SELECT c.conv_id, turn, CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END || {sql_strip('text')} AS line FROM conversations c JOIN q USING (conv_id) WHERE turn < asked AND role IN ('user', 'assistant') AND {sql_strip('text')} <> ''),
t AS (SELECT *, ceil(octet_length(encode(line)) / 2)::BIGINT AS tokens FROM l),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t)"""


@query("w9_history_window", f"WITH {HISTORY_SQL} SELECT conv_id, turn, line FROM u WHERE used <= {context.HISTORY}")
def w9(spark, sf_dir):
    return context.history_window(read(spark, sf_dir, "conversations"), whole_only=True).select("conv_id", "turn", "line")


@query("w9_history_cut", f"""WITH {HISTORY_SQL}, first AS (SELECT conv_id, turn, line, {context.HISTORY} - (used - tokens) AS room FROM u WHERE used > {context.HISTORY} AND used - tokens < {context.HISTORY})
SELECT conv_id, turn, line, false AS cut FROM u WHERE used <= {context.HISTORY} UNION ALL SELECT conv_id, turn, shortened, true FROM {sql_truncated('first', 'line', 'room')} WHERE shortened <> ''""")
def w9_cut(spark, sf_dir):
    return context.history_window(read(spark, sf_dir, "conversations"))


@query("w10_h5_evidence")
def w10(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    hits = d.select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("title"), F.col("lang").alias("location"), "text")
    return context.pack_evidence(hits)


@query("w10_h5_whole_evidence", f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r
  FROM (SELECT doc_id, doc_id % 50 AS query_id, source, lang, {sql_strip("coalesce(text, '')")} AS s FROM documents) WHERE s <> ''),
p AS (SELECT query_id, 0::BIGINT AS r, 0::BIGINT AS no, 0::BIGINT AS used, NULL::BIGINT AS doc_id, 0::BIGINT AS tokens FROM (SELECT DISTINCT query_id FROM h)
  UNION ALL SELECT query_id, r, no + fits::INT, used + fits::INT * cost, CASE WHEN fits THEN doc_id END, cost
  FROM (SELECT *, octet_length(encode(s)) <= 2 * {context.MOST_CHUNK} AND cost <= {context.CONTEXT} - used AS fits
    FROM (SELECT h.query_id, h.r, no, used, h.doc_id, s, ceil(octet_length(encode(to_json({{evidence_no: no + 1, title: coalesce(source, ''), location: coalesce(lang, ''), content: s}})::VARCHAR)) / 2)::BIGINT AS cost
      FROM p JOIN h ON h.query_id = p.query_id AND h.r = p.r + 1)))
SELECT query_id, no AS evidence_no, doc_id::VARCHAR AS chunk_id, tokens FROM p WHERE doc_id IS NOT NULL""")
def w10_whole(spark, sf_dir):
    """Only hits that fit as they are: no text can have so many tokens as a cut one must keep here."""
    d = read(spark, sf_dir, "documents")
    hits = d.select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("title"), F.col("lang").alias("location"), "text")
    return context.pack_evidence(hits, least=context.CONTEXT + 1).select("query_id", "evidence_no", "chunk_id", "tokens")


@query("h7_routing_decisions", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ambiguous' WHEN event_id % 3 = 1 THEN 'legal_question' ELSE 'ambiguous' END AS reason, event_id % 2 = 0 AS need_rag FROM events")
def h7(spark, sf_dir):
    code = F.when(F.col("event_id") % 3 == 0, "odd").when(F.col("event_id") % 3 == 1, "legal_question").otherwise("ambiguous")
    raw = F.concat(F.lit('{"need_rag": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(', "reason_code": "'), code, F.lit('"}'))
    d = read(spark, sf_dir, "events").select("event_id", F.from_json(raw, "need_rag boolean, reason_code string").alias("d"))
    known = F.col("d.reason_code").isin("legal_question", "small_talk", "ambiguous")
    return d.select("event_id", F.when(known, F.col("d.reason_code")).otherwise("ambiguous").alias("reason"), F.col("d.need_rag").alias("need_rag"))


@query("w5_chunks")
def w5(spark, sf_dir):
    kept = structure.drop_heading_runs(structured(spark, sf_dir))
    return chunking.build_chunks(kept).select("doc_id", "chunk_index", "chunk_id", "section_path", "article_no", "article_range", "paragraph_start", "paragraph_end", "token_count")


# ---- D: reports ----


@query("d1_integrity", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL) AS orphans, (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL) AS without_status, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def d1(spark, sf_dir):
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    parts = [o.agg(F.count("*").alias("orders"), quality.count_if(F.col("o_orderstatus").isNull()).alias("without_status")), line.agg(F.count("*").alias("lineitem")), line.join(o, line.l_orderkey == o.o_orderkey, "left_anti").agg(F.count("*").alias("orphans")), layers.repeated_ids(o, "o_orderkey").agg(F.count("*").alias("repeated"))]
    return reduce(DataFrame.crossJoin, parts)  # one row each


REVIEW_SQL = f"(length(text) - length(translate(text, '{T.GARBLED}', '')))::DOUBLE / greatest(length(text), 1)"


@query("d2_e7_sample_review", f"WITH {LINES_SQL}, r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {sql_strip('line')} = '') AS blank FROM lines GROUP BY doc_id) SELECT d.doc_id, length(text) > 100 AS long_enough, {REVIEW_SQL} > 0.03 AS garbled, blank::DOUBLE / n < 0.3 AS dense, contains(text, ' | ') AS has_table FROM documents d JOIN r USING (doc_id) WHERE text IS NOT NULL")
def d2(spark, sf_dir):
    lines = F.split("text", "\n")
    blank = F.size(F.filter(lines, lambda x: T.strip(x) == ""))
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", (F.char_length("text") > 100).alias("long_enough"), (T.garbled_share("text") > 0.03).alias("garbled"), (blank / F.size(lines) < 0.3).alias("dense"), F.col("text").contains(" | ").alias("has_table"))


@query("d3_structure_review", f"WITH {STRUCTURED_SQL} SELECT doc_id, count(*) AS blocks, count(law_level) AS with_level, count(DISTINCT section_path) AS paths, count(DISTINCT article_no) AS articles, count(DISTINCT section_path) >= 2 AS has_paths FROM structured GROUP BY doc_id")
def d3(spark, sf_dir):
    s = structured(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count("law_level").alias("with_level"), F.countDistinct("section_path").alias("paths"), F.countDistinct("article_no").alias("articles"))
    return s.withColumn("has_paths", F.col("paths") >= 2)


@query("d4_chunk_review", "SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 50 THEN 'short' END, CASE WHEN length(text) / 0.7::DOUBLE > 1200 THEN 'over_max' END, CASE WHEN source = 'src0' THEN 'no_path' END, CASE WHEN contains(text, '###') THEN 'junk' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents")
def d4(spark, sf_dir):
    n = F.char_length("text")
    issues = [F.when(n < 50, "short"), F.when(n / F.lit(0.7) > 1200, "over_max"), F.when(F.col("source") == "src0", "no_path"), F.when(F.col("text").contains("###"), "junk")]
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", *issues).alias("issues"))


@query("d5_d6_vector_review", "SELECT label::BIGINT AS label, count(*) AS n, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim, count(DISTINCT vec_id) AS ids, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label")
def d5(spark, sf_dir):
    from corvane.functions import vectors as V

    return read(spark, sf_dir, "embeddings").groupBy(long("label").alias("label")).agg(F.count("*").alias("n"), long(F.min(F.size("embedding"))).alias("min_dim"), long(F.max(F.size("embedding"))).alias("max_dim"), F.countDistinct("vec_id").alias("ids"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))


@query("d8_baseline", "SELECT lang, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS distinct_texts, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY lang")
def d8(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("d9_load_validation", "SELECT count(*) FILTER (WHERE text IS NULL OR text = '') AS blank_text, count(*) FILTER (WHERE source IS NULL) AS no_source, count(*) - count(DISTINCT doc_id) AS repeated_ids, (SELECT count(*) FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE d.doc_id IS NULL) AS vectors_without_chunk FROM documents")
def d9(spark, sf_dir):
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    rows = d.agg(quality.count_if(F.coalesce("text", F.lit("")) == "").alias("blank_text"), quality.count_if(F.col("source").isNull()).alias("no_source"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated_ids"))
    return rows.crossJoin(e.join(d, e.vec_id == d.doc_id, "left_anti").agg(F.count("*").alias("vectors_without_chunk")))  # one row and one row


# ---- contracts, deltas and listings ----


@query("h2_input_validation", "WITH h AS (SELECT l_orderkey AS source, l_partkey % 50 AS id, l_linenumber AS rank, CASE WHEN l_quantity = 50 THEN 'nan'::DOUBLE ELSE l_quantity END AS score FROM lineitem) SELECT source, count(*) - count(DISTINCT id) AS repeated_ids, count(*) - count(DISTINCT rank) AS repeated_ranks, count(*) FILTER (WHERE isnan(score) OR isinf(score)) AS bad_scores FROM h GROUP BY source")
def h2(spark, sf_dir):
    score = F.when(F.col("l_quantity") == 50, float("nan")).otherwise(F.col("l_quantity"))
    h = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") % 50).alias("id"), F.col("l_linenumber").alias("rank"), score.alias("score"))
    return h.groupBy("source").agg((F.count("*") - F.countDistinct("id")).alias("repeated_ids"), (F.count("*") - F.countDistinct("rank")).alias("repeated_ranks"), quality.count_if(F.isnan("score") | (F.abs("score") == float("inf"))).alias("bad_scores"))


@query("f17_row_contracts", "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR text = '') AS blank_text, count(*) FILTER (WHERE n_chars < 0) AS negative, count(*) FILTER (WHERE n_chars <> length(text)) AS wrong_length, count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr', 'es')) AS unknown_lang FROM documents")
def f17(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("n"), quality.count_if(F.coalesce("text", F.lit("")) == "").alias("blank_text"), quality.count_if(F.col("n_chars") < 0).alias("negative"), quality.count_if(F.col("n_chars") != F.char_length("text")).alias("wrong_length"), quality.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("unknown_lang"))


@query("f18_block_records", f"WITH {STRUCTURED_SQL}, r AS (SELECT *, CASE WHEN block_index % 7 = 0 THEN '段落' ELSE law_level END AS label FROM structured) SELECT doc_id, block_index, sha256(doc_id || ':structured_block:' || block_index) AS block_id, CASE WHEN label IN ('编', '章', '节', '条', '款', '项', '目') THEN label END AS law_level, section_path, article_no, sha256(text) AS digest FROM r")
def f18(spark, sf_dir):
    labelled = structured(spark, sf_dir).withColumn("law_level", F.when(F.col("block_index") % 7 == 0, "段落").otherwise(F.col("law_level")))
    return structure.block_records(labelled).select("doc_id", "block_index", "block_id", "law_level", "section_path", "article_no", F.sha2("text", 256).alias("digest"))


INSERTS_SQL = LINES_SQL + ", rows AS (SELECT doc_id, CASE WHEN i % 50 = 49 THEN -1 ELSE i END AS block_index, line AS text, CASE WHEN i % 11 = 10 THEN NULL ELSE i END AS vector_id FROM lines)"
FAULT_SQL = f"CASE WHEN doc_id IS NULL THEN 'no document' WHEN block_index IS NULL OR block_index < 0 THEN 'block index' WHEN {sql_strip('text')} = '' THEN 'no text' WHEN vector_id IS NULL OR vector_id < 0 THEN 'vector id' END"


@query("k20_delta_inserts", f"WITH {INSERTS_SQL}, c AS (SELECT *, {FAULT_SQL} AS fault FROM rows) SELECT coalesce(fault, 'inserted') AS state, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(length(text))::BIGINT AS chars FROM c GROUP BY 1")
def k20(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"))
    i = F.col("i")
    rows = lines.select("doc_id", long(F.when(i % 50 == 49, -1).otherwise(i)).alias("block_index"), "text", long(F.when(i % 11 != 10, i)).alias("vector_id"))
    good, refused = layers.checked_rows(rows)
    both = good.withColumn("state", F.lit("inserted")).unionByName(refused.withColumnRenamed("fault", "state"))
    return both.groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum(F.char_length("text").cast("long")).alias("chars"))


@query("f16_hydrated_hits", "SELECT h.vec_id AS chunk_id, h.rank, d.source AS title, d.lang AS section_path, d.n_chars, h.vec_id = d.doc_id AS agrees FROM (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 40) h JOIN documents d ON d.doc_id = h.vec_id")
def f16(spark, sf_dir):
    top = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[1].alias("score")).orderBy(F.desc("score"), "vec_id").limit(40)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "vec_id")).cast("long"))  # 40 rows
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(F.broadcast(ranked), d.doc_id == ranked.vec_id).select(F.col("vec_id").alias("chunk_id"), "rank", F.col("source").alias("title"), F.col("lang").alias("section_path"), "n_chars", (F.col("vec_id") == F.col("doc_id")).alias("agrees"))


@query("j5_left_hits", "SELECT e.vec_id, d.source FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id + 400")
def j5(spark, sf_dir):
    e, d = read(spark, sf_dir, "embeddings").select("vec_id"), read(spark, sf_dir, "documents").select("doc_id", "source")
    return e.join(d, d.doc_id == e.vec_id + 400, "left").select("vec_id", "source")


@query("i3_uncommitted_versions", "SELECT doc_id, 'ver_' || substring(sha256(doc_id || ':' || sha256(text)), 1, 24) AS version_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)")
def i3(spark, sf_dir):
    from corvane.functions import ids

    d = read(spark, sf_dir, "documents").filter("text is not null")
    versions = d.select("doc_id", ids.version_id(F.col("doc_id"), F.sha2("text", 256)).alias("version_id"))
    committed = versions.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("version_id")
    return versions.join(committed, "version_id", "left_anti").select("doc_id", "version_id")


@query("k15_k19_build_report", "SELECT to_json({documents: (SELECT count(*) FROM documents), chunks: (SELECT count(*) FROM lineitem), vectors: (SELECT count(*) FROM embeddings)})::VARCHAR AS report")
def k15(spark, sf_dir):
    parts = [read(spark, sf_dir, t).agg(F.count("*").alias(n)) for n, t in (("documents", "documents"), ("chunks", "lineitem"), ("vectors", "embeddings"))]
    return reduce(DataFrame.crossJoin, parts).select(F.to_json(F.struct("documents", "chunks", "vectors")).alias("report"))  # one row each


@query("k19_tombstone_list", "SELECT 'chunk' AS entity_type, doc_id::VARCHAR AS entity_id FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'vector', vec_id::VARCHAR FROM embeddings WHERE vec_id % 7 = 0")
def k19(spark, sf_dir):
    d, e = read(spark, sf_dir, "documents").filter("doc_id % 7 = 0"), read(spark, sf_dir, "embeddings").filter("vec_id % 7 = 0")
    rows = d.select(F.lit("chunk").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id")).union(e.select(F.lit("vector"), F.col("vec_id").cast("string")))
    return rows.orderBy("entity_type", "entity_id")


@query("k18_delta_vectors", "SELECT vec_id, ts, row_number() OVER (ORDER BY ts, vec_id) AS place FROM (SELECT vec_id, (vec_id * 7) % 97 AS ts FROM embeddings)")
def k18(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 7 % 97).alias("ts"))
    return layers.assign_ids(e, 1, ["ts", "vec_id"]).select("vec_id", "ts", long("vector_id").alias("place"))


@query("x10_reference_names", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '（f' || doc_id || '.txt）' ELSE source || '.txt' END AS name FROM documents")
def x10(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    path = F.concat(F.lit("a/b/"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), i)).otherwise(F.col("source")), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select("doc_id", T.reference_name(F.col("source"), path).alias("name"))


@query("set_differences", "SELECT doc_id AS id, 'documents' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'vectors' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def differences(spark, sf_dir):
    d, e = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return d.exceptAll(e).withColumn("side", F.lit("documents")).union(e.exceptAll(d).withColumn("side", F.lit("vectors")))


@query("a19_d7_quick", """SELECT *, chunk_filled = vector_n AND vector_filled = vector_n AND chunk_low IS NOT DISTINCT FROM vector_low AND chunk_high IS NOT DISTINCT FROM vector_high AS consistent FROM
(SELECT count(*) AS chunk_n, count(doc_id) AS chunk_filled, min(doc_id) AS chunk_low, max(doc_id) AS chunk_high FROM documents), (SELECT count(*) AS vector_n, count(vec_id) AS vector_filled, min(vec_id) AS vector_low, max(vec_id) AS vector_high FROM embeddings)""")
def a19_quick(spark, sf_dir):
    """The quick mode of the consistency check: footers alone."""
    return quality.quick_consistency(spark, f"{sf_dir}/documents.parquet", "doc_id", f"{sf_dir}/embeddings.parquet", "vec_id")


@query("d7_both_modes", """WITH f AS (SELECT count(DISTINCT doc_id) FILTER (WHERE vec_id IS NULL) AS without_vector, count(DISTINCT vec_id) FILTER (WHERE doc_id IS NULL) AS without_chunk FROM documents FULL JOIN embeddings ON doc_id = vec_id),
q AS (SELECT (SELECT count(doc_id) = (SELECT count(*) FROM embeddings) AND min(doc_id) = (SELECT min(vec_id) FROM embeddings) AND max(doc_id) = (SELECT max(vec_id) FROM embeddings) FROM documents) AS quick)
SELECT quick, without_vector = 0 AND without_chunk = 0 AS whole, without_vector, without_chunk FROM f, q""")
def d7_both(spark, sf_dir):
    """Both modes in one report: what footers tell, and what a join of all ids does."""
    quick = quality.quick_consistency(spark, f"{sf_dir}/documents.parquet", "doc_id", f"{sf_dir}/embeddings.parquet", "vec_id").select(F.col("consistent").alias("quick"))
    both = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "full")
    full = both.agg(F.count_distinct(F.when(F.col("vec_id").isNull(), F.col("doc_id"))).alias("without_vector"), F.count_distinct(F.when(F.col("doc_id").isNull(), F.col("vec_id"))).alias("without_chunk"))
    return quick.crossJoin(full.withColumn("whole", (F.col("without_vector") == 0) & (F.col("without_chunk") == 0))).select("quick", "whole", "without_vector", "without_chunk")  # one row each
