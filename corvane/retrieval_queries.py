"""Queries of text, structure, search and fusion over the driver's tables, and the SQL that states the same.

The tables hold no statutes, chunks or layers, so each concept is bound to a derived view, written alike in both languages:
a document is a chunk, its source a file, its lines are blocks, and a line's number decides which statute heading it gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corvane.functions import ids, text as T, vectors as V
from corvane.operators import layers, postings, quality, retrieval, structure
from corvane.plans.keyword import MOST_EXPRESSION, MOST_LETTERS, MOST_TERMS, RESERVED, with_plans
from corvane.registry import long, query, read, spread
from corvane.sources import files

NUMERALS = "一二三四五六七八九十"
TERMS = [["the", "anat"], ["ing", "heit", "ción"]]
QUERY_VECTOR = 0
LAYER_CUT = 5


# ---- derived views ----


def lines_of(text: Column | str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def statute_line(line: Column, i: Column) -> Column:
    head = lambda unit, more="": F.concat(F.lit("第"), F.substring(F.lit(NUMERALS), i % 10 + 1, F.lit(1)), F.lit(f"{unit} {more}"), line)
    return F.when(i % 16 == 0, head("编")).when(i % 8 == 1, head("章", "节约")).when(i % 4 == 2, head("节")).when(i % 2 == 1, head("条")).otherwise(line)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of documents, for queries whose work on a row is long."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def statute_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, blocks: a document's lines in order, some of them with the number of a part, chapter, section or article."""
    return texts(spark, sf_dir).select("doc_id", F.transform(lines_of(), statute_line).alias("blocks"))


def statute_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block_index, text: the same, a row for each line."""
    return texts(spark, sf_dir).select("doc_id", F.posexplode_outer(lines_of()).alias("i", "line")).select("doc_id", long("i").alias("block_index"), statute_line(F.col("line"), F.col("i")).alias("text"))


LINES_SQL = "lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
BLOCKS_SQL = LINES_SQL + f""", blocks AS (
  SELECT doc_id, i AS block_index, CASE WHEN i % 16 = 0 THEN '第' || n || '编 ' || line WHEN i % 8 = 1 THEN '第' || n || '章 节约' || line
    WHEN i % 4 = 2 THEN '第' || n || '节 ' || line WHEN i % 2 = 1 THEN '第' || n || '条 ' || line ELSE line END AS text
  FROM (SELECT *, substring('{NUMERALS}', (i % 10 + 1)::INT, 1) AS n FROM lines))"""


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"


def sql_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{T.WS}+$', '', 'g')"


def sql_within(x: str, n: str) -> str:
    """The longest prefix of at most n bytes."""
    return f"substring({x}, 1, list_max(list_filter(range(0, greatest(0, {n}) + 1), lambda k: octet_length(encode(substring({x}, 1, k))) <= greatest(0, {n}))))"


def sql_truncated(rows: str, text: str, tokens: str) -> str:
    """rows, a table, with shortened: text within tokens, as T.truncated() has it."""
    mark = -(-len(T.TRUNCATED.encode()) // 2)
    ends = "(?s)^.*[\n" + "".join(e for e in T.NATURAL_ENDS if e.strip()) + "]"
    return f"""(SELECT * EXCLUDE (p, e), CASE WHEN {text} IS NULL THEN NULL WHEN {text} = '' OR {tokens} <= 0 THEN '' WHEN octet_length(encode({text})) <= 2 * {tokens} THEN {text}
      WHEN {tokens} < {mark} THEN {sql_within("'" + T.TRUNCATED + "'", f"2 * {tokens}")}
      ELSE {sql_rstrip("CASE WHEN length(p) >= 10 AND length(e) > floor(length(p) * 0.8::DOUBLE) THEN e ELSE p END")} || '{T.TRUNCATED}' END AS shortened
    FROM (SELECT *, regexp_extract(p, '{ends}') AS e FROM (SELECT *, {sql_within(text, f"2 * ({tokens} - {mark})")} AS p FROM {rows})))"""


def sql_level(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in T.LEVELS) + " END"


STRUCTURED_SQL = BLOCKS_SQL + f""", levels AS (SELECT *, {sql_strip('text')} AS t, {sql_level(sql_strip('text'))} AS law_level FROM blocks),
groups AS (
  SELECT *, sum((law_level = '编')::INT) FILTER (WHERE law_level IS NOT NULL) OVER w AS a1, count(*) FILTER (WHERE law_level IN ('编')) OVER w AS g1,
    count(*) FILTER (WHERE law_level IN ('编', '章')) OVER w AS g2, count(*) FILTER (WHERE law_level IN ('编', '章', '节')) OVER w AS g3
  FROM levels WINDOW w AS (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING)
), parts AS (
  SELECT *, max(t) FILTER (WHERE law_level = '编') OVER w1 AS p, max(t) FILTER (WHERE law_level = '章') OVER w2 AS c, max(t) FILTER (WHERE law_level = '节') OVER w3 AS s,
    count(*) FILTER (WHERE law_level = '章') OVER w1 > 0 AS c_seen, count(*) FILTER (WHERE law_level = '节') OVER w1 > 0 AS s_seen, count(*) FILTER (WHERE law_level = '节') OVER w2 > 0 AS s_in_c,
    last_value(CASE WHEN law_level = '条' THEN regexp_extract(t, '^第{T.CN_NUMERAL}条') END IGNORE NULLS) OVER w3 AS article_no
  FROM groups WINDOW w1 AS (PARTITION BY doc_id, g1 ORDER BY block_index ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY doc_id, g1, g2 ORDER BY block_index ROWS UNBOUNDED PRECEDING), w3 AS (PARTITION BY doc_id, g1, g2, g3 ORDER BY block_index ROWS UNBOUNDED PRECEDING)
), structured AS (
  SELECT doc_id, block_index, text, law_level, nullif(concat_ws(' / ',
      CASE WHEN NOT ((c_seen AND regexp_matches(p, '[章节]')) OR (s_seen AND contains(p, '节'))) THEN p END,
      CASE WHEN NOT (s_in_c AND contains(c, '节')) THEN c END, s), '') AS section_path, article_no
  FROM parts)"""


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.section_paths(statute_blocks(spark, sf_dir))


def chunks_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; every fifth is in the delta."""
    return texts(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % LAYER_CUT == 0, 1).otherwise(0).cast("long").alias("layer"))


_indexes: dict[tuple, postings.Index] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The index of the documents, written by the first query that needs it and read by all others of the application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = spark.sparkContext.applicationId, sf_dir, changed
    if key not in _indexes:
        _indexes[key] = postings.write_index(chunks_by_layer(spark, sf_dir), "doc_id", ["text"])
    return _indexes[key]


def asked(spark: SparkSession, strict: list[list[str]], relaxed: list[list[str]] | None = None) -> DataFrame:
    """One question of known groups."""
    return spark.createDataFrame([(0, strict, relaxed)], "query_id long, strict_groups array<array<string>>, relaxed_groups array<array<string>>")


# ---- V, X: vectors ----

DOT_SQL = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()[0])


@query("v1_vector_search", f"SELECT a.vec_id, round({DOT_SQL}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY {DOT_SQL} DESC, vec_id LIMIT 40")
def v1(spark, sf_dir):
    return retrieval.vector_search(read(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), retrieval.CANDIDATES).select("vec_id", F.round("score", 6).alias("score"))


@query("v1_knn", f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT b.vec_id AS query_id, a.vec_id, {DOT_SQL} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {DOT_SQL} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0) WHERE rank <= 5""")
def v1_knn(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return retrieval.knn(e.filter("vec_id % 20 = 0"), e, 5).withColumn("score", F.round("score", 6))


@query("v3_self_check", f"SELECT count(*) AS n, count(*) FILTER (WHERE query_id <> vec_id) AS wrong FROM (SELECT b.vec_id AS query_id, a.vec_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {DOT_SQL} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank = 1")
def v3(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return retrieval.knn(e, e, 1).agg(F.count("*").alias("n"), quality.count_if(F.col("query_id") != F.col("vec_id")).alias("wrong"))


@query("v2_query_vectors", "SELECT vec_id, CASE WHEN label = 3 THEN NULL ELSE round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) END AS first FROM embeddings")
def v2(spark, sf_dir):
    v = F.when(F.col("label") == 3, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(V.prepared(v, 64)[0], 6).alias("first"))


@query("x7_l2_normalise", "SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[64] / sqrt(list_inner_product(v, v)), 6) AS last FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7 + 1)) AS v FROM embeddings)")
def x7(spark, sf_dir):
    scaled = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1)).alias("v"))
    n = scaled.select("vec_id", V.norm(F.col("v")).alias("norm"), V.normalised(F.col("v")).alias("u"))
    return n.select("vec_id", F.round("norm", 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("f7_f8_vector_validity", "SELECT label::BIGINT AS label, count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS valid, count(*) FILTER (WHERE abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-4) AS unit FROM embeddings GROUP BY label")
def f7(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.groupBy(long("label").alias("label")).agg(F.count("*").alias("n"), quality.count_if(V.is_valid(F.col("embedding"), 64)).alias("valid"), quality.count_if(V.is_unit(F.col("embedding"))).alias("unit"))


# ---- Q: keyword search ----

TOKENS_SQL = f"regexp_extract_all(translate(lower(coalesce(text, '')), '{postings.ACCENTED}', '{postings.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(groups: list[list[str]], match_all: bool, name: str = "scored", chunks: str = f"(SELECT *, (doc_id % {LAYER_CUT} = 0)::BIGINT AS layer FROM documents)") -> str:
    """CTEs that end with name(layer, doc_id, score). chunks: layer, doc_id, text."""
    terms = list(dict.fromkeys(t for g in groups for t in g))
    folded = [t.translate(str.maketrans(postings.ACCENTED, postings.PLAIN)) for t in terms]
    counts = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) AS f{i}" for i, t in enumerate(folded))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(1e-6, ln((n_docs - n{i} + 0.5) / (n{i} + 0.5))) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))" for i in range(len(terms)))
    match = (" AND " if match_all else " OR ").join("(" + " OR ".join(f"f{terms.index(t)} > 0" for t in g) + ")" for g in groups)
    return f"""{name}_c AS (SELECT layer, doc_id, len(w) AS doc_len, {counts} FROM (SELECT doc_id, layer, {TOKENS_SQL} AS w FROM {chunks})),
{name}_s AS (SELECT layer, count(*) AS n_docs, avg(doc_len) AS avg_len, {stats} FROM {name}_c GROUP BY layer),
{name} AS (SELECT layer, doc_id, -({score}) AS score FROM {name}_c JOIN {name}_s USING (layer) WHERE {match})"""


@query("q4f_bm25", f"WITH {bm25_sql(TERMS, True)} SELECT layer, doc_id, round(score, 6) AS score FROM scored")
def q4f(spark, sf_dir):
    return postings.bm25(stored_index(spark, sf_dir), asked(spark, TERMS), "strict_groups").select("layer", "doc_id", F.round("score", 6).alias("score"))


RARE = [["zzzz"], ["the"]]


@query("q5f_strict_or_relaxed", f"""WITH {bm25_sql(RARE, True, 'strict')}, {bm25_sql([['zzzz', 'the']], False, 'relaxed')},
found AS (SELECT * FROM strict UNION ALL SELECT * FROM relaxed WHERE layer NOT IN (SELECT layer FROM strict)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score, doc_id) AS rank FROM found)
SELECT layer, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 40""")
def q5f(spark, sf_dir):
    found = postings.keyword_search(stored_index(spark, sf_dir), asked(spark, RARE, [["zzzz", "the"]]), 40)
    return found.select("layer", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("k3_postings", f"SELECT layer, token, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM (SELECT doc_id, (doc_id % {LAYER_CUT} = 0)::BIGINT AS layer, unnest({TOKENS_SQL}) AS token FROM documents) GROUP BY layer, token")
def k3(spark, sf_dir):
    p = stored_index(spark, sf_dir).table("postings")
    return p.groupBy("layer", "token").agg(F.count("*").alias("docs"), F.sum("tf").alias("hits"))


#: The conversations are in Latin letters, so their plans have identifiers alone; tests have the other kinds of terms.
NAMES_SQL = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: substring(x, 1, {MOST_LETTERS})), lambda x: lower(x) NOT IN {RESERVED})"


@query("q1f_query_plans", f"""WITH n AS (SELECT conv_id, turn, {NAMES_SQL} AS r FROM conversations WHERE role = 'user'),
u AS (SELECT conv_id, turn, list_filter(r, lambda x, i: list_position(r, x) = i)[:{MOST_TERMS}] AS t FROM n),
e AS (SELECT conv_id, turn, len(t) AS n_terms, CASE len(t) WHEN 0 THEN NULL WHEN 1 THEN '"' || t[1] || '"*' ELSE '(' || array_to_string(list_transform(t, lambda x: '"' || x || '"*'), ' OR ') || ')' END AS strict FROM u)
SELECT conv_id, turn, CASE WHEN length(strict) <= {MOST_EXPRESSION} THEN strict END AS strict, NULL::VARCHAR AS relaxed, coalesce(n_terms, 0) AS n_terms FROM e""")
def q1f(spark, sf_dir):
    asks = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return with_plans(asks, "text").select("conv_id", "turn", "strict", "relaxed", "n_terms")


ASKED_SQL = f"""asks AS (SELECT conv_id * 1000 + turn AS query_id, list_filter(r, lambda x, i: list_position(r, x) = i)[:{MOST_TERMS}] AS t FROM (SELECT conv_id, turn, {NAMES_SQL} AS r FROM conversations WHERE role = 'user' AND conv_id % 20 = 0)),
terms AS (SELECT DISTINCT query_id, lower(unnest(t)) AS term FROM asks), words AS (SELECT doc_id, (doc_id % {LAYER_CUT} = 0)::BIGINT AS layer, unnest({TOKENS_SQL}) AS token FROM documents),
chunks AS (SELECT (doc_id % {LAYER_CUT} = 0)::BIGINT AS layer, doc_id, len({TOKENS_SQL}) AS doc_len FROM documents), stats AS (SELECT layer, count(*) AS n_docs, avg(doc_len) AS avg_len FROM chunks GROUP BY layer),
counts AS (SELECT token, layer, doc_id, count(*) AS tf FROM words GROUP BY ALL), pairs AS (SELECT DISTINCT term, token FROM (SELECT DISTINCT term FROM terms) JOIN (SELECT DISTINCT token FROM words) ON starts_with(token, term)),
hits AS (SELECT term, layer, doc_id, sum(tf)::DOUBLE AS f FROM pairs JOIN counts USING (token) GROUP BY ALL), seen AS (SELECT term, layer, count(*) AS n FROM hits GROUP BY ALL),
scored AS (SELECT query_id, layer, doc_id, -sum(greatest(1e-6, ln((n_docs - n + 0.5) / (n + 0.5))) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_len / avg_len)) ORDER BY term) AS score
  FROM terms JOIN hits USING (term) JOIN seen USING (term, layer) JOIN stats USING (layer) JOIN chunks USING (layer, doc_id) GROUP BY ALL)"""


@query("q4f_many_questions", f"WITH {ASKED_SQL} SELECT query_id, layer, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY score, doc_id) AS rank FROM scored) WHERE rank <= 5")
def q4f_many(spark, sf_dir):
    """All questions of every twentieth conversation, answered together: the five best of each layer, by any of a plan's terms."""
    asks = with_plans(read(spark, sf_dir, "conversations").filter("role = 'user' and conv_id % 20 = 0"), "text")
    asks = asks.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lit(None).cast("array<array<string>>").alias("strict_groups"), F.array(F.flatten("groups")).alias("relaxed_groups"))
    found = postings.keyword_search(stored_index(spark, sf_dir), asks, 5)
    return found.select("query_id", "layer", "doc_id", F.round("score", 6).alias("score"), "rank")


# ---- H, W, T: fusion and ranks ----

FUSED_SQL = f"""v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS vector_rank, score AS vector_score FROM (
    SELECT a.vec_id, {DOT_SQL} AS score FROM embeddings a JOIN documents d ON d.doc_id = a.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) b) QUALIFY vector_rank <= 40),
{bm25_sql(TERMS, True)},
k AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS keyword_rank FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score, doc_id) AS r FROM scored) WHERE r <= 40 QUALIFY keyword_rank <= 40),
joined AS (SELECT doc_id, vector_rank, keyword_rank, vector_score, coalesce(0.6::DOUBLE / (60 + vector_rank), 0) + coalesce(0.4::DOUBLE / (60 + keyword_rank), 0) AS fused,
  CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN 'both' WHEN vector_rank IS NOT NULL THEN 'vector' ELSE 'fts' END AS matched_by FROM v FULL JOIN k USING (doc_id)),
fused AS (SELECT *, row_number() OVER (ORDER BY fused DESC, (matched_by <> 'both')::INT, vector_score DESC NULLS LAST, doc_id) AS rank FROM joined)"""


def fused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    v = retrieval.vector_search(e, query_vector(spark, sf_dir), retrieval.CANDIDATES, "doc_id")
    v = v.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).cast("long"))  # 40 rows
    k = postings.keyword_search(stored_index(spark, sf_dir), asked(spark, TERMS), retrieval.CANDIDATES).drop("rank").orderBy("score", "doc_id").limit(retrieval.CANDIDATES)
    return retrieval.fuse(v, k.withColumn("rank", F.row_number().over(W.orderBy("score", "doc_id")).cast("long")), "doc_id")


@query("h1_rank_fusion", f"WITH {FUSED_SQL} SELECT doc_id, rank, matched_by, vector_rank, keyword_rank, round(fused, 9) AS fused FROM fused")
def h1(spark, sf_dir):
    return fused_hits(spark, sf_dir).select("doc_id", "rank", "matched_by", "vector_rank", "keyword_rank", F.round("fused", 9).alias("fused"))


@query("h4_hybrid_retrieval", f"""WITH {FUSED_SQL}, capped AS (SELECT f.*, source, row_number() OVER (PARTITION BY source ORDER BY rank) AS in_doc FROM fused f JOIN documents USING (doc_id)),
final AS (SELECT *, row_number() OVER (ORDER BY rank) AS final_rank FROM capped WHERE in_doc <= 3)
SELECT final_rank, doc_id, source, matched_by, round(fused, 9) AS fused FROM final WHERE final_rank <= 8""")
def flagship(spark, sf_dir):
    hits = fused_hits(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return retrieval.cap_per_document(hits, "source").select("final_rank", "doc_id", "source", "matched_by", F.round("fused", 9).alias("fused"))


@query("w7_cap_per_group", "SELECT label::BIGINT AS label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank) AS k FROM (SELECT label, vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings)) WHERE k <= 3 ORDER BY rank LIMIT 20")
def w7(spark, sf_dir):
    # the rank over all rows is the place in a total order; it is made by range, not in one task
    e = read(spark, sf_dir, "embeddings").select("label", "vec_id", (-F.col("embedding")[0]).alias("minus"))
    ranked = layers.assign_ids(e, 1, ["minus", "vec_id"]).withColumnRenamed("vector_id", "rank")
    return retrieval.cap_per_document(ranked, "label", 3, 20).select(long("label").alias("label"), "vec_id", long("rank").alias("rank"))


@query("w11_best_of_repeats", "SELECT l_partkey AS chunk_id, rank, position FROM (SELECT l_partkey, l_linenumber::BIGINT AS rank, l_orderkey AS position, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey) AS k FROM lineitem) WHERE k = 1")
def w11(spark, sf_dir):
    hits = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id"), long("l_linenumber").alias("rank"), F.col("l_orderkey").alias("position"))
    return retrieval.best_of_repeats(hits, "chunk_id")


@query("q7f_scaled_merge", "WITH k AS (SELECT doc_id, -n_chars::DOUBLE AS score FROM documents), v AS (SELECT vec_id AS doc_id, embedding[1]::DOUBLE AS score FROM embeddings) SELECT doc_id, round(sum(part), 9) AS score FROM (SELECT doc_id, score / max(abs(score)) OVER () * 0.4::DOUBLE AS part FROM k UNION ALL SELECT doc_id, score / max(abs(score)) OVER () * 0.6::DOUBLE FROM v) GROUP BY doc_id")
def q7f(spark, sf_dir):
    k = read(spark, sf_dir, "documents").select("doc_id", (-F.col("n_chars").cast("double")).alias("score"))
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding")[0].cast("double").alias("score"))
    return retrieval.merge_by_scale(k, v, "doc_id").withColumn("score", F.round("score", 9))


@query("t6_random_sample", "SELECT doc_id FROM documents ORDER BY md5('6:' || doc_id), doc_id LIMIT 50")
def t6(spark, sf_dir):
    """A sample that the seed alone decides, however rows are dealt."""
    return read(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("6:"), F.col("doc_id").cast("string"))), "doc_id").limit(50)


@query("t7_reading_order", "SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS line, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY round_even(l_quantity / 12, 0), l_extendedprice, l_quantity) AS place FROM lineitem")
def t7(spark, sf_dir):
    boxes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).alias("page"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), long("l_linenumber").alias("line"))
    return files.reading_order(boxes).select("doc_id", "line", "place")


# ---- C, F, L, E, X: text ----


@query("c1_normalise_spaces", r"WITH t AS (SELECT doc_id, replace(regexp_replace(text, '\. ', '.' || chr(9) || chr(13) || chr(10) || '　 ', 'g'), ', ', ',  ' || chr(13)) AS text FROM documents) SELECT doc_id, sha256(regexp_replace(translate(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '　' || chr(9), '  '), ' {2,}', ' ', 'g')) AS digest FROM t")
def c1(spark, sf_dir):
    t = F.replace(F.regexp_replace("text", r"\. ", ".\t\r\n　 "), F.lit(", "), F.lit(",  \r"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_spaces(t), 256).alias("digest"))


C1_SQL = r"regexp_replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), '　' || chr(9), '  '), ' {2,}', ' ', 'g')"
NOISE_SQL = "CASE WHEN s = '' THEN true WHEN regexp_matches(s, '" + T.PRESERVED_LINE + "') THEN false WHEN regexp_matches(s, '" + T.NOISE_LINE + "') OR regexp_matches(s, '" + T.NOISE_WORDS + "') THEN true ELSE length(s) < 4 AND NOT regexp_matches(s, '[一-鿿]') END"


@query("f3_noise_lines", f"WITH {LINES_SQL}, s AS (SELECT doc_id, {sql_strip('line')} AS s FROM lines) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {NOISE_SQL}) AS n_noise FROM s GROUP BY doc_id")
def f3(spark, sf_dir):
    lines = lines_of()
    return texts(spark, sf_dir).select("doc_id", long(F.size(lines)).alias("n_lines"), long(F.size(F.filter(lines, T.is_noise))).alias("n_noise"))


@query("f6_chunk_input", f"WITH {LINES_SQL}, s AS (SELECT doc_id, i, {sql_strip('translate(line, chr(8203) || chr(65279), chr(32) || chr(32))')} AS s FROM lines) SELECT doc_id, i AS block_index, s AS text FROM s WHERE s <> '' AND NOT ({NOISE_SQL})")
def f6(spark, sf_dir):
    # within the row, where each line is stripped once; a filter after the split would strip it again for each of its rules
    lines = F.transform(lines_of(), lambda line, i: F.struct(long(i).alias("block_index"), T.strip(F.translate(line, "\u200b\ufeff", "  ")).alias("text")))
    rows = texts(spark, sf_dir).select("doc_id", lines.alias("lines"))
    usable = rows.select("doc_id", F.filter("lines", lambda x: (x["text"] != "") & ~T.is_noise(x["text"])).alias("lines"))
    return usable.select("doc_id", F.inline_outer("lines")).filter("block_index is not null")


@query("f9_usable_titles", f"WITH {LINES_SQL}, s AS (SELECT doc_id, i, {sql_strip('line')} AS s FROM lines) SELECT doc_id, count(*) FILTER (WHERE length(s) BETWEEN 2 AND 100 AND NOT regexp_matches(s, '[。;；.]$') AND s <> '目录') AS usable FROM s GROUP BY doc_id")
def f9(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", long(F.size(F.filter(lines_of(), T.usable_title))).alias("usable"))


@query("c5_tidy", f"SELECT doc_id, sha256({sql_strip('regexp_replace(regexp_replace(nfc_normalize(text), chr(13) || chr(10) || chr(63), chr(10), chr(103)), ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(39) + ', chr(32), chr(103))')}) AS digest FROM documents")
def c5(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.tidy("text"), 256).alias("digest"))


def sql_merged() -> str:
    """merged: doc_id, i, line of whole (doc_id, text), whose broken lines are joined: each step takes a line to the one that is open."""
    words, before = sql_strip("l[i + 1]"), sql_rstrip("cur")
    one_of = lambda x, chars: f"contains('{chars}', {x})"
    chinese = lambda x: f"regexp_matches({x}, '[一-鿿]')"
    follows = f"{chinese('cur')} AND {chinese('w')} AND NOT {one_of('left(w, 1)', T.SENTENCE_ENDS + '第（(　')}"
    return f"""steps AS (SELECT doc_id, 1::BIGINT AS i, string_split({C1_SQL}, chr(10)) AS l, string_split({C1_SQL}, chr(10))[1] AS cur, NULL::VARCHAR AS line FROM whole
  UNION ALL SELECT doc_id, i + 1, l, CASE WHEN goes_on THEN b || w ELSE l[i + 1] END, CASE WHEN NOT goes_on THEN cur END
  FROM (SELECT *, coalesce(w <> '' AND b <> '' AND NOT {one_of('right(b, 1)', T.SENTENCE_ENDS)} AND NOT regexp_matches(w, '{T.ENTRY_START}') AND ({one_of('right(b, 1)', T.OPEN_ENDS)} OR ({follows})), false) AS goes_on
    FROM (SELECT *, {words} AS w, {before} AS b FROM steps WHERE i <= len(l)))),
merged AS (SELECT doc_id, i, line FROM steps WHERE line IS NOT NULL)"""


@query("c2_clean_text", f"""WITH RECURSIVE {BLOCKS_SQL}, whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_index) AS text FROM blocks GROUP BY doc_id),
{sql_merged()}, s AS (SELECT doc_id, i, {sql_strip('line')} AS s FROM merged),
t AS (SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE s = '' OR NOT ({NOISE_SQL})), '') AS t FROM s GROUP BY doc_id)
SELECT doc_id, sha256({sql_strip("regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM t""")
def c2(spark, sf_dir):
    return statute_documents(spark, sf_dir).select("doc_id", F.sha2(T.clean_text(F.array_join("blocks", "\n")), 256).alias("digest"))


#: Texts broken as parsers break them: after commas, within phrases, and where sentences end.
BROKEN = ((", ", "，\n"), ("s ", "法\n 令 "), (". ", "。\n"))


def sql_broken(x: str) -> str:
    for what, by in BROKEN:
        x = f"replace({x}, '{what}', '{by}')"
    return x


@query("c3_w4_merged_lines", f"""WITH RECURSIVE whole AS (SELECT doc_id, {sql_broken("coalesce(text, '')")} AS text FROM documents), {sql_merged()},
n AS (SELECT doc_id, len(string_split({C1_SQL}, chr(10))) AS n_broken FROM whole)
SELECT doc_id, any_value(n_broken) AS n_broken, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY i)) AS digest FROM merged JOIN n USING (doc_id) GROUP BY doc_id""")
def c3(spark, sf_dir):
    broken = F.coalesce("text", F.lit(""))
    for what, by in BROKEN:
        broken = F.replace(broken, F.lit(what), F.lit(by))
    rows = texts(spark, sf_dir).select("doc_id", T.normalize_spaces(broken).alias("text")).withColumn("merged", T.merge_broken_lines("text"))
    lines = lambda c: long(F.size(F.split(c, "\n")))
    return rows.select("doc_id", lines("text").alias("n_broken"), lines("merged").alias("n_lines"), F.sha2("merged", 256).alias("digest"))


@query("c4_clean_blocks", f"WITH {BLOCKS_SQL}, s AS (SELECT doc_id, block_index, text, {sql_strip(C1_SQL)} AS s FROM blocks) SELECT doc_id, block_index, sha256(CASE WHEN s = '' OR {NOISE_SQL} THEN text ELSE s END) AS digest FROM s")
def c4(spark, sf_dir):
    return statute_blocks(spark, sf_dir).select("doc_id", "block_index", F.sha2(T.clean_block("text"), 256).alias("digest"))


@query("l1_levels", f"WITH {BLOCKS_SQL} SELECT doc_id, block_index, {sql_level(sql_strip('text'))} AS law_level FROM blocks")
def l1(spark, sf_dir):
    return statute_blocks(spark, sf_dir).select("doc_id", "block_index", T.level("text").alias("law_level"))


TITLES = {"is_part": "编", "is_chapter": "章", "is_section": "节", "is_article": "条", "is_item": "项"}
TITLES_SQL = ", ".join("regexp_matches(s, '" + "|".join(p for n, p in T.LEVELS if n == name) + f"') AS {column}" for column, name in TITLES.items())


@query("l2_title_predicates", f"WITH {BLOCKS_SQL} SELECT doc_id, block_index, {TITLES_SQL} FROM (SELECT doc_id, block_index, {sql_strip('text')} AS s FROM blocks)")
def l2(spark, sf_dir):
    return statute_blocks(spark, sf_dir).select("doc_id", "block_index", *[T.begins("text", name).alias(c) for c, name in TITLES.items()])


@query("a12_level_histogram", f"WITH {BLOCKS_SQL} SELECT coalesce({sql_level(sql_strip('text'))}, 'null') AS law_level, count(*) AS n FROM blocks GROUP BY 1")
def a12(spark, sf_dir):
    return quality.group_counts(statute_blocks(spark, sf_dir), T.level("text"), "law_level")


@query("w1_section_paths", f"WITH {STRUCTURED_SQL} SELECT doc_id, block_index, law_level, section_path, article_no FROM structured")
def w1(spark, sf_dir):
    return structured(spark, sf_dir).select("doc_id", "block_index", "law_level", "section_path", "article_no")


@query("w3_split_articles", f"""WITH {BLOCKS_SQL}, one AS (SELECT doc_id, block_index // 4 AS block_index, string_agg(text, chr(10) ORDER BY block_index) AS text FROM blocks GROUP BY doc_id, block_index // 4),
l AS (SELECT doc_id, block_index, list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}) AS l FROM one),
n AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '^第{T.CN_NUMERAL}条'))) AS n FROM l),
e AS (SELECT doc_id, block_index, unnest(range(len(l))) AS pos, unnest(l) AS line FROM n WHERE n >= 2),
p AS (SELECT *, sum((pos > 0 AND regexp_matches(line, '^第{T.CN_NUMERAL}条'))::INT) OVER (PARTITION BY doc_id, block_index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM e),
j AS (SELECT doc_id, block_index, part, {sql_strip('string_agg(line, chr(10) ORDER BY pos)')} AS text FROM p GROUP BY doc_id, block_index, part)
SELECT doc_id, block_index, sha256(text) AS digest, NULL::BIGINT AS part FROM one JOIN n USING (doc_id, block_index) WHERE n < 2
UNION ALL SELECT doc_id, (block_index * 1000 + part)::BIGINT, sha256(text), part::BIGINT FROM j WHERE text <> ''""")
def w3(spark, sf_dir):
    four = F.transform(F.sequence(F.lit(1), F.size("blocks"), F.lit(4)), lambda i: F.array_join(F.slice("blocks", i, F.lit(4)), "\n"))
    one = statute_documents(spark, sf_dir).select("doc_id", F.posexplode_outer(four).alias("block_index", "text"))
    return structure.split_articles(one).select("doc_id", long("block_index").alias("block_index"), F.sha2("text", 256).alias("digest"), "part")


@query("f12_contents_runs", f"""WITH {BLOCKS_SQL}, l AS (SELECT *, {sql_level(sql_strip('text'))} AS law_level FROM blocks), h AS (SELECT *, coalesce(law_level IN ('编', '章', '节'), false) AS h FROM l),
r AS (SELECT *, count(*) FILTER (WHERE NOT h) OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS run FROM h),
g AS (SELECT doc_id, run, count(*) FILTER (WHERE h) > count(DISTINCT law_level) FILTER (WHERE h) AS repeats FROM r GROUP BY doc_id, run)
SELECT doc_id, block_index, law_level FROM r JOIN g USING (doc_id, run) WHERE NOT (h AND repeats)""")
def f12(spark, sf_dir):
    b = statute_blocks(spark, sf_dir).withColumn("law_level", T.level("text"))
    return structure.drop_heading_runs(b).select("doc_id", "block_index", "law_level")


REF_SQL = f"list_transform(regexp_extract_all(text, '{T.REFERENCE}'), lambda x: regexp_replace(x, ' +', '', 'g'))"
UNIQUE_SQL = "list_filter(r, lambda x, i: list_position(r, x) = i)"


@query("e3_article_references", f"WITH {BLOCKS_SQL}, d AS (SELECT doc_id, string_agg(text, '至' ORDER BY block_index) AS text FROM blocks GROUP BY doc_id), r AS (SELECT doc_id, {REF_SQL} AS r FROM d) SELECT doc_id, nullif(array_to_string({UNIQUE_SQL}, '、'), '') AS refs, len({UNIQUE_SQL}) AS n_refs FROM r")
def e3(spark, sf_dir):
    r = statute_documents(spark, sf_dir).select("doc_id", T.references(F.array_join("blocks", "至")).alias("r"))
    return r.select("doc_id", F.nullif(F.array_join("r", "、"), F.lit("")).alias("refs"), F.size("r").cast("long").alias("n_refs"))


@query("e1_e2_article_numbers", f"WITH {BLOCKS_SQL}, s AS (SELECT doc_id, block_index, {sql_strip('text')} AS s FROM blocks) SELECT doc_id, block_index, coalesce(nullif(regexp_extract(s, '^第{T.CN_NUMERAL}条'), ''), nullif(regexp_extract(s, '第{T.CN_NUMERAL}条'), '')) AS article_no, nullif(regexp_extract(s, '^第{T.CN_NUMERAL}章'), '') AS chapter_no, nullif(regexp_extract(s, '^第{T.CN_NUMERAL}节'), '') AS section_no FROM s")
def e1(spark, sf_dir):
    return statute_blocks(spark, sf_dir).select("doc_id", "block_index", T.numbered("text", "条", True).alias("article_no"), T.numbered("text", "章").alias("chapter_no"), T.numbered("text", "节").alias("section_no"))


@query("e4_article_ranges", f"WITH {STRUCTURED_SQL}, o AS (SELECT doc_id, list(article_no ORDER BY block_index) FILTER (WHERE article_no IS NOT NULL) AS r FROM structured GROUP BY doc_id), u AS (SELECT doc_id, {UNIQUE_SQL} AS u FROM o) SELECT doc_id, CASE len(u) WHEN 0 THEN NULL WHEN 1 THEN u[1] ELSE u[1] || '-' || u[-1] END AS article_range FROM u")
def e4(spark, sf_dir):
    s = structured(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("article_no").isNotNull(), F.struct("block_index", "article_no")))).alias("a"))
    return s.select("doc_id", T.article_range(F.transform("a", lambda x: x["article_no"])).alias("article_range"))


@query("e5_expected_paths", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN array_to_string(list_concat(['vol1', 'docx'], list_filter(string_split(replace('a\\' || c_mktsegment || '//./' || c_name, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), ['f.docx']), '/') END AS path FROM customer")
def e5(spark, sf_dir):
    from corvane.sources.records import expected_path

    folder = F.concat(F.lit("a\\"), "c_mktsegment", F.lit("//./"), "c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", expected_path(folder, F.when(F.col("c_custkey") % 5 != 0, "f.docx"), F.lit("vol1")).alias("path"))


@query("e6_garbled", f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE round((length(text) - length(translate(text, '{T.GARBLED}', '')))::DOUBLE / length(text), 9) END AS garbled FROM documents")
def e6(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.garbled_share("text"), 9).alias("garbled"))


@query("e8_format_bytes", "SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f B', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS size FROM (SELECT doc_id, (n_chars * 1024 * (doc_id % 64))::DOUBLE AS n FROM documents)")
def e8(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.format_bytes(F.col("n_chars") * 1024 * (F.col("doc_id") % 64)).alias("size"))


@query("x1_x2_token_estimates", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 0.7::DOUBLE))::BIGINT END AS by_chars, ceil(octet_length(encode(text)) / 2)::BIGINT AS by_bytes FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def x1(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.tokens_by_chars("text").alias("by_chars"), T.tokens_by_bytes("text").alias("by_bytes"))


#: Characters of a piece at most.
WIDTH = int(1200 * T.CHARS_PER_TOKEN)


def sql_cut() -> str:
    """Where w, the next window of a long text, is cut."""
    last = lambda mark: f"length(regexp_extract(w, '(?s)^.*{mark}'))"
    return "CASE " + " ".join(f"WHEN {last(mark)} - 1 > {WIDTH} * 0.5 THEN {last(mark)}" for mark in T.CUT_AFTER) + f" ELSE {WIDTH} END"


@query("x3_split_long", f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, -1::BIGINT AS piece, NULL::VARCHAR AS part, t AS rest FROM d WHERE length(t) > {WIDTH}
  UNION ALL SELECT doc_id, piece + 1, CASE WHEN c IS NULL THEN rest ELSE {sql_strip('substring(rest, 1, c)')} END, CASE WHEN c IS NULL THEN '' ELSE {sql_strip('substring(rest, c + 1)')} END
  FROM (SELECT *, CASE WHEN length(rest) > {WIDTH} THEN {sql_cut()} END AS c FROM (SELECT *, substring(rest, 1, {WIDTH}) AS w FROM p WHERE rest <> '')))
SELECT doc_id, piece, length(part) AS chars FROM p WHERE piece >= 0 UNION ALL SELECT doc_id, 0, length(t) FROM d WHERE length(t) <= {WIDTH}""")
def x3(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_long(F.coalesce("text", F.lit("")), 1200)).alias("piece", "text")).select("doc_id", long("piece").alias("piece"), F.char_length("text").cast("long").alias("chars"))


@query("x4_truncate", f"SELECT doc_id, ceil(octet_length(encode(coalesce(shortened, ''))) / 2)::BIGINT AS tokens, ends_with(shortened, '{T.TRUNCATED}') AS cut FROM {sql_truncated('documents', 'text', '200')}")
def x4(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.truncate("text", 200).alias("text")).select("doc_id", T.tokens_by_bytes("text").alias("tokens"), F.endswith("text", F.lit(T.TRUNCATED)).alias("cut"))


@query("x5_embedding_text", "SELECT doc_id, sha256(CASE WHEN header = '' THEN text ELSE header || chr(10) || chr(10) || '正文：' || chr(10) || text END) AS digest FROM (SELECT doc_id, coalesce(text, '') AS text, concat_ws(chr(10), CASE WHEN doc_id % 3 > 0 THEN '法规标题：' || source END, CASE WHEN doc_id % 2 > 0 THEN '章节路径：' || lang END) AS header FROM documents)")
def x5(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.sha2(T.embedding_text("text", title=F.when(F.col("doc_id") % 3 > 0, F.col("source")), section_path=F.when(F.col("doc_id") % 2 > 0, F.col("lang"))), 256).alias("digest"))


@query("x6_ids", "SELECT doc_id, sha256(doc_id || ':0:' || substring(sha256(text), 1, 16)) AS chunk_id, sha256(doc_id || ':block:3') AS block_id, 'doc_' || substring(sha256('incremental:' || source), 1, 24) AS inc_doc_id, 'ver_' || substring(sha256(doc_id || ':' || sha256(text)), 1, 24) AS version_id FROM documents WHERE text IS NOT NULL")
def x6(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", ids.chunk_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"), ids.block_id(F.col("doc_id"), F.lit(3)).alias("block_id"), ids.incremental_doc_id(F.col("source")).alias("inc_doc_id"), ids.version_id(F.col("doc_id"), F.sha2("text", 256)).alias("version_id"))


@query("x8_display", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN source END, CASE WHEN doc_id % 4 = 1 THEN lang END, CASE WHEN doc_id % 4 = 2 THEN doc_id || '.txt' END, '未命名资料') AS title, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN '段落 ' || doc_id || '-' || (doc_id + 2) ELSE '' END AS location FROM documents")
def x8(spark, sf_dir):
    i, no = F.col("doc_id"), F.lit(None).cast("string")
    title = T.display_title(F.when(i % 4 == 0, F.concat(F.lit(" "), "source")), F.when(i % 4 == 1, F.col("lang")), F.when(i % 4 == 2, F.concat(F.lit("a\\b/"), i.cast("string"), F.lit(".txt"))).otherwise(F.lit("")))
    place = T.display_location(F.when(i % 3 == 0, F.col("lang")), no, no, F.when(i % 3 == 1, i), F.when(i % 3 == 1, i + 2))
    return read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), place.alias("location"))


def sql_shown(x: str) -> str:
    """T.display_text(): one line without control characters and paths, its first 300 characters, escaped."""
    line = sql_strip(f"regexp_replace(regexp_replace(nfc_normalize(coalesce({x}, '')), '\\pC', ' ', 'g'), '{T.WS}+', ' ', 'g')")
    line = rf"regexp_replace({line}, '(?i)(?:[a-z]:[\\/]|\\\\)[^ ]*', '{T.HIDDEN_PATH}', 'g')"
    line = rf"regexp_replace({line}, '(^| )/(?:projects|home|var|tmp|opt|usr|etc)(?:/[^ ]*)?', '\1{T.HIDDEN_PATH}', 'g')"
    line = f"(SELECT CASE WHEN length(o) > 300 THEN left(o, 299) || '…' ELSE o END FROM (SELECT {line} AS o))"
    return rf"regexp_replace(replace(replace(replace({line}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\[\]()*_`#!|])', '\\\1', 'g')"


@query("x9_display_text", f"SELECT doc_id, {sql_shown('text')} AS shown FROM documents")
def x9(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.display_text("text").alias("shown"))


@query("x12_evidence_json", "SELECT doc_id, sha256(to_json({evidence_no: doc_id, title: source, location: lang, content: text})) AS digest FROM documents")
def x12(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.evidence_json(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text")), 256).alias("digest"))


@query("x12_evidence_json_whole")  # DuckDB and Spark may escape controls differently; a test reads the JSON again
def x12_whole(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.evidence_json(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text")).alias("evidence"))


@query("x13_redaction", r"SELECT doc_id, r <> text AS changed, length(r) AS n FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(authorization[ \t]*[:=][ \t]*)[^\r\n,;]+', '\1***', 'g'), '(?i)((?:api[_-]?key|token|password|secret)[ \t]*[:=][ \t]*)[^ \t\r\n,;]+', '\1***', 'g'), '[A-Za-z]:\\[^ \t\r\n]+', '<path>', 'g'), '/(?:home|root|var|tmp|opt|usr|etc)/[^ \t\r\n]*', '<path>', 'g') AS r FROM documents)")
def x13(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("r", T.redact("text"))
    return d.select("doc_id", (F.col("r") != F.col("text")).alias("changed"), F.char_length("r").cast("long").alias("n"))


@query("x14_one_line", f"SELECT doc_id, substring({sql_strip('regexp_replace(text, ' + chr(39) + T.WS + '+' + chr(39) + ', chr(32), chr(103))')}, 1, 300) AS line FROM documents")
def x14(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.one_line("text").alias("line"))
