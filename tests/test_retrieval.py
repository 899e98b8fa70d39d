import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import context, postings, retrieval
from corvane.operators.storage import kept
from corvane.plans.keyword import with_plans


def hits(spark, rows):
    return spark.createDataFrame(rows, "id string, rank long, score double")


def test_fusion(spark):
    got = retrieval.fuse(hits(spark, [("c1", 1, 0.7), ("c2", 2, 0.8)]), hits(spark, [("c2", 1, -1.0), ("c3", 2, -1.0)]), "id").orderBy("rank").collect()
    assert [r.id for r in got] == ["c2", "c1", "c3"] and got[0].matched_by == "both"
    assert math.isclose(got[0].fused, 0.6 / 62 + 0.4 / 61)
    with pytest.raises(ValueError):
        retrieval.fuse(hits(spark, []), hits(spark, []), "id", k=0)


def test_ties_go_to_vector_hits_then_ids(spark):
    got = retrieval.fuse(hits(spark, [("b", 1, 0.5), ("z", 2, 0.5)]), hits(spark, [("a", 1, 0.0)]), "id", vector_weight=0.5, keyword_weight=0.5).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "z"]


def test_cap(spark):
    ranked = spark.createDataFrame([("1", "a", 1), ("2", "a", 2), ("3", "b", 3), ("4", "c", 4)], "id string, doc string, rank long")
    got = retrieval.cap_per_document(ranked, "doc", 1, 3).orderBy("final_rank").collect()
    assert [r.id for r in got] == ["1", "3", "4"]


def test_knn_matches_single_search(spark):
    rows = [(i, [math.sin(i), math.cos(i), i % 3 / 3]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = retrieval.knn(v.filter("vec_id < 4"), v, 5).orderBy("query_id", "rank").collect()
    for q in range(4):
        one = retrieval.vector_search(v, v.filter(f"vec_id = {q}").first().embedding, 5).collect()
        assert [r.vec_id for r in got if r.query_id == q] == [r.vec_id for r in one]


def test_knn_with_ties_and_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(400)] + [(None, [1.0, 1.0, 1.0]), (999, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = set()
    for q, x in rows[:40]:
        best = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows[:400]))[:7]
        want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(best)}
    for size, together in ((64 << 20, 512), (24 * 9, 2)):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        monkeypatch.setattr(retrieval, "TOGETHER", together)
        assert {tuple(r) for r in retrieval.knn(v.filter("vec_id < 40"), v, 7).collect()} == want
    assert retrieval.knn(v.limit(0), v, 3).collect() == [] == retrieval.knn(v, v.limit(0), 3).collect()


def brute_bm25(docs, terms):
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in docs.items()}
    avg = sum(map(len, words.values())) / len(words)
    out = {}
    for i, w in words.items():
        total = 0.0
        for t in terms:
            n, f = sum(any(x.startswith(t) for x in v) for v in words.values()), sum(x.startswith(t) for x in w)
            total += max(1e-6, math.log((len(words) - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / avg))
        out[i] = -total
    return out


GROUPS = "query_id long, strict_groups array<array<string>>, relaxed_groups array<array<string>>"


@pytest.mark.parametrize("few", [0, 64])
def test_bm25_against_brute_force(spark, monkeypatch, few):
    """Three questions at once, of which one has a term that nothing has; rows and layers that are empty."""
    monkeypatch.setattr(postings, "FEW_TERMS", few)
    docs = {1: "alpha beta alphabet", 2: "beta gamma", 3: "gamma delta delta", 4: "epsilon", 5: "alpha 更新规划 x", 6: None, 7: "Été ete"}
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "id long, text string, layer long")
    index = postings.write_index(df, "id", ["text"])
    asked = spark.createDataFrame([(0, [["alph", "更新"], ["beta"]], None), (1, [["ÉT"], ["none"]], None), (2, [["alph"], ["beta"]], None)], GROUPS)
    any_of = {(r.query_id, r.id): r.score for r in postings.bm25(index, asked, "strict_groups", False).collect()}
    plain = {i: (t or "").replace("É", "e").replace("é", "e") for i, t in docs.items()}
    for q, terms in ((0, ["alph", "更新", "beta"]), (1, ["et", "none"]), (2, ["alph", "beta"])):
        want = {i: s for i, s in brute_bm25(plain, terms).items() if s}
        got = {i: s for (k, i), s in any_of.items() if k == q}
        assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in got)
    assert {(r.query_id, r.id) for r in postings.bm25(index, asked, "strict_groups", True).collect()} == {(0, 1), (2, 1)}
    assert postings.bm25(index, asked.limit(0), "strict_groups").collect() == []
    index.drop()
    empty = postings.write_index(df.limit(0), "id", ["text"])
    assert postings.bm25(empty, asked, "strict_groups").collect() == []


def test_an_index_is_read_by_prefix(spark):
    df = spark.range(3_000).selectExpr("id", "concat('w', id, ' the') text", "0L layer")
    index = postings.write_index(df, "id", ["text"])
    plan = postings.bm25(index, spark.createDataFrame([(0, [["w12"]], None)], GROUPS), "strict_groups")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan  # texts are not read again


def test_relaxed_only_in_layers_without_strict_matches(spark):
    df = spark.createDataFrame([(1, "a b", 0), (2, "a", 0), (3, "a", 1), (4, "b", 1)], "id long, text string, layer long")
    index = postings.write_index(df, "id", ["text"])
    asked = spark.createDataFrame([(0, [["a"], ["b"]], [["a", "b"]]), (1, [["a"], ["b"]], None)], GROUPS)
    got = postings.keyword_search(index, asked, 9).collect()
    assert {(r.query_id, r.id) for r in got} == {(0, 1), (0, 3), (0, 4), (1, 1)}


def test_fusion_of_many_questions(spark):
    make = lambda rows: spark.createDataFrame(rows, "q long, id string, rank long, score double")
    v, w = make([(0, "c1", 1, 0.7), (0, "c2", 2, 0.8), (1, "c2", 1, 0.9)]), make([(0, "c2", 1, -1.0), (0, "c3", 2, -1.0), (2, "c1", 1, -1.0)])
    got = retrieval.fuse(v, w, "id", by="q")
    assert [(r.q, r.id) for r in got.orderBy("q", "rank").collect()] == [(0, "c2"), (0, "c1"), (0, "c3"), (1, "c2"), (2, "c1")]
    capped = retrieval.cap_per_document(got.withColumn("doc", F.lit("d")), "doc", 2, 5, by="q").orderBy("q", "final_rank").collect()
    assert [(r.q, r.id) for r in capped] == [(0, "c2"), (0, "c1"), (1, "c2"), (2, "c1")]


def plans(spark, questions):
    df = spark.createDataFrame(list(enumerate(questions)), "i int, strict string")  # a column by a name of the plan's
    return with_plans(df.withColumnRenamed("strict", "q"), "q").orderBy("i").collect()


def test_query_plans(spark):
    p = plans(spark, ["河北保定的城市更新规划是什么？", "请问第十条有哪些规定", "ABC123 关于环境保护条例的处罚", "河北省的第二条规定条例规定吗呢", "内蒙古包头的供热条例"])
    assert p[0].strict == '("河北省"* OR "保定市"*) AND ("城市更新规划"* OR "城市更新"*)'
    assert p[0].relaxed == '("河北省"* OR "保定市"* OR "城市更新规划"* OR "城市更新"*)' and p[0].n_terms == 4
    assert (p[1].strict, p[1].relaxed) == ('"第十条"*', None)
    assert p[2].groups == [["环境保护条例", "环境保护", "环境", "处罚"], ["ABC123"]]
    assert p[3].groups == [["河北省"], ["规定条例规定", "规定条例", "规定"], ["第二条"]]
    assert p[4].groups[0] == ["内蒙古自治区", "包头市"]
    assert [(r.strict, r.relaxed, r.n_terms) for r in plans(spark, ["", "  ", "？！", "\x00", None])] == [(None, None, 0)] * 5
    many, none, one, long = plans(spark, [" ".join(f"a{i}" for i in range(99)), "and or not", "ABC", " ".join(f"{i:03}" + "x" * 70 for i in range(20))])
    assert many.n_terms == 16 and none.strict is None and one.relaxed is None
    assert long.n_terms == 16 and long.strict is None and all(len(t) == 64 for t in long.groups[0])


def test_history(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a" * 100), (1, 2, "assistant", "b" * 40), (1, 3, "user", "  "), (1, 4, "user", "now?"), (1, 5, "assistant", "later")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert context.latest_question(turns).first().question == "now?"
    whole = context.history_window(turns, 1000).orderBy("turn").collect()
    assert [r.line for r in whole] == ["用户：" + "a" * 100, "助手：" + "b" * 40]
    cut = context.history_window(turns, 70).orderBy("turn").collect()
    assert [r.cut for r in cut] == [True, False] and sum(-(-len(r.line.encode()) // 2) for r in cut) <= 70


def test_evidence_fits_its_budget(spark):
    rows = [(q, r, f"c{r % 7}", "t", "l", "句子。" * (30 * r)) for q in (1, 2) for r in range(1, 12)] + [(2, 99, "blank", "t", "l", " ")]
    df = spark.createDataFrame(rows, "query_id long, rank long, chunk_id string, title string, location string, text string")
    got = context.pack_evidence(df, budget=900, most=400, least=20).collect()
    for q in (1, 2):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.evidence_no)
        assert [r.evidence_no for r in own] == list(range(1, len(own) + 1)) and len({r.chunk_id for r in own}) == len(own) > 1
        assert sum(r.tokens for r in own) <= 900
        assert all(r.tokens == -(-len(context.evidence(r.evidence_no, "t", "l", r.content).encode()) // 2) for r in own)


def test_evidence_of_texts_about_as_long_as_can_be_shown(spark):
    """What leaves for the tasks is narrowed, the answer is that of whole texts: lengths around the bound, spaces there, wide letters."""
    most, least, budget = 40, 5, 400
    texts = [" " + mark * (n // len(mark.encode())) + end for mark in ("a", "句") for n in (78, 79, 80, 81, 82, 90) for end in ("", " ", "   x", ". and more")]
    rows = [(i % 3, i, f"c{i}", None if i % 5 == 0 else "t", "l", None if i % 7 == 6 else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, rank long, chunk_id string, title string, location string, text string")
    got = {(r.query_id, r.evidence_no): (r.chunk_id, r.content, r.tokens, r.cut) for r in context.pack_evidence(df, budget, most, least).collect()}
    expected = {}
    for q in range(3):
        used = no = 0
        for _, _, chunk, title, location, text in (r for r in rows if r[0] == q):
            source = (text or "").strip()
            if source and used < budget and (fits := context.fit(no + 1, title or "", location, source, budget - used, most, least)):
                no, used = no + 1, used + fits[1]
                expected[q, no] = chunk, *fits
    assert got == expected and {x[3] for x in got.values()} == {True, False}


def test_references(spark):
    rows = [(1, 1, "A\\x.DOCX", "d", "n", "p1"), (1, 2, "a/./X.docx", "d", "n", "p2"), (1, 3, "A/x.docx", "d", "n", "p1"), (1, 4, "", "D", "m", "")]
    df = spark.createDataFrame(rows, "query_id long, evidence_no long, path string, doc_id string, name string, location string")
    section = context.reference_section(context.reference_list(df)).first().section
    assert section == "参考文件：\n[1] n\n    位置：p1；p2\n    对应资料：[资料1]、[资料2]、[资料3]\n\n[2] m\n    对应资料：[资料4]"


@pytest.mark.parametrize("run", [4])
def test_pruned_search_against_all_scores(spark, monkeypatch, run):
    """Random texts with many ties, over layers, for many questions: the same answer as from all scores, few rows made, runs skipped."""
    from corvane.operators import postings as P

    monkeypatch.setattr(P, "RUN", run)
    monkeypatch.setattr(P, "RUNS_TOGETHER", 3)
    monkeypatch.setattr(P, "QUESTIONS", 7)
    pick = random.Random(run)
    words = ["the", "then", "sky", "blue", "blues", "rare", "Ölwerk", "x1"]
    chunks = [(i, i % 3, " ".join(pick.choices(words, [20, 5, 5, 4, 2, 0.1, 1, 1], k=pick.randint(1, 9)))) for i in range(600)] + [(900, 3, None)]
    index = P.write_index(spark.createDataFrame(chunks, "id long, layer long, text string"), "id", ["text"])
    asks = [(q, [pick.choices(words + ["bl", "th", "none"], k=pick.randint(1, 3)) for _ in range(pick.randint(1, 3))], pick.choice([None, [pick.choices(words, k=2)]])) for q in range(20)]
    questions = spark.createDataFrame(asks, "query_id long, strict_groups array<array<string>>, relaxed_groups array<array<string>>")
    strict = {(r.query_id, r.layer, r.id): r.score for r in P.bm25(index, questions, "strict_groups", True).collect()}
    loose = {(r.query_id, r.layer, r.id): r.score for r in P.bm25(index, questions.filter("relaxed_groups is not null"), "relaxed_groups", False).collect()}
    answered = {key[:2] for key in strict}
    want = {}
    for (q, layer, i), score in [*strict.items(), *(x for x in loose.items() if x[0][:2] not in answered)]:
        want.setdefault((q, layer), []).append((score, i))
    made = []
    real = P.best_of_tasks
    monkeypatch.setattr(P, "best_of_tasks", lambda *a: made.append(kept(real(*a))) or made[-1])
    got = {}
    for r in P.keyword_search(index, questions, 5).collect():
        got.setdefault((r.query_id, r.layer), []).append((r.rank, r.score, r.id))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: sorted(v)[:5] for k, v in want.items()}
    assert len(made) == 3 and sum(df.count() for df in made) <= 2 * 20 * 4 * 5 * 4
    index.drop()


def test_runs_that_cannot_win_are_skipped():
    import numpy as np
    import pyarrow as pa

    from corvane.operators import postings as P

    n = 10_000
    parts = np.full(n, 0.1)
    parts[:70] = 5.0
    block = P.Block(pa.array(range(n)), np.zeros(n, dtype=np.int64), np.arange(n), parts)
    touched = []
    where, own, begin, most = block.lists[0]

    class Counting(np.ndarray):
        def __getitem__(self, key):
            touched.append(np.size(key))
            return np.asarray(self)[key]

    block.lists[0] = where, own.view(Counting), begin, most
    places, sums = block.best([(0, 1)], 1, 10)
    assert places.tolist() == list(range(10)) and set(sums) == {5.0} and sum(touched) <= 2 * P.RUN * P.RUNS_TOGETHER


def test_hits_without_a_query_are_one_query(spark):
    rows = [(None, i, f"c{i}", "t", "", f"text {i}") for i in range(4)] + [(0, 1, "z", "t", "", "other"), (7, None, "y", None, None, None)]
    got = context.pack_evidence(spark.createDataFrame(rows, "query_id long, rank long, chunk_id string, title string, location string, text string")).collect()
    assert sorted((r.query_id is None, r.query_id, r.evidence_no, r.chunk_id) for r in got if r.query_id is None) == [(True, None, i + 1, f"c{i}") for i in range(4)]
    assert [(r.query_id, r.evidence_no, r.chunk_id) for r in got if r.query_id is not None] == [(0, 1, "z")]


def test_texts_are_counted_within_their_rows(spark):
    chunks = spark.createDataFrame([(0, 1, "b a b", "Á"), (0, 2, None, ""), (1, 1, "b", None), (0, 1, "b c", None), (0, None, "x", None), (0, None, "x y", None)], "layer long, id long, text string, more string")
    plan = postings.counted_tokens(chunks, "id", ["text", "more"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # a task holds no more than a row
    index = postings.write_index(chunks, "id", ["text", "more"])
    assert {(r.layer, r.id, r.token): r.tf for r in index.table("postings").collect()} == {(0, 1, "b"): 3, (0, 1, "a"): 2, (0, 1, "c"): 1, (1, 1, "b"): 1, (0, None, "x"): 2, (0, None, "y"): 1}
    assert {(r.layer, r.id): r.doc_len for r in index.table("chunks").collect()} == {(0, 1): 6, (0, 2): 0, (1, 1): 1, (0, None): 3}
    assert {r.token for r in index.table("tokens").collect()} == {"a", "b", "c", "x", "y"}
    index.drop()


@pytest.mark.parametrize("together", [400, 1_000_000])
def test_many_terms_are_searched_without_a_shuffle(spark, monkeypatch, together):
    """The forward table gives what all scores give, over layers and blocks, with ties, and no row is made of a match."""
    monkeypatch.setattr(postings, "POSTINGS_TOGETHER", together)
    monkeypatch.setattr(postings, "FEW_TERMS", 0)
    pick = random.Random(together)
    words = ["the", "then", "sky", "blue", "blues", "rare", "Ölwerk", "x1", "更新"]
    chunks = [(i, i % 3, " ".join(pick.choices(words, [20, 5, 5, 4, 2, 0.1, 1, 1, 1], k=pick.randint(1, 9)))) for i in range(600)] + [(900, 3, None), (7, 1, "then blue")]
    index = postings.write_index(spark.createDataFrame(chunks, "id long, layer long, text string"), "id", ["text"])
    asks = [(q, [pick.choices(words + ["bl", "th", "none"], k=pick.randint(1, 3)) for _ in range(pick.randint(1, 3))], pick.choice([None, [pick.choices(words, k=2)]])) for q in range(20)]
    questions = spark.createDataFrame([*asks, (99, None, None)], GROUPS)
    strict = {(r.query_id, r.layer, r.id): r.score for r in postings.bm25(index, questions, "strict_groups", True).collect()}
    loose = {(r.query_id, r.layer, r.id): r.score for r in postings.bm25(index, questions.filter("relaxed_groups is not null"), "relaxed_groups", False).collect()}
    answered, want = {key[:2] for key in strict}, {}
    for (q, layer, i), score in [*strict.items(), *(x for x in loose.items() if x[0][:2] not in answered)]:
        want.setdefault((q, layer), []).append((score, i))
    made = []
    real = postings.best_of_forward
    monkeypatch.setattr(postings, "best_of_forward", lambda *a: made.append(real(*a)) or made[-1])
    got = {}
    for r in postings.keyword_search(index, questions, 5).collect():
        got.setdefault((r.query_id, r.layer), []).append((r.rank, r.score, r.id))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: sorted(v)[:5] for k, v in want.items()}
    assert "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString()
    index.drop()


def test_tasks_of_the_index_grow_with_its_postings(spark, monkeypatch):
    monkeypatch.setattr(postings, "POSTINGS_TOGETHER", 1_000)
    index = postings.write_index(spark.range(3_000).selectExpr("id", "concat('w', id, ' a b c') text", "0L layer"), "id", ["text"])
    files = {r[0] for r in index.table("postings").select("_metadata.file_path").distinct().collect()}
    assert len(files) >= 10 and index.size() == 12_000 and index.table("forward").count() == 3_000
    index.drop()
