"""Micro-batches of documents, chunks, postings, vectors and tombstones against what plain Python gives."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import address, enrichment, postings
from corvane.operators.storage import kept
from corvane.plans.manifest import Layer, Manifest, ManifestConflict, ManifestStore
from corvane.streaming import ingest

ROWS = "key string, text string"


def vectors_of(chunks):
    """Two numbers that follow from the text."""
    n = F.char_length("text").cast("float")
    return chunks.select("chunk_id", F.array(n, F.lit(1.0).cast("float")).alias("embedding"))


def told(store):
    return {r.key: r.text for r in ingest.living(store, store.current()).collect()}


def put(store, spark, name, rows):
    return ingest.ingest_batch(store, spark.createDataFrame(rows, ROWS), name, ingest.whole_texts, vectors_of)


def brute(store, terms, match_all):
    """layer, chunk, score of the living chunks of the store's layers."""
    chunks = ingest.living(store, store.current(), "chunks").collect()
    out = {}
    for layer in {r.layer for r in chunks}:
        own = {r.chunk_id: re.findall(r"\w+", r.text.lower()) for r in chunks if r.layer == layer}
        avg = sum(map(len, own.values())) / len(own)
        f = {t: {c: sum(w.startswith(t) for w in ws) for c, ws in own.items()} for t in terms}
        n = {t: sum(v > 0 for v in f[t].values()) for t in terms}
        for c, ws in own.items():
            if (all if match_all else any)(f[t][c] for t in terms):
                out[layer, c] = -sum(max(1e-6, math.log((len(own) - n[t] + 0.5) / (n[t] + 0.5))) * f[t][c] * 2.2 / (f[t][c] + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for t in sorted(terms))
    return out


def searched(store, spark, terms, match_all):
    asks = spark.createDataFrame([(0, [[t] for t in terms])], "query_id long, groups array<array<string>>")
    return {(r.layer, r.chunk_id): r.score for r in postings.bm25(ingest.search_index(store, store.current()), asks, match_all=match_all).collect()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A base and three deltas: new, changed, unchanged, failed and deleted documents, and one that comes back as it was."""
    root = str(tmp_path_factory.mktemp("kb") / "kb")
    rows = [("a", "red apple tree"), ("b", "blue sky and blue sea"), ("c", "apple pie"), ("d", "the sky"), ("e", None)]
    s = ingest.initialise(spark, root, spark.createDataFrame(rows, ROWS), ingest.whole_texts, vectors_of)
    put(s, spark, "one", [("a", "green apple"), ("b", "blue sky and blue sea"), ("f", "apples fall"), ("g", " \n"), ("c", "")])
    put(s, spark, "two", [("a", "red apple tree"), ("f", "pears fall from the tree"), ("f", "pears fall from the tree")])
    ingest.delete(s, spark.createDataFrame([("d",), ("nobody",)], "key string"), "three")
    return s


def test_living_documents_and_tombstones(spark, store):
    assert told(store) == {"a": "red apple tree", "b": "blue sky and blue sea", "c": "apple pie", "f": "pears fall from the tree"}
    manifest = store.current()
    assert manifest.revision == 4 and [x.layer_id for x in manifest.layers] == ["base", "one", "two", "three"]
    found = {(r.layer, r.entity_type): set() for r in ingest.tombstones(store, manifest).collect()}
    for r in ingest.tombstones(store, manifest).collect():
        found[r.layer, r.entity_type].add(r.entity_id)
    every = {t: ingest.all_rows(store, manifest, t).collect() for t in ("documents", "chunks", "vectors")}
    doc = {r.key: r.doc_id for r in every["documents"]}
    for layer, keys in ((1, "a"), (2, "af"), (3, "d")):
        ids = {doc[k] for k in keys}
        old = {k: [r for r in every["chunks"] if r.doc_id == doc[k] and r.layer < layer][-1] for k in keys}
        assert found[layer, "chunk"] == {r.chunk_id for r in old.values()}
        assert found[layer, "vector"] == {str(r.vector_id) for r in old.values()}
        assert len(found[layer, "doc_version"]) == len(ids)
    assert [(r.key, r.error, r.layer) for r in ingest.all_rows(store, manifest, "failures").orderBy("layer", "key").collect()] == [("e", "EMPTY_TEXT", 0), ("c", "EMPTY_TEXT", 1), ("g", "EMPTY_TEXT", 1)]
    assert sorted(r.vector_id for r in every["vectors"]) == list(range(manifest.next_vector_id)) == sorted(r.vector_id for r in every["chunks"])
    alive = {r.chunk_id: r.text for r in ingest.living(store, manifest, "chunks").collect()}
    assert {r.chunk_id: r.embedding[0] for r in ingest.living(store, manifest, "vectors").collect()} == {c: float(len(t)) for c, t in alive.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_over_layers(spark, store, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(postings, "MOST_BROADCAST", 0)
    for terms, match_all in ((["apple"], True), (["app", "tree"], False), (["sky", "blue"], True), (["the"], False), (["none"], True)):
        want = brute(store, terms, match_all)
        got = searched(store, spark, terms, match_all)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_compaction_and_cleanup(spark, store, tmp_path):
    """After compaction the same documents are found; a reader of the revision before goes on until that is cleaned away."""
    root = str(tmp_path / "copy")
    os.system(f"cp -r {store.root} {root}")
    own = ManifestStore(spark, root)
    before, old, text = own.current(), told(own), {r.chunk_id: r.text for r in ingest.living(own, own.current(), "chunks").collect()}
    after = ingest.compact(own, "base-2")
    assert told(own) == old and after.deltas == () and after.next_vector_id == before.next_vector_id
    for terms in (["apple"], ["tree", "fall"]):
        want = brute(own, terms, False)
        got = searched(own, spark, terms, False)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {c for _, c in searched(own, spark, ["apple"], True)} == {c for c, t in text.items() if "apple" in t}
    assert ingest.clean(own, 2, 0) == [] and {r.key for r in ingest.living(own, before).collect()} == set(old)  # both revisions are readable
    put(own, spark, "four", [("h", "new")])
    spark.range(1).write.parquet(f"{root}/under-way/documents")
    assert ingest.clean(own, 2) == [] and ingest.clean(own, 2, 0) == ["base", "one", "three", "two", "under-way"]
    assert told(own) == old | {"h": "new"} and own.revisions() == [5, 6]


def test_a_changed_row_is_found(spark, store, tmp_path):
    assert ingest.tampered(store, store.current()) == []
    root = str(tmp_path / "copy")
    os.system(f"cp -r {store.root} {root}")
    own = ManifestStore(spark, root)
    rows = kept(spark.read.parquet(f"{root}/one/chunks").withColumn("text", F.when(F.col("text") == "green apple", "green apples").otherwise(F.col("text"))))
    rows.write.mode("overwrite").parquet(f"{root}/one/chunks")
    assert ingest.tampered(own, own.current()) == ["one"]


def test_addresses(spark):
    rows = spark.range(5_000).selectExpr("id", "cast(id % 7 as string) s", "if(id % 3 = 0, null, id) n")
    whole = address.address(rows)
    assert whole == address.address(rows.select("s", "n", "id").repartition(7).orderBy(F.desc("id"))) and len(whole) == 64
    assert whole != address.address(rows.unionByName(rows.limit(1))) and whole != address.address(rows.filter("id <> 9"))
    changed = rows.withColumn("n", F.when(F.col("id") == 77, 1).otherwise(F.col("n")))
    assert whole != address.address(changed) and 1 <= address.differing(rows, changed).count() <= 2 and address.differing(rows, rows).isEmpty()
    assert address.address(rows.filter("id < 0")) == address.EMPTY
    pair = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert address.address(pair.limit(1)) != address.address(pair.filter("x = 'a'"))


def test_races_and_implicit_base(spark, tmp_path):
    root = str(tmp_path / "kb")
    own = ManifestStore(spark, root)
    assert own.current() is None
    ingest.versioned(spark.createDataFrame([("a", "1")], ROWS)).write.parquet(f"{root}/base/documents")
    implicit = own.current()
    assert implicit.revision == 0 and told(own) == {"a": "1"}
    own.publish(Manifest(1, implicit.base), 0)
    with pytest.raises(ManifestConflict):
        own.publish(Manifest(1, Layer("other", "other", "0" * 64)), 0)


def test_structured_chunks_of_a_stream(spark, tmp_path):
    """Two files, two micro-batches, chunks by structure; a second run of the stream brings nothing."""
    store = ingest.initialise(spark, str(tmp_path / "kb"), spark.createDataFrame([("law", "第一章 总则\n\n第一条 为了规范。")], ROWS))
    for n, text in enumerate(("第一章 总则\n\n第一条 为了规范。\n\n第二条 本法所称许可。", "第一章 附则\n\n第三条 自公布之日起施行。")):
        spark.createDataFrame([("law", text)], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            ingest.ingest_stream(store, spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
        assert store.current().revision == n + 2 and told(store) == {"law": text}
    chunks = [r.text for r in ingest.living(store, store.current(), "chunks").orderBy("chunk_index").collect()]
    assert "第三条" in "".join(chunks) and "第二条" not in "".join(chunks)


def service(log, fails_at=None):
    """A service that writes down what it was asked, answers in reverse order, and fails at some text."""

    def ask(texts):
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if fails_at in texts:
            raise OSError("no answer")
        return [(i, [float(len(t)), 0.5]) for i, t in reversed(list(enumerate(texts)))]

    return ask


def test_a_killed_run_repeats_no_committed_chunk(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(200)] + [("c5", "text 5"), (None, "x")], "chunk_id string, text string")
    folder, log = str(tmp_path / "vectors"), str(tmp_path / "log")
    late = chunks.filter("pmod(xxhash64(chunk_id), 6) = 3").agg(F.max("text")).first()[0]  # of the fourth of six parts
    with pytest.raises(Exception, match="no answer"):
        enrichment.enrich(chunks, service(log, late), 2, folder, batch=8, part_rows=40, tries=2, first_delay=0.0)
    there = {r.chunk_id for r in spark.read.parquet(folder).collect()}
    assert 0 < len(there) < 200 and late.replace("text ", "c") not in there
    open(log, "w").close()
    got = {r.chunk_id: r.embedding for r in enrichment.enrich(chunks, service(log), 2, folder, batch=8, part_rows=40).collect()}
    asked = open(log).read().split("\n")[:-1]
    assert sorted(asked) == sorted(f"text {i}" for i in range(200) if f"c{i}" not in there)
    assert got == {f"c{i}": [float(len(f"text {i}")), 0.5] for i in range(200)}
    open(log, "w").close()
    assert enrichment.enrich(chunks, service(log), 2, folder).count() == 200 and open(log).read() == ""


def test_delays_and_wrong_answers():
    waits, tries = [], []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 8:
            raise OSError
        return [(0, [1.0])]

    assert enrichment.answered(flaky, ["a"], 1, 10, 1.0, waits.append) == [[1.0]] and waits == [1, 2, 4, 8, 16, 30, 30]
    for wrong in ([(0, [1.0]), (0, [1.0])], [(1, [1.0]), (0, [1.0, 2.0])], []):
        with pytest.raises(enrichment.ServiceAnswerError):
            enrichment.answered(lambda _, w=wrong: w, ["a", "b"], 1, 1, 0)


@pytest.mark.parametrize("most", [0, 100_000])
def test_texts_of_a_batch_stay_where_they_are(spark, tmp_path, monkeypatch, most):
    """Unchanged keys, keys of several rows, failures: the same layer whether texts meet keys by a shuffle or not. Postings know chunks by number."""
    monkeypatch.setattr(postings, "MOST_BROADCAST", most)
    plans = []
    real = ingest.write_layer
    monkeypatch.setattr(ingest, "write_layer", lambda store, path, docs, *more: plans.append(docs._jdf.queryExecution().executedPlan().toString()) or real(store, path, docs, *more))
    own = ingest.initialise(spark, str(tmp_path / "kb"), spark.createDataFrame([(k, f"text of {k}") for k in "abcd"], ROWS), ingest.whole_texts, vectors_of)
    put(own, spark, "one", [("a", "text of a"), ("b", "more of b"), ("e", "text of e"), ("e", "text of e"), ("f", " "), (None, "x")])
    assert told(own) == {"a": "text of a", "b": "more of b", "c": "text of c", "d": "text of d", "e": "text of e"}
    assert ("SortMergeJoin" in plans[1] or "ShuffledHashJoin" in plans[1]) is False
    assert sorted(r.vector_id for r in ingest.all_rows(own, own.current(), "chunks").collect()) == list(range(6)) and own.current().next_vector_id == 6
    assert [r.key for r in ingest.all_rows(own, own.current(), "failures").collect()] == ["f"]
    for terms in (["text"], ["of", "more"]):
        want = brute(own, terms, False)
        got = searched(own, spark, terms, False)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert set(spark.read.parquet(f"{own.root}/one/index/postings").columns) == {"layer", "vector_id", "token", "tf"}
    assert not os.path.exists(f"{own.root}/one/taken") and not os.path.exists(f"{own.root}/one/cut")
