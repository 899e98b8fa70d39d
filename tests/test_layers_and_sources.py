import json
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.operators import layers, quality
from corvane.plans.manifest import Layer, Manifest, ManifestConflict
from corvane.queries import QUERIES, SQL
from corvane.sources import files, records
from corvane.streaming import ingest


def test_layers(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    delta = spark.createDataFrame([(3, "c", "x")], "id long, v string, extra string")
    rows = layers.stacked([base, delta])
    dead = spark.createDataFrame([(2,)], "entity_id long")
    assert {(r.id, r.layer, r.extra) for r in layers.effective(rows, dead, "id").collect()} == {(1, 0, None), (3, 1, "x")}
    assert {r.v for r in layers.upsert(base, spark.createDataFrame([(1, "z")], base.schema), "id").collect()} == {"z", "b"}


def test_ids_are_gapless_and_ordered(spark):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"))
    got = [r.vector_id for r in layers.assign_ids(rows, 3, ["k"]).orderBy("k").collect()]
    assert got == list(range(3, 5_003))


def test_intake(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "2"), ("d", "7")], known.schema)
    got = {r.key: (r.action, r.known_elsewhere) for r in layers.classify(new, known).collect()}
    assert got == {"a": ("DUPLICATE_UNCHANGED", False), "b": ("UPDATE", False), "c": ("NEW", True), "d": ("NEW", False)}


def test_page_quality(spark):
    lines = spark.createDataFrame([(1, 1, "x" * 30, 0.79), (1, 2, "x" * 30, 0.59), (2, 1, "x" * 30, 0.95)], "doc_id long, page long, text string, confidence double")
    pages = quality.page_quality(lines)
    assert {(r.doc_id, r.page): r.quality for r in pages.collect()} == {(1, 1): "warning", (1, 2): "severe", (2, 1): "ok"}
    assert {r.doc_id: r.failed for r in quality.failed_documents(pages).collect()} == {1: True, 2: False}


def test_page_quality_does_not_depend_on_the_order_of_lines(spark):
    few = random.Random(6)
    some = [[100 - x if i % 2 else x + 20 for x in few.choices(range(21, 60), k=9) for i in (0, 1)] for _ in range(300)]  # pairs that make 1.20 together
    lines = spark.createDataFrame([(i, 1, "x" * 30, c / 100) for i, n in enumerate(some) for c in few.sample(n, len(n))], "doc_id long, page long, text string, confidence double")
    assert {r.quality for r in quality.page_quality(lines).collect()} == {"warning"}  # all means are 0.60, which is not below it
    odd = spark.createDataFrame([(1, 1, "x" * 30, float("nan")), (1, 1, "x" * 30, 0.5)], lines.schema)
    assert [r["mean"] != r["mean"] for r in quality.page_quality(odd).collect()] == [True]


def test_page_means_are_added_in_the_order_of_lines(spark):
    some = [0.46, 0.74, 0.74, 0.46, 0.55, 0.65, 0.6, 0.59, 0.61] * 5
    lines = [(0, i, c) for i, c in enumerate(some)] + [(1, i, c) for i, c in enumerate(reversed(some))]
    lines += [(d, i, c) for d in range(2, 200) for i, c in enumerate(random.Random(d).sample(some, len(some)))]
    lines = spark.createDataFrame(random.Random(0).sample(lines, len(lines)), "doc_id long, line long, confidence double").selectExpr("*", "1L page", "repeat('x', 30) text").repartition(7)
    got = {r.doc_id: (r["mean"], r.quality) for r in quality.page_quality(lines, "line").collect()}
    for d, (mean, found) in got.items():
        added = 0.0
        for c in some if d == 0 else reversed(some) if d == 1 else random.Random(d).sample(some, len(some)):
            added += c
        assert (mean, found) == (added / len(some), "severe" if added / len(some) < 0.60 else "warning")
    assert {found for _, found in got.values()} == {"severe", "warning"}  # means of 0.60, some of which doubles put below it


def test_lines_without_confidence_count_for_no_share(spark):
    lines = spark.createDataFrame([(1, 1, "x" * 30, c) for c in (0.75, 0.95, 0.95, None, None)] + [(2, 1, "x" * 30, None)], "doc_id long, page long, text string, confidence double")
    for pages in (quality.page_quality(lines), quality.page_quality(lines.selectExpr("*", "coalesce(confidence, 0) o"), "o")):
        assert [(r["mean"], r.low, r.quality) for r in pages.orderBy("doc_id").collect()] == [((0.75 + 0.95 + 0.95) / 3, 1 / 3, "warning"), (None, None, "ok")]


@pytest.mark.parametrize("name", ["s10_page_quality", "s11_failed_documents"])
@pytest.mark.parametrize("n_files", [1, 7])
def test_pages_are_those_of_the_sql(spark, tmp_path, name, n_files):
    """Where means lie at a bound; rows follow one another by file and within it. By more threads DuckDB would add in another order."""
    duck = duckdb.connect(config={"threads": 1})
    duck.execute("create table t as select * from '/root/testdata/sf0.01/lineitem.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(n_files):
        duck.execute(f"copy (select * from t where rowid % {n_files} = {k}) to '{tmp_path}/lineitem.parquet/{k}.parquet'")
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(f"select {', '.join(found.columns)} from ({SQL[name]})").fetchall())


def test_consistency(spark):
    chunks = spark.createDataFrame([("a", 0, "success"), ("b", None, "failed")], "chunk_id string, vector_id long, status string")
    good = spark.createDataFrame([("a", 0)], "chunk_id string, vector_id long")
    assert quality.embedding_consistency(chunks, good).first().consistent
    assert not quality.embedding_consistency(chunks, spark.createDataFrame([("a", 1)], good.schema)).first().consistent


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"data": [{"bbbs": "k", "title": "t", "sxx": 3, "my_status": 404, "my_dir": "法律\\宪法", "my_file": "f.docx"}, {"title": "u", "my_file": None}]}), encoding="utf-8")
    got = records.read_records(spark, str(tmp_path / "r.json"), "vol1").withColumn("path", records.expected_path(F.col("my_dir"), F.col("my_file"), F.lit("root"))).orderBy("title").collect()
    assert (got[0].record_id, got[0].sxx, got[0].my_status, got[0].path) == ("k", "3", "404", "root/docx/法律/宪法/f.docx")
    assert got[1].record_id.startswith("fallback_") and got[1].path is None


def test_vector_files(spark, tmp_path):
    rows = [{"vector_id": 1, "chunk_id": "a", "vector": [1.0, 0.0]}, {"vector_id": 1, "chunk_id": "", "vector": [1.0]}]
    (tmp_path / "v.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    faults = records.vector_faults(records.read_vectors(spark, str(tmp_path / "v.jsonl")), 2).first()
    assert (faults.n, faults.repeated_ids, faults.blank_chunks, faults.bad_vectors) == (2, 1, 1, 1)


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    heading = '<w:pPr><w:pStyle w:val="Title"/></w:pPr>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('甲', heading)}<w:p/>{table}{p('乙')}</w:body></w:document>")


def test_files(spark, tmp_path):
    docx(tmp_path / "a.docx")
    (tmp_path / "b.txt").write_bytes("第一行\n第二行\n\nx\ty\n".encode("gb18030"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    found = spark.read.format("binaryFile").load(str(tmp_path))
    blocks = {}
    for r in files.parse(found).orderBy("path", "block_index").collect():
        blocks.setdefault(r.path[-5:], []).append((r.block_type, r.text, r.style, bool(r.error)))
    assert blocks["/b.txt"[-5:]] == [("paragraph", "第一行 第二行", None, False), ("table_row", "表格行：x | y", None, False)]
    assert blocks[".docx"] == [("paragraph", "甲", "Title", False), ("table_row", "表格行：列1：a | 列2：b", None, False), ("paragraph", "乙", None, False)]
    assert blocks["c.pdf"] == [(None, None, None, True)]
    assert files.scan(spark, str(tmp_path)).filter("is_word").count() == 1


def test_manifest_and_ingestion(spark, tmp_path):
    schema = "key string, text string"
    store = ingest.initialise(spark, str(tmp_path / "kb"), spark.createDataFrame([("a", "1"), ("b", "2")], schema))
    source = tmp_path / "in"
    spark.createDataFrame([("b", "2"), ("a", "1x"), ("c", "3")], schema).coalesce(1).write.parquet(str(source))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = ingest.ingest_stream(store, stream, str(tmp_path / "checkpoint"))
        query.awaitTermination()
    manifest = store.current()
    assert manifest.revision == 2 and len(manifest.deltas) == 1
    now = ingest.active(store.read(manifest, "documents"))
    assert {(r.key, r.text, r.layer) for r in now.collect()} == {("a", "1x", 1), ("b", "2", 0), ("c", "3", 1)}
    assert sorted(map(tuple, ingest.living(store, manifest).select("key", "text").collect())) == [("a", "1x"), ("b", "2"), ("c", "3")]
    old = store.read(manifest, "documents").filter("layer = 0 and key = 'a'").first()
    chunk = store.read(manifest, "chunks").filter(F.col("doc_id") == old.doc_id).filter("layer = 0").first().chunk_id
    assert sorted(tuple(r) for r in ingest.tombstones(store, manifest).collect()) == [("chunk", chunk, 1), ("doc_version", old.version_id, 1)]
    again = ingest.ingest_batch(store, spark.createDataFrame([("z", "9")], schema), manifest.deltas[0].layer_id)
    assert again == manifest
    with pytest.raises(ManifestConflict):
        store.publish(Manifest(2, manifest.base), 1)
    with pytest.raises(ValueError):
        Manifest(1, Layer("x", "../up", "0" * 64))


def test_cross_layer_repeats_of_high_ids(spark, tmp_path):
    from corvane.queries import QUERIES

    rows = [(60, "late", "en"), (61, "late", "de"), (62, "one layer", "de"), (65, "other", None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["i8_cross_layer_repeats_whole"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("source", "late", 2)]


def test_legacy_identities(spark):
    rows = [(1, "a/E\u0301t\u00e9.txt", "x"), (2, "b\\\u00c9T\u00c9.TXT", "y"), (3, "c/Stra\u00dfe.txt", "z"), (4, "STRASSE.txt", "w"), (5, "other", "v")]
    got = layers.legacy_identities(spark.createDataFrame(rows, "doc_id long, path string, digest string")).collect()
    assert {(r.key, r.n, r.doc_id, r.digest, r.collides) for r in got} == {("\u00e9t\u00e9.txt", 2, 1, "x", True), ("strasse.txt", 2, 3, "z", True), ("other", 1, 5, "v", False)}


def test_checked_inserts(spark, tmp_path):
    rows = [(1, 0, "a", 5), (None, 0, "a", 5), (1, -1, "a", 5), (1, 1, " ", 5), (1, 1, None, 5), (1, 1, "b", None), (1, 2, "c", 6)]
    refused = layers.insert_checked(spark.createDataFrame(rows, "doc_id long, block_index long, text string, vector_id long"), str(tmp_path / "d"))
    assert sorted(r.fault for r in refused.collect()) == ["block index", "no document", "no text", "no text", "vector id"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "d")).collect())) == [rows[0], rows[6]]
