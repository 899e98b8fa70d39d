import os

import corpus_pipeline as P
from corvane.llm.common import shared_folder, words_of

from .conftest import SF
from .test_decontaminate import brute as brute_hits
from .test_exact_dedup import INSIDE, brute as brute_copies
from .test_packing import check
from .test_packing import library  # noqa: F401
from .test_simhash import brute as brute_near


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, library):  # noqa: F811
    """Each stage is judged on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = P.drop_toxic(spark, docs, SF).cache()
    toxic = {r.doc_id for r in P.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids(kept) == sorted(set(ids(docs)) - toxic) and kept.columns == docs.columns
    unique = P.drop_copies(spark, kept, SF).cache()
    assert ids(unique) == sorted(x[0] for x in brute_copies(kept.collect()) if x[3]) and unique.columns == docs.columns
    apart = P.drop_near_copies(spark, unique, SF).cache()
    assert ids(apart) == sorted(x[0] for x in brute_near(unique.collect()) if x[0] == x[2]) and apart.columns == docs.columns
    some = apart.filter("doc_id % 5 = 0").cache()
    clean = P.drop_contaminated(spark, some, SF)
    assert ids(clean) == sorted(x[0] for x in brute_hits([(r.doc_id, r.text) for r in some.collect()], items) if not x[5]) and clean.columns == docs.columns
    texts = {}
    for r in some.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert check(library, texts, P.pack_rest(spark, some, SF).collect()) < 0.15


def test_run_and_odd_rows(spark, odd, clashing, empty):
    shared = shared_folder(spark).removeprefix("file:")
    assert [name for name, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]
    for docs in (odd, clashing, empty):
        rest = docs
        for _, stage in P.STAGES[:-1]:
            rest = stage(spark, rest, SF)
            assert rest.columns == docs.columns
        rest = rest.cache()
        assert P.pack_rest(spark, rest, SF).select("doc_id").distinct().count() == rest.select("doc_id").distinct().count()
        if docs is not empty:
            left = [r.doc_id for r in rest.collect()]
            assert left.count(5) + left.count(4) <= 1 and None in left and len([i for i in left if i in (1, 2, 3)]) == 1
    assert P.run(spark, SF).count() > 0
    assert not [f for f in os.listdir(shared) if os.path.exists(f"{shared}/{f}/_SUCCESS")]  # no table between stages is left


def test_rows_that_share_an_id_or_have_none(spark):
    """Ids that repeat with other texts, or are missing, cost no document and hide none."""
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words_of(r.text)) >= 13)
    words = ["zq" + c * 3 for c in "abcdefghijklmnop"]
    far = [" ".join(words[i:] + words[:i] + [w]) for i, w in enumerate(words)]
    rows = [(0, "same text here"), (1, "same text here"), (1, "a quite different text"), (1, item), (None, item), (None, far[3]), (None, far[3]), (2, far[7]), (2, far[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, [rows[0], rows[2], rows[5], rows[7], rows[8]]))


def test_toxic_rows_without_an_id_go(spark):
    big = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").filter("length(text) < 4000")
    toxic = {r.doc_id for r in P.score_toxicity(docs, labels).filter("predicted = 1").collect()}
    nameless = [(None, r.text) for r in docs.collect() if r.doc_id in toxic]
    kept = P.drop_toxic(spark, docs.union(spark.createDataFrame(nameless, docs.schema)), big)
    assert nameless and kept.filter("doc_id is null").count() == 0 and kept.count() == docs.count() - len(nameless)


def test_names_kinds_and_long_texts(spark):
    """Further columns by every name that the stages use inside, maps among them, on rows that repeat; texts of 2 MB."""
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words_of(r.text)) >= 13)
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(250_000))
    rows = [(0, "same text here"), (1, "same text  here"), (1, "same text  here"), (None, "some other words"), (None, "some other words"), (2, long), (3, long + " end"), (4, item), (5, " " * 2_000_000), (6, "a" * 2_000_000), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'junk' AS `{c}`" for c in INSIDE], "map('k', doc_id) m", "array(doc_id) a", "struct(map('k', 1) as mm) s")
    rest = docs
    for _, stage in P.STAGES[:-1]:
        rest = stage(spark, rest, SF).cache()
        assert rest.dtypes == docs.dtypes
    left = [r.doc_id for r in rest.collect()]
    assert sorted(left, key=str) == sorted([1, None, 2, 5, 6], key=str)
    assert P.pack_rest(spark, rest, SF).select("doc_id").distinct().count() == 5
