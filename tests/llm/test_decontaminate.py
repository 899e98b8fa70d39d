import gc
import hashlib
import random
import weakref

import numpy as np

from corvane.llm import decontaminate as D
from corvane.llm.common import words_of

from .conftest import SF

ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Short item here"), (2, "other text under the same id"), (3, None), (4, " ,. "), (None, "no id at all"), (10, "rest of w0 w1")]


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            own = words_of(t)
            n = min(window, len(own))
            for at in range(len(own) - n + 1 if n else 0):
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == own[at : at + n]:
                        hit |= set(range(i, i + n))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in df.collect()), key=str)


def test_small_alphabet_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randint(1, 9))) for i in range(6)]
    docs = [(i, text(rng.randint(0, 40))) for i in range(40)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert rows(got) == brute(docs, items, 5)
    blocks = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5, block_words=2)
    assert rows(blocks) == brute(docs, items, 5)


def test_odd_rows(spark, odd, clashing, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    planted = [(90, "x, W0-w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12; y"), (91, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (92, "a SHORT item, here")]
    docs = [(r.doc_id, r.text) for r in odd.collect()] + planted
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert rows(got) == brute(docs, ITEMS)
    assert rows(D.contamination(clashing, items)) == brute([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    assert D.contamination(empty, items).collect() == []
    assert all(r.n_hit == 0 for r in D.contamination(odd, items.limit(0)).collect())
    blocks = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items, block_words=6)
    assert rows(blocks) == brute(docs, ITEMS)
    assert rows(D.contamination(clashing, items, block_words=6)) == brute([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    assert D.contamination(empty, items, block_words=6).collect() == []


def test_one_block_of_windows_at_a_time(spark, monkeypatch):
    """Neither the driver nor a task holds a second block: when one is made, the one before is gone, and no plan has it."""
    alive, most = weakref.WeakSet(), []

    class Watched(D.Windows):
        def __init__(self, *how):
            super().__init__(*how)
            alive.add(self)
            gc.collect()
            most.append(len(alive))

    monkeypatch.setattr(D, "Windows", Watched)
    items = [(i, f"item number {i} of these") for i in range(12)]
    docs = spark.createDataFrame([(i, f"here is item number {i % 15} of these, twice: item number {i % 7} of these") for i in range(60)], "doc_id long, text string")
    got = D.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), window=5, block_words=8)
    assert len(most) > 3 and max(most) <= 2 and "MapInArrow" not in got._jdf.queryExecution().toString()
    assert rows(got) == brute([(r.doc_id, r.text) for r in docs.collect()], items, 5)


def test_long_texts(spark):
    texts = ["a" * 2_000_000, " " * 2_000_000, "\n" * 2_000_000, "中" * 700_000, "a b " * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = D.contamination(docs, spark.createDataFrame([(1, "a b a b a b a b a b a b a b a b"), (2, "中")], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit) for r in got} == {0: (1, 0), 1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (1_000_000, 1_000_000)}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id % 4 == 0]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in D.op7_decontamination(spark, SF).collect() if r.doc_id % 4 == 0]
    windows = {tuple(words_of(t)[i : i + min(13, len(words_of(t)))]): [] for _, t in items for i in range(max(1, len(words_of(t)) - 12))}
    for item, t in items:
        for i in range(max(1, len(words_of(t)) - 12)):
            windows[tuple(words_of(t)[i : i + min(13, len(words_of(t)))])].append(str(item))
    want = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= set(own)
        want.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    assert sorted(got) == sorted(want) and any(w[2] for w in want)


def test_index_counts_and_places():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 4, 400)
    index = D.FmIndex(text, 4)
    for n in (1, 2, 5):
        words = np.stack([text[i : i + n] for i in range(50)])
        low, high = index.search(words, np.full(50, n))
        for w, a, b in zip(words, low, high, strict=True):
            places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == w).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_removal():
    assert D.strip_spans("a, b c. d", [1, 3]) == "a, . d"
    assert D.strip_spans(None, [0, 1]) is None and D.union_spans([[0, 2, 5, 6], [2, 4]]) == [0, 4, 5, 6]


def test_a_shard_is_read_document_by_document():
    windows = D.Windows([("a", "one two three")], 2)
    texts = [b"x one two".split(), [], b"three one two three".split()]
    assert [(s.tolist(), items) for s, items in D.search_shard(iter(texts), windows)] == [([1, 3], ["a"]), ([], []), ([1, 4], ["a"])]
