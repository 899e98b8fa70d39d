import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from corvane.llm import divergence as D

from .conftest import DOCUMENTS, SF


def brute(rows):
    """rows: lang, source, text."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= 3]
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if df[t] >= 3)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        share, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(-f(share[s][t], q[t]), t) for t in kept if counts[s][t] and share[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[: 200 if part == "term" else None], 1):
                    out.append((lang, s, part, item, -value, rank))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    """Also with tries handed on after some terms, sums of pairs handed on early, tables of groups that are not broadcast."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000")
    if small:
        monkeypatch.setattr(D, "FEW_GROUPS", 0)
        monkeypatch.setattr(D, "RANGE_LEAVES", 900)
        monkeypatch.setattr(D, "ROWS", 50)
        monkeypatch.setattr(D, "PAIRS_AT_ONCE", 200)
        monkeypatch.setattr(D, "HELD_PAIRS", 30)
        monkeypatch.setattr(D, "HELD_LEAVES", 2000)
        monkeypatch.setattr(D, "PART_LEAVES", 70)
        monkeypatch.setattr(D, "DRAWN_DOCUMENTS", 40)
        docs = docs.repartition(7)
    assert rows_of(D.divergence(docs)) == brute([(r.lang, r.source, r.text) for r in docs.collect()])


def test_tries_handed_on_early(spark, monkeypatch):
    """Each language's leaves come in the order of bytes; tries handed on after some leaves hold the same counts together."""
    rows = [(la, f"s{i % 5}", f"a b{i % 3} ab abc ç{i % 2} {'long' * i} Zeta zeta a" if i % 4 else None) for i, la in enumerate("xxyyyyyyxxyxyxyxyxxxyyx")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    batches = lambda: iter(docs.toArrow().to_batches(max_chunksize=2))
    whole = [r for b in D.count_terms(batches()) for r in b.to_pylist()]
    assert [(r["lang"], r["term"]) for r in whole] == sorted((r["lang"], r["term"]) for r in whole)
    want = Counter()
    for lang, source, text in rows:
        for term, n in Counter(re.findall(r"[a-zç]+", (text or "").lower())).items():
            want[lang, term.encode(), source, "count"] += n
            want[lang, term.encode(), source, "documents"] += 1
    monkeypatch.setattr(D, "HELD_LEAVES", 3)
    parts = [r for b in D.count_terms(batches()) for r in b.to_pylist()]
    assert len(parts) > len(whole)
    for found in (whole, parts):
        got = Counter()
        for r in found:
            for c in ("count", "documents"):
                got[r["lang"], r["term"], r["source"], c] += r[c]
        assert got == want


def test_sums_are_compressed(monkeypatch):
    monkeypatch.setattr(D, "HELD_PAIRS", 4)
    sums, want = D.Sums(), Counter()
    for i in range(40):
        sums.add(np.array([i % 3, i % 7]), np.array([i, 2 * i]))
        want[i % 3] += i
        want[i % 7] += 2 * i
    keys, values = sums.compress()
    assert dict(zip(keys.tolist(), values.tolist(), strict=True)) == dict(want)


@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("st"), st.lists(st.text(st.sampled_from("abAZé中 \n1"), max_size=60), max_size=3)), max_size=6), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_tries_against_counters(rows, parts):
    """Terms that begin others, of one to many digits, with tails; tries merged in parts."""
    texts = [" ".join(t) for _, _, t in rows]
    tries = [D.trie_of_texts([r[0] for r in rows[i::parts]], [r[1] for r in rows[i::parts]], pa.array(texts[i::parts], pa.string())) for i in range(parts) if rows[i::parts]]
    want = Counter()
    for (lang, source, _), text in zip(rows, texts, strict=True):
        for term in re.findall(r"[a-zé中]+", text.lower()):
            want[lang, term.encode(), source] += 1
    found = [r for c in D.Trie.merged(tries).walk() for r in D.as_rows(c, D.LEAVES).to_pylist()]
    assert [((r["lang"], r["term"], r["source"]), r["count"]) for r in found] == sorted(want.items())


def test_tries_nest_deeply():
    """Terms that all begin another one, far beyond the digits of a trie."""
    text = " ".join("a" * n for n in range(1, 3000))
    trie = D.Trie.merged([D.trie_of_texts(["x"], [s], pa.array([text])) for s in "yz"])
    found = [r for c in trie.walk() for r in D.as_rows(c, D.LEAVES).to_pylist()]
    assert [(r["term"], r["source"]) for r in found] == sorted((b"a" * n, s) for n in range(1, 3000) for s in "yz")


def test_odd_rows(spark, odd, clashing, empty):
    assert rows_of(D.divergence(empty)) == []
    for docs in (odd, clashing):
        assert rows_of(D.divergence(docs)) == brute([(r.lang, r.source, r.text) for r in odd.collect()])
    words = " ".join(f"w{c}" for c in "abcdefghijkl")
    rows = [(i, words + " ü　x" * (i % 4), "x" if i % 2 else None, "s" if i % 3 else None, 0) for i in range(24)] + [(50, "x y z " * 300_000 + words, "x", "t", 0), (51, None, "x", "none", 0), (52, "once", "alone", "s", 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert rows_of(D.divergence(docs)) == brute([(r[2], r[3], r[1]) for r in rows])
    wide = docs.selectExpr("*", *[f"'junk' AS `{c}`" for c in ("p", "p0", "q", "n", "h", "own", "terms", "other", "rank", "value", "part", "item", "term", "counts", "documents", "sources")])
    assert rows_of(D.divergence(wide)) == rows_of(D.divergence(docs))


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert rows_of(D.op12_divergence(spark, SF)) == sorted(con.sql(f"select lang, source, part, item, value, rank from ({D.OP12_SQL})").fetchall())
