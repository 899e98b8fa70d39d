import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from corvane.llm import mixture as M

from .conftest import DOCUMENTS, SF


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes):
    """Targets by source: shares given out and reshared in rounds, as fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ones, rest = {}, set(order), Fraction(3, 2) * sum(sizes.values())
    while open_ones:
        level = rest / sum(weight[s] for s in open_ones)
        above = {s for s in open_ones if level * weight[s] >= 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_ones}
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            rest -= target[s]
        open_ones -= above
    return target


def brute(rows):
    """rows: doc_id, text, source."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size_of(text)
    target = shares({s: sizes[s] for s in {r[2] for r in rows}})
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by_source = defaultdict(list)
    for doc_id, text, source in rows:
        by_source[source].append((md5(f"mix:{'' if doc_id is None else doc_id}:{md5(text or '')}"), -1 if doc_id is None else doc_id, size_of(text), doc_id))
    out = []
    for source, own in by_source.items():
        budget, total = int(target[source]), sizes[source]
        left = budget - (budget // total if total else 0) * total
        for _, _, size, doc_id in sorted(own, key=lambda r: r[:3]):
            more = min(left, size)
            left -= more
            out.append((doc_id, size, total, float(target[source]), (budget // total if total else 0) * size + more))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, b):
    assert [(*x[:3], x[4]) for x in a] == [(*x[:3], x[4]) for x in b]
    assert all(x[3] == pytest.approx(y[3], rel=1e-12) for x, y in zip(a, b, strict=True))


def test_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    close(rows_of(M.mix(docs)), want)
    monkeypatch.setattr(M, "RANGE_ROWS", 4)
    monkeypatch.setattr(M, "FEW_SOURCES", 0)
    close(rows_of(M.mix(docs.repartition(9))), want)
    taken = Counter()
    for _, _, total, target, n in want:
        taken[total, target] += n
    assert all(abs(n - t) < 1 for (_, t), n in taken.items())


def test_targets_against_rounds(spark):
    """Very uneven sources, of which many are stopped one after the other, and sources without words."""
    for sizes in ([1, 2, 4, 8, 16, 1000], [0, 0, 5], [0], [3**i for i in range(12)], [7] * 9, [10**12, 1, 1, 10**12, 5, 10**6]):
        of = {f"={i:02}": n for i, n in enumerate(sizes)}
        found = {r.of: r for r in M.targets(spark.createDataFrame(list(of.items()), "of string, source_size long")).collect()}
        want = shares(of)
        assert found.keys() == want.keys()
        for s, t in want.items():
            assert found[s].target == pytest.approx(float(t), rel=1e-12) and found[s].budget == int(t)


def test_copies_are_dealt_whole(spark, monkeypatch):
    """Thousands of equal rows, some of them without an id, are answered row by row, in chunks too."""
    rows = [(None, "", "a")] * 500 + [(None, "three words here", "a")] * 700 + [(4, "five words are in here", "b")] * 300 + [(i, "w " * (i % 7), "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute(rows)
    close(rows_of(M.mix(docs)), want)
    monkeypatch.setattr(M, "COPIES", 64)
    close(rows_of(M.mix(docs)), want)


def test_odd_rows(spark, odd, clashing, empty):
    assert rows_of(M.mix(empty)) == []
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    for docs in (odd, clashing):
        close(rows_of(M.mix(docs)), brute(rows))
    rows = [(1, "a b", None), (2, "c d e", ""), (3, "f", "z"), (4, None, "z"), (5, "é　ü x", "ä"), (6, "word " * 400_000, "z")]
    docs = spark.createDataFrame([(a, b, "en", c, 0) for a, b, c in rows], DOCUMENTS)
    wide = docs.selectExpr("*", *[f"'junk' AS `{c}`" for c in ("of", "key", "size", "range", "target", "budget", "taken", "off", "inside", "n", "epochs", "more", "part", "place", "unit")])
    close(rows_of(M.mix(wide)), brute(rows))


def test_the_mix_has_what_is_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000")
    taken = {(r.doc_id): r.taken for r in M.mix(docs).collect()}
    made = Counter()
    for r in M.mixed(docs).collect():
        made[r.doc_id] += r.times * size_of(r.text) + size_of(r.rest)
        assert r.rest.split() == r.text.split()[: len(r.rest.split())]
    assert made == Counter({k: v for k, v in taken.items() if v})


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = M.op13_mixture(spark, SF)
    assert rows_of(found) == sorted(con.sql(f"select {', '.join(found.columns)} from ({M.OP13_SQL})").fetchall(), key=repr)
    assert rows_of(M.mix(spark.read.parquet(f"{SF}/documents.parquet"), "another seed")) != rows_of(found)
