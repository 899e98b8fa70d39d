import random

import numpy as np
import xxhash

from corvane.llm import common, simhash
from corvane.llm.components import connected_components
from corvane.llm.simhash import SEGMENTS, codewords, error_table, fingerprint, near_duplicates, near_links, op6_simhash

from .conftest import SF


def brute_print(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] if words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    """Smallest index reachable."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    prints = [brute_print(r.text) for r in rows]
    roots = components(prints, lambda x, y: (x ^ y).bit_count() <= 3)
    return sorted(((r.doc_id, f"{p:016x}", rows[k].doc_id) for r, p, k in zip(rows, prints, roots, strict=True)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark, odd, clashing, empty):
    assert rows(op6_simhash(spark, SF)) == brute(spark.read.parquet(f"{SF}/documents.parquet").collect())
    short = odd.filter("length(text) < 1000 or text is null")
    assert rows(near_duplicates(short).select("doc_id", "fingerprint", "component_id")) == brute(short.collect())
    assert near_duplicates(clashing).count() == odd.count()
    assert rows(near_duplicates(empty)) == []


def test_golay_code_is_perfect():
    errors = error_table()
    words = np.random.default_rng(0).integers(0, 1 << 23, 2_000)
    keys = codewords(words, 23, errors)
    assert (keys >= 0).sum(1).max() == 6
    for flip in range(23):
        own = codewords(words ^ (1 << flip), 23, errors)[:, :1]
        assert (keys == own).any(1).all()
    assert sum(n for _, n in SEGMENTS) == 64


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rng, centre = random.Random(1), 0x0123456789ABCDEF
    values = {centre}
    while len(values) < 300:
        x = rng.choice(sorted(values))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        values.add(x)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    expected = components(values, lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= 3)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for block, broadcast in ((16, 100_000), (16, 0), (4096, 0)):
        monkeypatch.setattr(simhash, "MOST_BROADCAST", broadcast)
        got = {r.node: r.root for r in connected_components(near_links(fps, block)).collect()}
        assert [got.get(v, v) for v in values] == [values[k] for k in expected]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000 + i, 1000) for i in range(1, 50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}


def test_one_giant_component_of_different_fingerprints(spark, monkeypatch):
    """A star whose centre and a chain whose root are hot keys: joins on them are split, and nothing is lost."""
    broadcasts = []
    monkeypatch.setattr(common.F, "broadcast", lambda df, f=common.F.broadcast: broadcasts.append(df) or f(df))
    links = [(0, i) for i in range(1, 3_000)] + [(i, i + 1) for i in range(10_000, 12_000)] + [(2_999, 12_000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(3_000), *range(10_000, 12_001)]}
    assert broadcasts and all(df.count() <= 1_000 for df in broadcasts)


def test_long_texts():
    for text in ("a" * 2_000_000, " " * 2_000_000, "\n" * 2_000_000, "中" * 700_000):
        assert f"{fingerprint(text) % (1 << 64):016x}" == f"{brute_print(text):016x}"


def test_rows_that_share_an_id_are_kept_apart(spark):
    rows = [(0, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "quite another text about something else"), (None, "a b c d e f g h"), (None, "without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs, docs.text).filter("kept").collect()
    assert sorted((str(r.doc_id), r.row_key) for r in got) == sorted(map(lambda r: (str(r[0]), r[1]), [rows[0], rows[2], rows[4]]))
