import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corvane.llm.packing import cutting_stock, op2_packing, pack, sequences
from corvane.llm.word_bpe import WordBpe

from .conftest import ODD, SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


@given(st.text(st.sampled_from("abcé'sÉİßΣΣ1²½ \n\t  \x85\x1ć中-<|>_#"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_library_s(bpe, library, text):
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(library, docs, rows):
    """Each document's ids lie in its pieces once; sequences have no gaps and fit. Returns the share of padding."""
    pieces, sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequence[r.sequence_id].append((r.offset, r.length))
    for doc, texts in docs.items():
        expected = sorted((s, min(2048, len(i) - s), zlib.crc32(i[s : s + 2048].tobytes()), len(i)) for i in map(lambda t: ids_of(library, t), texts) for s in range(0, len(i), 2048))
        assert sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[doc]) == expected
    used = padding = 0
    for parts in sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        used, padding = used + at, padding + (0 if at & (at - 1) == 0 else 2048 - at)
    return padding / max(1, used + padding)


def test_whole_documents_with_little_padding(spark, library):
    docs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        docs[r.doc_id].append(r.text)
    assert check(library, docs, op2_packing(spark, SF).collect()) < 0.02


def test_odd_rows(odd, empty, clashing, library):
    docs = defaultdict(list)
    for r in ODD:
        docs[r[0]].append(r[1])
    check(library, docs, pack(odd).collect())
    check(library, docs, pack(clashing).collect())
    assert pack(empty).collect() == []


def test_sequences_hold_the_ids(spark, odd, library):
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = sequences(unique, pack(unique)).collect()
    assert sum(len(r.input_ids) for r in got) == sum(len(ids_of(library, r.text)) for r in unique.collect())
    assert max(len(r.input_ids) for r in got) <= 2048


@given(st.lists(st.integers(0, 30), min_size=16, max_size=16))
@settings(max_examples=60, deadline=None)
def test_patterns_meet_the_demand(counts):
    demand = np.array([0, *counts])
    plan = cutting_stock(demand)
    assert (sum((p * n for p, n in plan), np.zeros_like(demand)) == demand).all()
    assert all((p * np.arange(17)).sum() <= 16 for p, _ in plan)
    bound = -(-int((demand * np.arange(17)).sum()) // 16)
    assert sum(n for _, n in plan) <= max(bound * 1.35 + 3, (demand[9:]).sum() + bound)


def test_equal_rows_without_an_id_go_to_all_buckets(spark, monkeypatch):
    from corvane.llm import packing

    monkeypatch.setattr(packing, "RANKED_TOGETHER", 100)
    pieces = spark.range(0, 20_000, 1, 4).selectExpr("cast(null as long) doc_id", "0L start", "1L length", "5L ids_crc32", "1L class")
    sizes = []
    monkeypatch.setattr(packing.F, "row_number", lambda real=packing.F.row_number: sizes.append(1) or real())
    got = packing.ranked(packing.checkpointed(pieces), 20_000)
    assert sizes and sorted(r.rank for r in got.collect()) == list(range(20_000))
    buckets = packing.checkpointed(pieces).withColumn("b", packing.F.pmod(packing.F.xxhash64(packing.F.monotonically_increasing_id()), packing.F.lit(200))).groupBy("b").count()
    assert buckets.count() == 200 and buckets.agg({"count": "max"}).first()[0] < 200
