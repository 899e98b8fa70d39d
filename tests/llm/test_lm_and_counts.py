from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import lm_score, token_counts
from corvane.llm.common import words_of

from .conftest import SF


def brute(docs, words):
    """docs: (id, text, target). The same models by plain loops: each document is scored by counts of all the others."""
    everything = Counter(w for _, text, _ in docs for w in words_of(text))
    known = {w for w, _ in sorted(everything.items(), key=lambda x: (-x[1], x[0]))[: words - 2]}
    name = lambda w: w if w in known else "unknown"
    size = len(known)
    texts, uni, pair, after = [], [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for _, text, target in docs:
        own = [*map(name, words_of(text))]
        steps = list(zip(["begin", *own], own, strict=False))
        texts.append((own, steps))
        k = 0 if target else 1
        uni[k].update(own)
        pair[k].update(steps)
        after[k].update([*own, *(["begin"] if own else [])])
    words_in = [sum(c.values()) for c in uni]
    out = []
    for (i, _, target), (own, steps) in zip(docs, texts, strict=True):
        total = 0.0
        for k in range(2):
            mine = k == (0 if target else 1)
            scale = min(words_in) / max(1, words_in[k])
            less = lambda c, of, key: (c[key] - (list(of).count(key) if mine else 0)) * scale  # noqa: B023, E731
            n = (words_in[k] - (len(own) if mine else 0)) * scale
            for h, w in steps:
                u = (less(uni[k], own, w) + 1) / (n + size + 2)
                total += (1, -1)[k] * -np.log2((less(pair[k], steps, (h, w)) + lm_score.PRIOR * u) / (less(after[k], [*own, "begin"], h) + lm_score.PRIOR))
        out.append((i, len(own), total / len(own) if own else 0.0))
    return out


@pytest.mark.parametrize("words", [10, 40])
def test_scores_against_brute_force(spark, words, monkeypatch):
    rng = np.random.default_rng(words)
    docs = [(i, " ".join(rng.choice([f"w{k}" for k in range(30)], rng.integers(0, 40))), bool(i % 3)) for i in range(60)] + [(70, None, True), (71, "a b", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, good boolean").repartition(7)
    monkeypatch.setattr(lm_score, "TOGETHER", 2)
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, F.col("good"), words).collect()}
    for doc, n, diff in brute(docs, words):
        assert got[doc].n_words == n and abs(got[doc].ce_diff - diff) < 1e-4


def test_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    """More distinct words than any fixed table held, most of them rare; each is a word of its own in both models."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{k}" for k in (4_000 * rng.random(60) ** 2).astype(int)), bool(i % 3)) for i in range(150)]
    docs.append((150, " ".join(f"w{k}" for k in range(4_000)), False))
    monkeypatch.setattr(lm_score, "BLOCK", 500)
    df = spark.createDataFrame(docs, "doc_id long, text string, good boolean").repartition(3)
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, F.col("good")).collect()}
    assert len(got) == len(docs)
    for doc, n, diff in brute(docs, 10**6):
        assert got[doc].n_words == n and abs(got[doc].ce_diff - diff) < 1e-4


def test_rows_sent_grow_with_ngrams_not_with_parts(spark):
    """Blocks send rows only to parts of which they have n-grams, and each row is read by both readers from one exchange."""
    docs = spark.createDataFrame([(i, "a b c", bool(i % 2)) for i in range(640)], "doc_id long, text string, target boolean")
    for blocks in (8, 64):
        dealt = docs.repartition(blocks, "doc_id")
        for parts in (512, 4_096):
            assert lm_score.sent(dealt, parts, None).count() <= blocks * (7 + 1)  # begin, 3 words, 3 pairs; documents
    scores = lm_score.cross_entropy_difference(docs.withColumnRenamed("target", "good"), F.col("good"))
    assert len({round(r.ce_diff, 9) for r in scores.collect()}) == 2
    assert "ReusedExchange" in scores._jdf.queryExecution().executedPlan().toString()


def test_labelled_junk_scores_higher(spark):
    """The rule that chooses the target reads neither labels nor languages; scores rank what is labelled as of low quality."""
    big = SF.replace("sf0.001", "sf0.01")
    rows = lm_score.op10_lm_score(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").select("ce_diff", "quality").collect()
    good, bad = ([r.ce_diff for r in rows if r.quality == y] for y in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.65


def test_copies_score_apart(spark):
    """A document whose counts are only its own has no advantage; one that occurs twice has."""
    rng = np.random.default_rng(6)
    make = lambda: " ".join(rng.choice([f"w{k}" for k in range(400)], 60))
    texts = [make() for _ in range(120)] + [make()] * 2
    docs = spark.createDataFrame([(i, t, i % 2 == 0 or i >= 120) for i, t in enumerate(texts)], "doc_id long, text string, good boolean")
    got = {r.doc_id: r.ce_diff for r in lm_score.cross_entropy_difference(docs, F.col("good")).collect()}
    assert max(got[120], got[121]) < min(got[i] for i in range(120)) - 1


def test_running_text(spark):
    texts = ["Plain words in a row, and more.", "Größe und Maß.", "SHOUTED WORDS HERE", "a | b | c | d", "", None, "### $$$"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r[0] for r in df.orderBy("i").select(lm_score.is_running_text(F.col("text"))).collect()] == [True, True, False, False, False, None, False]


def test_long_texts(spark):
    texts = ["a" * 2_000_000, " " * 2_000_000, "\n" * 2_000_000, "中" * 700_000, "a b " * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_words for r in lm_score.cross_entropy_difference(docs, F.col("doc_id") < 2).collect()} == {0: 1, 1: 0, 2: 0, 3: 1, 4: 1_000_000}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    short = [t[:3_000] for t in texts] + [" " * 5_000 + "x", "y" + "\n" * 6_000, "\u3000 " * 4_000 + "z"]
    got = {r.doc_id: r.n for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(short)}
    sizes = {r.doc_id: r.n for r in token_counts.count_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert all(sizes[i] > 0 for i in range(5))


def test_odd_rows(odd, clashing, empty):
    for docs in (odd, clashing):
        rows = lm_score.cross_entropy_difference(docs, F.col("lang") == "en").collect()
        assert len(rows) == odd.count() and all(r.ce_diff == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert lm_score.cross_entropy_difference(empty, F.lit(True)).collect() == []
    assert all(r.ce_diff is not None for r in lm_score.cross_entropy_difference(odd, F.lit(True)).collect())


def brute_counts(library, text, rule):
    """Sections are lines; tokens by the library's own offsets in code points, which is exact for texts of one-byte characters."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    spans = list(zip([0, *ends[:-1]], ends, strict=True))
    out = [0] * len(spans)
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        shared = [min(e, b) - max(s, a) for s, e in spans]
        out[max(range(len(spans)), key=lambda k: shared[k]) if rule == "most" else next(k for k, (s, e) in enumerate(spans) if s <= a < e)] += 1
    return [(k, s, e, n) for k, ((s, e), n) in enumerate(zip(spans, out, strict=True))]


def test_counts_against_library_offsets(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "one line", "a\nb\n", "a\n\n\nb  \n  c", "\n\n", " \n x\n", "it's\n\n  'tis 123\n" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rule in token_counts.RULES:
        got = token_counts.count_tokens(df, rule=rule).orderBy("doc_id", "section").collect()
        for i, text in enumerate(texts):
            assert [(r.section, r.begin, r.end, r.n_tokens) for r in got if r.doc_id == i] == brute_counts(library, text, rule)
    assert any(r.n_crossing for r in token_counts.count_tokens(df).collect())
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, rule="half")


def test_sections_add_up(spark, odd, clashing, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, by in ((docs, token_counts.op1_token_counts(spark, SF)), (odd, token_counts.count_tokens(odd)), (odd, token_counts.count_tokens(clashing))):
        total = {r.doc_id: r.n for r in by.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
        want = Counter()
        for r in df.collect():
            want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert total == {d: want[d] for d in total} and set(total) == {r.doc_id for r in df.collect()}
    assert token_counts.count_tokens(empty).collect() == []
