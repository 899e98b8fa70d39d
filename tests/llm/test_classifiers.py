import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvane.llm import labels as L
from corvane.llm import language, quality, toxicity

from .conftest import SF


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def tables(spark):
    big = SF.replace("sf0.001", "sf0.01")
    return big, spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")


@pytest.mark.parametrize(("op", "column", "least"), [(toxicity.op8_toxicity, "toxic", 0.85), (quality.op9_quality, "quality", 0.9)])
def test_held_out_rows_are_ranked_well(spark, tables, op, column, least):
    sf, docs, labels = tables
    rows = op(spark, sf).collect()
    truth = {r.doc_id: r[column] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= (0.5 if column == "toxic" else 0.3)) for r in rows)
    assert auc([(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]) > least


@pytest.mark.parametrize(("score", "column"), [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_odd_rows(spark, odd, clashing, empty, score, column):
    schema = f"doc_id long, {column} int"
    few = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (6, 0), (7, 1), (8, 0), (9, None), (None, 1), (999, 1)], schema)
    none, same = spark.createDataFrame([], schema), spark.createDataFrame([(4, 1), (6, 1), (7, 1)], schema)
    for labelled in (few, none, same):
        for docs in (odd, clashing):
            rows = score(docs, labelled).collect()
            assert len(rows) == odd.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert score(empty, few).collect() == []


def test_held_out_labels_are_not_learnt(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100)], "doc_id long, toxic int, quality int")
    held = {r.doc_id for r in labels.filter(L.held_out()).collect()}
    used = {r.doc_id for r in L.training_labels(labels, "toxic", 1000).collect()}
    assert held and not held & used and used | held == set(range(100))
    assert L.training_labels(labels, "toxic", 7).count() == 7


def test_features_notice_disguise_and_nearness():
    lexicon, insults = {b"idiot": 5.0}, frozenset([b"idiot"])
    at = dict(zip(toxicity.FEATURES, toxicity.measure("You IDIOT!! an id10t wrote it", lexicon, insults), strict=True))
    assert at["near_density"] > 0 and at["shouted"] > 0 and at["repeated"] > 0 and at["lexicon_kinds"] == 1 and at["lexicon_most"] == 5 and at["disguised_density"] > 0
    assert toxicity.measure(None, lexicon, insults)[:8] == [0.0] * 8


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(200):
        y.append(1.0 if i % 2 else -1.0)
        rows.append(np.unique(np.concatenate([rng.integers(100, 200, 8), rng.integers(0, 10, 3) + (20 if i % 2 else 0)])))
    model = quality.NbSvm(rows, np.array(y))
    assert np.mean([(model.score(r) > 0.5) == (t > 0) for r, t in zip(rows, y, strict=True)]) > 0.97


def test_languages(spark, tables):
    sf, docs, _ = tables
    rows = language.op4_language(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(rows) == docs.count() and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def longest_phrases(text, reference):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in reference:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_against_brute_force():
    rng = np.random.default_rng(7)
    make = lambda n, letters: "".join(rng.choice(list(letters), n))
    texts = {"x": make(300, "abcß "), "y": make(200, "abd中 ")}
    parser = language.Parser(texts)
    samples = [make(n, "abcdß中 ") for n in (1, 5, 80, 600)]
    counts, size = parser.phrases(samples)
    for row, sample in enumerate(samples):
        raw = language.letters_alone(sample)
        assert size[row] == len(raw)
        for k, name in enumerate(parser.languages):
            pieces = [raw[i : i + language.PIECE] for i in range(0, len(raw), language.PIECE)]
            assert counts[row, k] == sum(longest_phrases(p, language.letters_alone(texts[name])) for p in pieces)


def test_identification_against_brute_force(spark):
    """Learnt texts are few enough to be learnt whole; every row is predicted by plain loops."""
    rng = np.random.default_rng(8)
    letters = {"aa": "abcde ", "bb": "bcdfg ", "cc": "éèça "}
    rows = [(i, "".join(rng.choice(list(letters[lang]), 150 + i)), lang) for i, lang in ((i, ("aa", "bb", "cc")[i % 3]) for i in range(45))] + [(99, "123 --", "aa"), (100, None, "bb"), (101, "xyz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    learnt = language.labelled_texts(docs)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {k: sorted(t.split("\n")) for k, t in learnt.items()} == {k: sorted(t for i, t, lang in rows if lang == k and t and i not in held) for k in letters}
    for i, text, _ in rows:
        if text is None or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        raw = language.letters_alone(text)
        bits = {k: longest_phrases(raw, language.letters_alone(t)) * np.log2(len(language.letters_alone(t))) / len(raw) for k, t in learnt.items()}
        first, second = sorted(bits, key=lambda k: (bits[k], k))[:2]
        assert got[i].lang_pred == first and math.isclose(got[i].score, bits[second] / (bits[first] + bits[second])) and got[i].held_out == (i in held)


def test_many_languages_and_rare_scripts(spark):
    """70 languages of one alphabet, and two scripts of few rows."""
    rng = np.random.default_rng(9)
    words = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(70)}
    words |= {"geo": ["".join(chr(0x10D0 + c) for c in rng.integers(0, 33, 5)) for _ in range(12)], "arm": ["".join(chr(0x561 + c) for c in rng.integers(0, 38, 5)) for _ in range(12)]}
    names = sorted(words)
    rows = [(i, " ".join(rng.choice(words[k], 30)), k) for i, k in enumerate(k for k in names for _ in range(9 if k[1:].isdigit() else 5))]
    rows += [(10_000 + i, " ".join(rng.choice(words[k], 15)), None) for i, k in enumerate(names)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[10_000 + i] for i in range(len(names))] == names


def test_segments_come_from_anywhere_and_copies_count_once(spark):
    head, tail = "kopf " * 400, "ende " * 400
    rows = [(i, head + tail, "de") for i in range(500)] + [(1_000 + i, f"other {i}", "en") for i in range(40)]
    learnt = language.labelled_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(learnt["de"]) == 4 * language.SEGMENT + 3 and "ende" in learnt["de"]


def test_odd_languages(spark, odd, clashing, empty):
    for docs in (odd, clashing):
        rows = language.identify(docs).collect()
        assert len(rows) == odd.count()
        assert all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3))
        assert all(r.lang_pred in ("en", "de", "und") for r in rows)
    assert language.identify(empty).collect() == []
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    assert math.isclose(language.Parser({"a": "abc"}).predict(["abc"])[1][0], 1.0)


@given(st.text(st.sampled_from("ab@$!*05 é."), max_size=24))
@settings(max_examples=500, deadline=None)
def test_disguised_words_are_those_of_the_pattern(text):
    low = text.encode()
    assert toxicity.disguised_words(low) == re.findall(rb"[a-z@$][a-z]*[0-9@$!*][a-z0-9@$!*]*[a-z]", low)


@pytest.mark.parametrize("text", ["a" * 2_000_000, "a1" * 1_000_000, " " * 2_000_000, "A" * 2_000_000, "中" * 700_000, "!?" * 1_000_000])
def test_long_texts_take_no_longer(text):
    toxicity.measure(text, {b"idiot": 1.0}, frozenset())  # hours if matching were quadratic
    quality.ngrams(text)
    language.Parser({"a": "abc", "b": "xyz"}).predict([text])


def plain_features(text, lexicon, insults):
    words = [w.encode() for w in re.split("[\x00-/:-`{-\x7f]+", text.lower()) if w]
    places = [i for i, w in enumerate(words) if w in lexicon]
    n, size = len(words) + 1, len(text.encode()) + 1
    near = sum(any(abs(i - j) <= toxicity.NEAR and words[j] in toxicity.SECOND_PERSON for j in range(len(words))) for i in places)
    signs = sum(ord(c) < 128 and c > " " and not c.isalnum() for c in text)
    return {
        "lexicon_most": max([lexicon[words[i]] for i in places], default=0), "lexicon_sum": sum(lexicon[w] for w in {words[i] for i in places}), "lexicon_density": 100 * len(places) / n,
        "lexicon_count": math.log(1 + len(places)), "lexicon_kinds": len({words[i] for i in places}), "insult_density": 100 * sum(words[i] in insults for i in places) / n, "near_density": 100 * near / n,
        "capitals": sum("A" <= c <= "Z" for c in text) / size, "punctuation": signs / size, "length": math.log(n),
    }


@given(st.lists(st.sampled_from(["you", "Idiot", "idiot!", "fool", "x", "du", "È", ".", "word", "a-b", "\x7f"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_features_against_brute_force(parts):
    lexicon, insults = {b"idiot": 5.0, b"fool": 2.5}, frozenset([b"idiot"])
    got = dict(zip(toxicity.FEATURES, toxicity.measure(" ".join(parts), lexicon, insults), strict=True))
    for name, value in plain_features(" ".join(parts), lexicon, insults).items():
        assert math.isclose(got[name], value, abs_tol=1e-9), name


def test_lexicon_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 4 == 0), " ".join([*rng.choice(["red", "blue", "Green"], 6), *(["Scum", "vile"] if i % 4 == 0 and i % 8 else []), "rare" if i == 4 else ""])) for i in range(200)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    toxic, total = Counter(), Counter()
    for _, y, text in rows:
        for w in set(text.lower().split()):
            total[w] += 1
            toxic[w] += y
    bad, share, want = sum(r[1] for r in rows), sum(r[1] for r in rows) / len(rows), {}
    for w, n in total.items():
        k = toxic[w]
        part = lambda x, expected: x * math.log(x / expected) if x else 0.0
        if k > n * share and 2 * (part(k, n * share) + part(n - k, n * (1 - share))) >= toxicity.SURPRISE:
            want[w] = math.log((k + 0.5) / (bad + 1)) - math.log((n - k + 0.5) / (len(rows) - bad + 1))
    assert set(got) == set(want) == {"scum", "vile"} and all(math.isclose(got[w], want[w]) for w in want)


def test_toxicity_is_the_same_each_time(spark, tables):
    """Repeated ids, another order of rows and other labels of held-out rows change no score."""
    _, docs, labels = tables
    docs, labels = docs.filter("length(text) < 3000"), labels.select("doc_id", "toxic")
    docs = docs.union(docs.filter("doc_id % 9 = 0").withColumn("text", F.concat(F.lit("zz "), "text")))
    flipped = labels.withColumn("toxic", F.when(L.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({(r.doc_id, round(r.score, 9)) for r in toxicity.score_toxicity(d, y).collect()} for d, y in ((docs, labels), (docs.repartition(13), flipped.repartition(3))))
    assert first == second


def test_carried_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (8, 0)], "doc_id long, toxic int")
    for labelled in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(odd, labelled, carried=F.struct("*")).select("carried.*")
        assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))


def plain_grams(text):
    tokens = re.findall(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]", (text or "").encode().lower())
    one = [zlib.crc32(t) for t in tokens]
    two = [((a * 0x9E3779B1 + b) % 2**64 * 0x85EBCA6B % 2**64) >> 11 for a, b in zip(one, one[1:], strict=False)]
    return sorted({x % quality.HASHES for x in [*one, *two]})


def test_quality_against_brute_force(spark):
    """The query's scores are those of a model made by plain loops over the labelled rows outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in text}
    rows = [np.array(plain_grams(text[d]), dtype=np.int64) for d in sorted(label)]
    model = quality.NbSvm(rows, np.array([label[d] for d in sorted(label)]))
    got = {r.doc_id: r.score for r in quality.op9_quality(spark, SF).collect()}
    assert set(got) == set(text)
    for d, t in text.items():
        assert math.isclose(got[d], model.score(np.array(plain_grams(t), dtype=np.int64)), abs_tol=1e-9)


def test_learnt_rows_are_bounded_and_repeat_no_id(spark, tables):
    _, docs, labels = tables
    twice = docs.union(docs.withColumn("text", F.lit("another text")))
    every, y = quality.learnt_rows(twice, labels, 100)
    assert len(every) == len(y) == 100
    some, _ = quality.learnt_rows(docs, labels, 100, most_grams=5_000)
    assert 0 < len(some) < 100 and sum(map(len, some)) <= 5_000
    again, _ = quality.learnt_rows(docs.repartition(7), labels, 100, most_grams=5_000)
    assert [x.tolist() for x in some] == [x.tolist() for x in again]


def test_log_count_ratios_against_brute_force():
    rows, y = [np.array([1, 2]), np.array([2, 3]), np.array([2])], np.array([1.0, -1.0, -1.0])
    got, n = quality.log_count_ratios(rows, y), quality.HASHES
    good, bad = Counter([1, 2]), Counter([2, 3, 2])
    for g in (1, 2, 3, 4):
        assert math.isclose(got[g], math.log((good[g] + 1) / (n + 2)) - math.log((bad[g] + 1) / (n + 3)))


def test_dual_coordinate_descent_finds_the_optimum():
    """Primal and dual objectives meet."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    ratio, cost = quality.log_count_ratios(rows, y), np.where(y > 0, 0.8, 1.2)
    weights, dual = quality.dual_coordinate_descent(rows, y, ratio, cost, rounds=3_000)
    x = np.zeros((80, quality.HASHES + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, -1] = 1
    assert np.allclose(x.T @ (dual * y), weights) and (dual >= 0).all() and (dual <= cost).all()
    primal = weights @ weights / 2 + (cost * np.maximum(0, 1 - y * (x @ weights))).sum()
    assert primal - (dual.sum() - weights @ weights / 2) < 0.02 * primal
