import hashlib
from collections import defaultdict

from corvane.llm import common
from corvane.llm.exact_dedup import SPACE, DigestIndex, dedup_batch, dedup_exact, digests, grouped, op3_exact_dedup, without_copies

from .conftest import SF


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in (r.text or "") if c not in SPACE)].append(r)
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id
        out += [(r.doc_id, keep, len(members), r.doc_id == keep, hashlib.sha256(text.encode()).hexdigest()) for r in members]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_against_brute_force(spark, odd, clashing, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(op3_exact_dedup(spark, SF)) == brute(docs.collect())
    assert rows(dedup_exact(odd)) == brute(odd.collect()) == rows(dedup_exact(clashing))
    assert rows(dedup_exact(empty)) == []


def batches_by_hand(batches):
    """Rows (doc_id, text) of batches that follow one another."""
    seen, out = {}, []
    for batch in batches:
        new = defaultdict(list)
        for doc, text in batch:
            new["".join(c for c in (text or "") if c not in SPACE)].append((doc, text or ""))
        for text, members in new.items():
            keep, n = seen.get(text, (min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0], 0))
            seen[text] = keep, n + len(members)
            out += [(doc, *seen[text], doc == keep, hashlib.sha256(text.encode()).hexdigest()) for doc, _ in members]
    return sorted(out, key=str)


def test_batches_against_brute_force(spark, tmp_path):
    """Three batches, copies within and across them, a text that the index holds once and a batch holds fifty times."""
    schema = "doc_id long, text string"
    first = [(1, "a b"), (2, "c"), (3, None), (None, "z"), *((i, f"old {i}") for i in range(100, 160))]
    second = [(4, "a  b"), (5, "d"), (6, "d "), (7, ""), *((i, "hot\ttext") for i in range(200, 250))]
    third = [(8, "ab"), (9, "d"), (10, "new"), *((i, "c") for i in range(300, 350)), (351, "hottext"), (1, "other text, same id")]
    index, got = DigestIndex(spark, "seen", str(tmp_path / "seen"), buckets=4), []
    for n, batch in enumerate((first, second, third)):
        if n == 2:  # as a later session would
            index.drop()
            index = DigestIndex(spark, "seen_again", str(tmp_path / "seen"), buckets=4)
        answer = rows(dedup_batch(spark.createDataFrame(batch, schema), index, f"batch {n}"))
        assert rows(dedup_batch(spark.createDataFrame(batch, schema), index, f"batch {n}")) == answer  # handed over again, as after a lost driver
        got += answer
    assert sorted(got, key=str) == batches_by_hand([first, second, third])
    assert index.rows().filter("first").count() == len({r[4] for r in got}) and index.batches() == {"batch 0", "batch 1", "batch 2"}
    before = sorted(map(str, index.of().collect()))
    index.compact("all")
    assert sorted(map(str, index.of().collect())) == before and index.batches() == {"all"} and index.rows().count() == len(before)
    groups = common.checkpointed(grouped(digests(spark.createDataFrame(third, schema))))
    lines = index.of(groups)._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    assert sum("FileScan" in line for line in lines) == 2 and "Exchange" not in "".join(lines[scan - 3 : scan])
    index.drop()


def test_answers_come_from_what_the_anti_join_lets_in(spark):
    """Were the same digests new in each batch, they would be answered twice."""
    index = DigestIndex(spark, "twice", buckets=4)
    groups = common.checkpointed(grouped(digests(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))))
    index.append(groups, "x")
    assert index.of().count() == 2 and index.append(groups, "x") is False and index.append(groups, "y")
    assert index.of().count() == 2 and {r.group_size for r in index.of().collect()} == {2}
    again = groups.withColumn("first", common.F.lit(True)).withColumn("batch", common.F.lit("z")).select(*index.rows().columns)
    again.write.format("parquet").partitionBy("batch").bucketBy(4, "digest").sortBy("digest").mode("append").saveAsTable("twice")
    assert index.of().count() > 2
    index.drop()


def test_the_index_is_not_shuffled(spark, monkeypatch):
    """A small batch against a large index: no exchange between the index and its joins, and nothing of it is broadcast."""
    index = DigestIndex(spark, "large", buckets=4)
    dedup_batch(spark.range(5_000).selectExpr("id doc_id", "cast(id as string) text"), index, "first")
    batch = spark.createDataFrame([(9_000, "7"), (9_001, "x")], "doc_id long, text string")
    groups = common.checkpointed(grouped(digests(batch)))
    known = index.rows().filter("first").select("digest").hint("merge")
    for partitions in (4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for plan in (groups.join(known, "digest", "left_anti"), index.of(groups)):
            lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
            deep = lambda line: len(line) - len(line.lstrip(" :+-"))
            scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
            above = [line for i, line in enumerate(lines[:scan]) if all(deep(line) < deep(x) for x in lines[i + 1 : scan + 1])]
            assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    small = []
    monkeypatch.setattr(common.F, "broadcast", lambda df, f=common.F.broadcast: small.append(df) or f(df))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in dedup_batch(batch, index, "second").collect()} == {(9_000, 7, 2), (9_001, 9_001, 1)}
    assert small and all(df.count() <= 2 for df in small)
    index.drop()


def test_rows_that_share_an_id_are_kept_apart(spark):
    docs = [(0, "same text here"), (1, "same text  here"), (1, "a quite different text"), (1, "a quite different text"), (None, "x"), (None, "x"), (5, None), (6, " ")]
    got = without_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "same text  here"), (1, "a quite different text"), (None, "x"), (6, " ")], key=str)


def test_native_plan(spark):
    plan = op3_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_texts(spark):
    texts = ["a" * 2_000_000, " " * 2_000_000, "\n" * 2_000_000, "中" * 700_000, ("a" * 2_000_000) + "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(dedup_exact(docs)) == brute(docs.collect())


#: Every name that the stages use inside, and then some.
INSIDE = ["gone_id", "gone_digest", "gone_length", "row_key", "row", "key", "id", "digest", "length", "n", "stays", "keep_id", "keep_length", "kept", "best", "text_key", "carried", "predicted", "first", "batch", "n_words", "n_hit", "spans", "items", "better", "more"]


def test_names_and_kinds_of_further_columns(spark):
    """All names that are used inside, and maps, arrays and structs beside rows that repeat."""
    docs = [(0, "same text here"), (1, "same text  here"), (1, "same text  here"), (None, "x"), (None, "x"), (2, None), (3, "")]
    wide = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *[f"'junk' AS `{c}`" for c in INSIDE], "map('k', text, 'l', 'm') m", "array(doc_id, 1) a", "struct(map(doc_id is null, text) as mm) s")
    got = without_copies(wide)
    assert got.dtypes == wide.dtypes
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(map(str, [(1, "same text  here"), (None, "x"), (2, None)]))
