"""Files of any size, copies with checks, the stream of sightings, figures from footers."""

import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import quality
from corvane.operators.storage import kept
from corvane.sources import files
from corvane.streaming import stability


@pytest.fixture
def small_limit(spark):
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    yield
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def make(folder, **sizes):
    for name, n in sizes.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes(i * 7 % 251 for i in range(n)))


def test_files_above_the_limit_are_hashed(spark, tmp_path, small_limit, monkeypatch):
    make(tmp_path, a=10, sub__b=5_000, c=1_000, **{"with space ü": 3_000})
    found = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256, r.error) for r in files.scan(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["a", "b", "c", "with space ü"]
    for path in (p for p in tmp_path.rglob("*") if p.is_file()):
        data = path.read_bytes()
        assert found[path.name] == (len(data), hashlib.sha256(data).hexdigest(), None)


def test_a_snapshot_is_whole_or_fails(spark, tmp_path):
    root, target = tmp_path / "kb", tmp_path / "copy"
    make(root, a=10, sub__deep__b=20_000_000, c=7)
    rows = files.snapshot_of(spark, str(root), str(target)).collect()
    assert {r.sha256 for r in rows} == {hashlib.sha256(p.read_bytes()).hexdigest() for p in root.rglob("*") if p.is_file()}
    assert sorted(str(p.relative_to(target)) for p in target.rglob("*") if p.is_file()) == ["a", "c", "sub/deep/b"]
    assert (target / "sub/deep/b").read_bytes() == (root / "sub/deep/b").read_bytes()
    listed = kept(files.listing(spark, str(root)))
    (root / "a").write_bytes(b"other and longer than before")
    os.remove(root / "c")
    again = {r.path.rsplit("/", 1)[1]: r.error for r in files.copied(listed, str(root), str(tmp_path / "second")).collect()}
    assert again == {"a": "CHANGED", "b": None, "c": "CHANGED"}
    assert [p.name for p in (tmp_path / "second").rglob("*") if p.is_file()] == ["b"]


def seen_at(n, path, length, changed):
    t = datetime.datetime(2024, 1, 1)
    return path, length, t + datetime.timedelta(seconds=changed), t + datetime.timedelta(minutes=n)


def test_a_growing_file_waits(spark, tmp_path):
    """Each run of the stream takes up where the one before ended, from its checkpoint."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    let_through = []
    runs = [
        [seen_at(0, "still", 5, 0), seen_at(0, "grows", 1, 0)],
        [seen_at(1, "still", 5, 0), seen_at(1, "grows", 2, 1), seen_at(1, "still", 5, 0)],  # one listing told twice
        [seen_at(2, "still", 5, 0), seen_at(2, "grows", 2, 1), (None, 1, None, None)],
        [seen_at(3, "still", 5, 0), seen_at(3, "grows", 2, 1)],
        [seen_at(5, "still", 6, 9), seen_at(4, "still", 6, 9), seen_at(6, "still", 6, 9)],  # changed after it was let through; out of order
    ]
    for n, rows in enumerate(runs):
        spark.createDataFrame(rows, stability.SIGHTED).coalesce(1).write.mode("append").parquet(source)
        stream = stability.stable(spark.readStream.schema(stability.SIGHTED).parquet(source), probes=3)
        stream.writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()
        now = sorted((r.path, r.length, r.sightings) for r in spark.read.schema(stability.STABLE).parquet(out).collect()) if os.path.exists(out) else []
        let_through.append(now)
    assert let_through[:2] == [[], []] and let_through[2] == [("still", 5, 3)]
    assert let_through[3] == [("grows", 2, 3), ("still", 5, 3)] and let_through[4] == [("grows", 2, 3), ("still", 5, 3), ("still", 6, 3)]


def test_sightings_of_a_listing(spark, tmp_path):
    make(tmp_path, a=3, b=4)
    rows = stability.sightings(files.listing(spark, str(tmp_path))).collect()
    assert {(r.path.rsplit("/", 1)[1], r.length) for r in rows} == {("a", 3), ("b", 4)} and all(r.seen >= r.modified for r in rows)


def test_footers_tell_without_a_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10_000).selectExpr("if(id % 10 = 0, null, id) v", "cast(id as string) s").repartition(3).write.parquet(path)
    with quality.from_footers(spark):
        figures = quality.figures(spark, path, "v")
        assert "PushedAggregation: [COUNT(*), COUNT(v), MIN(v), MAX(v)]" in figures._jdf.queryExecution().executedPlan().toString()
        assert tuple(figures.first()) == (10_000, 9_000, 1, 9_999)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    other = str(tmp_path / "o")
    spark.range(10_000).filter("id % 10 <> 0").write.parquet(other)
    assert quality.quick_consistency(spark, path, "v", other, "id").first().consistent
    spark.range(10_001).filter("id % 10 <> 0 and id <> 9999").write.mode("overwrite").parquet(other)
    assert not quality.quick_consistency(spark, path, "v", other, "id").first().consistent
    spark.range(10).filter("id < 0").write.mode("overwrite").parquet(other)
    empty = quality.quick_consistency(spark, other, "id", other, "id").first()
    assert empty.consistent and empty.vector_n == 0 and empty.vector_high is None


def test_each_long_file_has_a_task(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (i + 1))
    dealt = files.one_each(files.listing(spark, str(tmp_path)))
    of_task = dealt.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert [r["count"] for r in of_task] == [1] * 12


@pytest.mark.parametrize("there", [True, False])
def test_no_long_file_is_read_whole_where_it_can_be_streamed(spark, tmp_path, monkeypatch, there):
    make(tmp_path, small=10)
    with open(tmp_path / "long", "wb") as f:
        f.truncate(files.WHOLE_BYTES + 1)
    if not there:
        monkeypatch.setattr(files, "can_stream", lambda path: False)
    found = files.scan(spark, str(tmp_path))
    whole = files.WHOLE_BYTES if there else int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    assert f"LessThanOrEqual(length,{whole})" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.length, r.sha256, r.error) for r in found.collect()} == {(p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest(), None) for p in tmp_path.iterdir()}


def test_stores_that_pyarrow_opens():
    assert files.can_stream("file:///a/b") and files.can_stream("/a/b")
    assert not files.can_stream("s3a://bucket/b") and not files.can_stream("other://b")
