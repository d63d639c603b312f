"""Sources under a guard with a budget, and the clip index over several runs."""

import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from curata.operators import clips
from curata.sources import guarded


def test_failed_sources_leave_the_others_whole(spark, tmp_path):
    for name, n in (("one", 5), ("broken", 7), ("three", 3), ("none", 0)):
        spark.range(n).selectExpr("id", "cast(id as string) AS text", "1 AS extra", "'clash' AS source").repartition(3).write.parquet(str(tmp_path / name))
    part = next(p for p in pathlib.Path(tmp_path, "broken").glob("*.parquet") if p.stat().st_size > 0)
    part.write_bytes(b"no parquet")
    sources = [(k, str(tmp_path / k), spark.read.schema("id long, text string, extra int").parquet) for k in ("one", "broken", "gone", "three", "none")]
    sources.append(("value", str(tmp_path / "one"), lambda p: spark.read.parquet(p).withColumn("id", F.raise_error(F.lit("bad value")).cast("long"))))
    sources.append(("columns", str(tmp_path / "one"), lambda p: spark.read.parquet(p).drop("text")))
    got = guarded.load_sources(spark, sources, "id long, text string", str(tmp_path / "at"))
    assert {r.source: r["count"] for r in got.rows.groupBy("source").count().collect()} == {"one": 5, "three": 3} and got.rows.columns == ["source", "id", "text"]
    assert {r.source: r.kind for r in got.problems.collect()} == {"broken": "failed", "gone": "missing", "value": "failed", "columns": "failed"}
    assert [r.rows for r in got.summary.orderBy("place").collect()] == [5, 0, 0, 3, 0, 0, 0]
    with pytest.raises(ValueError, match="one key"):
        guarded.load_sources(spark, sources[:1] * 2, "id long, text string", str(tmp_path / "at"))
    assert guarded.load_sources(spark, [], "id long", str(tmp_path / "at")).rows.count() == 0


def test_budgets(spark, tmp_path):
    for name in "abcd":
        spark.range(10).write.parquet(str(tmp_path / name))
    sources = [(k, str(tmp_path / k), spark.read.parquet) for k in "abcd"]
    size = guarded._bytes(spark, str(tmp_path / "a"))
    got = guarded.load_sources(spark, sources, "id long", str(tmp_path / "at"), budget_bytes=size + 1)
    assert {r.source for r in got.rows.distinct().collect()} == {"a", "b"} and {(r.source, r.kind) for r in got.problems.collect()} == {("c", "not started"), ("d", "not started")}
    ticks = iter(range(0, 1000, 60))
    got = guarded.load_sources(spark, sources, "id long", str(tmp_path / "at"), budget_seconds=130, clock=lambda: next(ticks))
    assert {r.source for r in got.rows.distinct().collect()} == {"a", "b"} and got.problems.count() == 2


def test_clip_index(spark, tmp_path):
    path, begun, calls = str(tmp_path / "clips"), datetime.datetime(2024, 1, 1), []
    stamps = lambda: {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}

    def make(new):
        calls.append({r.text for r in new.collect()})
        return new.select("digest", F.when(F.col("text") != "quiet", F.encode("text", "UTF-8")).alias("payload"))

    def run(texts, version="v1", hours=0):
        rows = spark.createDataFrame(list(enumerate(texts)), "key int, text string").withColumn("batch", F.lit("clash")).withColumn("digest", F.lit("clash"))
        return [r.status for r in clips.refresh(rows, path, make, version, begun + datetime.timedelta(hours=hours), least=2).orderBy("key").collect()]

    held = lambda: sorted(bytes(r.payload).decode() for r in clips.clips(spark, path).collect())
    assert run(["red", "red", "green", None, " x ", "quiet", "long " * 100_000]) == ["new", "new", "new", "short", "short", "silent", "new"]
    assert held() == sorted(["red", "green", "long " * 100_000])
    before = stamps()
    assert run(["red", "green", "red", "long " * 100_000], hours=1) == ["reused"] * 4 and calls[-1] == set() and stamps() == before
    assert run(["green", "blue"], hours=2) == ["reused", "new"] and calls[-1] == {"blue"} and held() == ["blue", "green"]
    assert run(["green", "blue"], hours=25) == ["new", "reused"]  # green is a day old
    assert run(["green", "blue"], "v2", hours=25) == ["new", "new"] and held() == ["blue", "green"]
    with pytest.raises(Exception, match="division"):
        clips.refresh(spark.createDataFrame([(1, "other")], "key int, text string"), path, lambda new: new.select("digest", F.raise_error(F.lit("division")).cast("binary").alias("payload")), "v2", begun)
    assert held() == ["blue", "green"]
    assert run([]) == [] and held() == [] and not list(pathlib.Path(path, "clips").glob("*/*.parquet"))
