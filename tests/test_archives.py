"""Archives: members spread over tasks, whole archives or none, damage is found."""

import pathlib
import zipfile

import pytest
from pyspark.sql import functions as F

from curata.sources import archives


def test_one_large_archive_spreads_over_tasks(spark, tmp_path):
    want = {}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.mkdir("deep")
        for k in range(10_000):
            want[f"deep/{k}.bin"] = str(k).encode() * (k % 90)
            z.writestr(f"deep/{k}.bin", want[f"deep/{k}.bin"], zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    rows = archives.read_zips(spark, str(tmp_path), split_bytes=200_000)
    assert {r.member: bytes(r.payload) for r in rows.collect()} == want
    per_task = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 4 and max(r["count"] for r in per_task) < 6_000
    few = archives.read_zips(spark, str(tmp_path), F.col("member") == "deep/77.bin").collect()
    assert [(r.member, bytes(r.payload), r.size) for r in few] == [("deep/77.bin", b"77" * 77, 154)]
    assert archives.zip_index(spark, str(tmp_path)).count() == 10_000


def test_damage_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", b"payload that will change")
    held = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(held.replace(b"will change", b"has changed", 1))
    with pytest.raises(Exception, match="damaged"):
        archives.read_zips(spark, str(tmp_path)).collect()


def test_sink_round_trip_and_commit(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = [("a/b", f"{k}.txt", bytearray(b"x" * k)) for k in range(200)] + [(None, "n", bytearray(b"1")), ("c", None, None), ("c", "same", bytearray(b"1")), ("c", "same", bytearray(b"2"))]
    files = spark.createDataFrame(rows, "role string, file string, payload binary").withColumn("part", F.lit("clash")).repartition(3)
    archives.write_zips(files, at, "role", most_bytes=5_000)
    got = sorted((r.member, bytes(r.payload)) for r in archives.read_zips(spark, at).collect())
    assert got == sorted((f or "unnamed", bytes(p or b"")) for _, f, p in rows)
    names = {p.name.rsplit("-", 1)[0] for p in pathlib.Path(at).iterdir()}
    assert names == {"is-a%2Fb", "is-c", "null"} and len(list(pathlib.Path(at).glob("is-a*"))) > 1
    before = sorted(p.name for p in pathlib.Path(at).iterdir())
    broken = files.withColumn("payload", F.when(F.col("file") == "150.txt", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="broken"):
        archives.write_zips(broken, at, "role", overwrite=True)
    with pytest.raises(Exception, match="broken"):
        archives.write_zips(broken, at + "2", "role")
    with pytest.raises(Exception, match="FileExists"):
        archives.write_zips(files, at, "role")
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and sorted(p.name for p in pathlib.Path(at).iterdir()) == before
    archives.write_zips(files.where("role = 'c'"), at, "role", overwrite=True)
    assert archives.zip_index(spark, at).count() == 3
    empty = files.where("role = 'a/b'").withColumn("payload", F.lit(None).cast("binary"))
    archives.write_zips(empty, at + "4", "role", most_members=50)
    assert len(list(pathlib.Path(at + "4").iterdir())) > 2 and archives.zip_index(spark, at + "4").count() == 200
    archives.write_zips(files.limit(0), at + "3", "role")
    assert archives.read_zips(spark, at + "3").count() == 0
