"""The sink with commit: unchanged content is left alone, failed writes leave the old version, damage is found."""

import pathlib

import pytest
from pyspark.sql import functions as F

from curata.sources import committed


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_committed_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path)
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, text string")
    assert committed.write_committed(rows, path) and sorted(r.id for r in committed.read_committed(spark, path, verify=True).collect()) == [1, 2, 2]
    before = _files(path)
    assert not committed.write_committed(rows.repartition(3).orderBy(F.desc("id")), path) and _files(path) == before
    broken = rows.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        committed.write_committed(broken, path)
    assert _files(path) == before
    assert committed.write_committed(rows.distinct(), path) and committed.read_committed(spark, path).count() == 2
    assert committed.clean(spark, path) == 1 and committed.read_committed(spark, path, verify=True).count() == 2
    assert committed.write_committed(rows.limit(0), path) and committed.read_committed(spark, path).count() == 0
    assert committed.write_committed(rows.limit(0).withColumn("more", F.lit(1)), path)
    version = pathlib.Path(path, pathlib.Path(path, "CURRENT").read_text().split("\n")[0])
    rows.withColumn("more", F.lit(1)).write.mode("overwrite").parquet(str(version))
    with pytest.raises(ValueError, match="not those"):
        committed.read_committed(spark, path, verify=True)
