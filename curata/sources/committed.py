"""A table sink with commit: versions are staged and verified, a pointer file is swapped by one atomic rename, and unchanged content is not written again.

A path holds folders of versions and the file CURRENT, which names one of them with its digest. Readers go by the pointer, so that a write that fails half way leaves the old
version as it is. The digest does not depend on the order of rows or files: for each row two 64-bit hashes of its JSON form, each folded by sum and by exclusive or, beside the schema and the number of rows.

Defined results: an empty table is a version like any other; reading a path without a version is an error; repeated rows count; one writer at a time (of two, the last rename stands).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def content_digest(df: DataFrame) -> str:
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}) if df.columns else F.lit("")
    hashes = [F.xxhash64(row), F.xxhash64(F.lit("second"), row)]
    sums = [F.sum(h.cast("decimal(38,0)")) for h in hashes] + [F.bit_xor(h) for h in hashes]
    found = df.agg(F.count(F.lit(1)), *sums).first()
    return f"{df.schema.simpleString()}|" + "|".join(str(x or 0) for x in found)


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        self.gateway = spark.sparkContext._gateway

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def read(self, path: str) -> str | None:
        if not self.fs.exists(self.at(path)):
            return None
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.at(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def swap(self, new: str, old: str) -> None:
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.context.rename(self.context.makeQualified(self.at(new)), self.context.makeQualified(self.at(old)), how)

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def _pointed(files: _Files, path: str) -> tuple[str, str] | None:
    text = files.read(f"{path}/{POINTER}")
    return tuple(text.split("\n", 1)) if text else None


def write_committed(df: DataFrame, path: str) -> bool:
    """Whether a new version was committed; False where the content is that of the current one, whose files are then not touched."""
    files = _Files(df.sparkSession, path)
    before = _pointed(files, path)
    name = f"version-{uuid.uuid4().hex}"
    staged = f"{path}/{name}"
    try:
        df.write.parquet(staged)
        digest = content_digest(df.sparkSession.read.schema(df.schema).parquet(staged))
        if before and before[1] == digest:
            files.remove(staged)
            return False
        files.write(f"{path}/.{name}", f"{name}\n{digest}")
        files.swap(f"{path}/.{name}", f"{path}/{POINTER}")
    except BaseException:
        files.remove(staged)
        files.remove(f"{path}/.{name}")
        raise
    return True


def read_committed(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The current version. verify: its content is compared with the digest of its commit first."""
    current = _pointed(_Files(spark, path), path)
    if current is None:
        raise FileNotFoundError(f"no committed version in {path}")
    found = spark.read.parquet(f"{path}/{current[0]}")
    if verify and content_digest(found) != current[1]:
        raise ValueError(f"the files of {path} are not those that were committed")
    return found


def clean(spark: SparkSession, path: str) -> int:
    """Removes versions that the pointer does not name (once no reader uses them); how many."""
    files = _Files(spark, path)
    current = _pointed(files, path)
    old = [s.getPath() for s in files.fs.listStatus(files.at(path)) if s.getPath().getName().startswith(("version-", ".version-")) and s.getPath().getName() != (current or ("",))[0]]
    for p in old:
        files.fs.delete(p, True)
    return len(old)
