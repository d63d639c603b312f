"""Zip archives as tables: members are listed once, dealt to tasks by ranges of bytes and read there; the sink commits whole archives or none.

Reading: one task per archive lists its members (the directory at the archive's end), the short rows of that list are dealt by (archive, range of bytes), and each task reads only the bytes of
its own members. A large archive therefore spreads over many tasks and no task holds more than a batch of payloads.

Writing: each attempt of a task writes its own files in a staging folder beside the target. The commit, on the driver, keeps the files of the successful attempts and puts the folder in place by
one rename; an abort removes it. So a failed job leaves no archive.

Files are opened in the tasks with pyarrow's file systems (local and shared folders, HDFS, object stores).

Defined results: a missing name becomes "unnamed" and a missing payload an empty member; members of equal names are all kept; folders inside an archive are no members; an empty archive gives no
rows; an empty table gives an empty folder; a damaged archive or member (wrong checksum) is an error, never a short payload; methods other than stored and deflate are errors.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SPLIT_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
LOCAL_HEADER = 30  # fixed value: bytes of a member's header before its name


def _open_fs(path: str):
    """The file system of a path or URI and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def zip_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per member: archive, member, header_at, packed, size, method, crc. No payload is read."""

    def listed(batches):
        import pandas as pd

        for pdf in batches:
            for archive in pdf["path"]:
                fs, at = _open_fs(archive)
                with fs.open_input_file(at) as file, zipfile.ZipFile(file if file.size() > 1 << 16 else io.BytesIO(file.read())) as z:  # small ones whole: zipfile looks before their start
                    infos = [i for i in z.infolist() if not i.is_dir()]
                for start in range(0, len(infos), 10_000):
                    yield pd.DataFrame([(archive, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in infos[start : start + 10_000]], columns=names)

    names = ["archive", "member", "header_at", "packed", "size", "method", "crc"]
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")
    return archives.mapInPandas(listed, "archive string, member string, header_at long, packed long, size long, method int, crc long")


def _payload(file, row) -> bytes:
    file.seek(row.header_at)
    header = file.read(LOCAL_HEADER)
    if header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at {row.header_at} of {row.archive}")
    file.seek(row.header_at + LOCAL_HEADER + sum(struct.unpack("<HH", header[26:30])))
    packed = file.read(row.packed)
    if row.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"method {row.method} of {row.member} in {row.archive}")
    payload = packed if row.method == zipfile.ZIP_STORED else zlib.decompress(packed, -15)
    if len(payload) != row.size or zlib.crc32(payload) != row.crc:
        raise zipfile.BadZipFile(f"{row.member} in {row.archive} is damaged")
    return payload


def read_zips(spark: SparkSession, path: str, chosen=None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """archive, member, size, payload of the members below path, or of those that the condition `chosen` on the index holds for; others are never read."""
    total = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    index = zip_index(spark, path)
    index = index if chosen is None else index.where(chosen)
    dealt = index.repartition(int(max(1, -(-total // split_bytes))), "archive", F.floor(F.col("header_at") / F.lit(split_bytes)))

    def fetched(batches):
        import pandas as pd

        held, used, archive, file = [], 0, None, None
        try:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    if row.archive != archive:
                        if file is not None:
                            file.close()
                        fs, at = _open_fs(row.archive)
                        archive, file = row.archive, fs.open_input_file(at)
                    held.append((row.archive, row.member, row.size, _payload(file, row)))
                    used += row.size
                    if used >= BATCH_BYTES:
                        yield pd.DataFrame(held, columns=["archive", "member", "size", "payload"])
                        held, used = [], 0
        finally:
            if file is not None:
                file.close()
        if held:
            yield pd.DataFrame(held, columns=["archive", "member", "size", "payload"])

    return dealt.sortWithinPartitions("archive", "header_at").mapInPandas(fetched, "archive string, member string, size long, payload binary")


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class ZipWriter(DataSourceArrowWriter):
    """Rows (role, part, file, payload), sorted by role and part within a task, as one archive per role and part."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staged = f"{self.path}-staged-{uuid.uuid4().hex}"

    def write(self, batches):
        attempt = uuid.uuid4().hex
        fs, base = _open_fs(f"{self.staged}/{attempt}")
        fs.create_dir(base, recursive=True)
        files, key, sink, z = [], None, None, None

        def close():
            if z is not None:
                z.close()
                sink.close()

        for batch in batches:
            for row in batch.to_pylist():
                if z is None or key != (row["role"], row["part"]):
                    close()
                    key = (row["role"], row["part"])
                    files.append(f"{attempt}/{'null' if key[0] is None else 'is-' + quote(str(key[0]), safe='')}-{key[1]:05d}.zip")
                    sink = fs.open_output_stream(f"{base}/{files[-1].split('/')[1]}")
                    z = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                z.writestr(zipfile.ZipInfo(row["file"] or "unnamed"), row["payload"] or b"")
        close()
        return _Written(files)

    def commit(self, messages):
        from pyarrow.fs import FileType

        fs, staged = _open_fs(self.staged)
        target = _open_fs(self.path)[1]
        fs.create_dir(f"{staged}/out", recursive=True)
        for message in messages:
            for name in message.files if message else []:
                fs.move(f"{staged}/{name}", f"{staged}/out/{name.split('/')[1]}")
        old = f"{staged}/old"
        there = fs.get_file_info(target).type != FileType.NotFound
        if there and not self.overwrite:
            fs.delete_dir(staged)
            raise FileExistsError(self.path)
        if there:
            fs.move(target, old)
        fs.move(f"{staged}/out", target)
        fs.delete_dir(staged)

    def abort(self, messages):
        from pyarrow.fs import FileType

        fs, staged = _open_fs(self.staged)
        if fs.get_file_info(staged).type != FileType.NotFound:
            fs.delete_dir(staged)


class ZipSink(DataSource):
    @classmethod
    def name(cls):
        return "zip_sink"

    def writer(self, schema, overwrite):
        return ZipWriter(self.options["path"], overwrite)


def write_zips(files: DataFrame, path: str, by: str, file: str = "file", payload: str = "payload", most_bytes: int = SPLIT_BYTES, most_members: int = 50_000, overwrite: bool = False) -> None:
    """Uncompressed archives of about `most_bytes` and `most_members` below path, one or more per value of `by`; a large role is dealt to several by a hash of the names. An existing path is an error unless overwrite."""
    rows = files.select(F.col(by).cast("string").alias("role"), F.col(file).alias("file"), F.col(payload).alias("payload"))
    parts = rows.groupBy("role").agg(F.greatest(F.ceil(F.sum(F.length("payload")) / F.lit(most_bytes)), F.ceil(F.count(F.lit(1)) / F.lit(most_members)), F.lit(1)).cast("long").alias("_parts")).withColumnRenamed("role", "_role")
    dealt = rows.join(parts, F.col("role").eqNullSafe(F.col("_role"))).select("role", F.pmod(F.xxhash64("file", F.length("payload")), F.coalesce("_parts", F.lit(1))).alias("part"), "file", "payload")
    files.sparkSession.dataSource.register(ZipSink)
    dealt.repartition("role", "part").sortWithinPartitions("role", "part", "file").write.format("zip_sink").mode("overwrite" if overwrite else "append").option("path", path).save()
