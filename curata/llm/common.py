"""What the operators of this subpackage share: text expressions, scratch tables and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for an empty text. By splitting: counting the matches of a pattern costs time in the square of a text's length."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]++"), "")).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row although a lambda inside reads it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where it is unset a local session, as in tests, gets a temporary
    one; on a cluster that would be a folder of one machine, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_curata_dir", None) or tempfile.mkdtemp(prefix="curata-")
        spark._curata_dir = at
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/curata/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a materialised table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have, so that extra columns of the input cannot clash."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


# ---- vectorised 64-bit hashes of words -------------------------------------------------------

_G = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _G.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _G.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and the start and end of each word."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return raw, edges[0::2], edges[1::2]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes give equal hashes in every process. A sum of products of random odd numbers, one for
    each byte value and one for each place, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    offsets = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(offsets, length)
    with np.errstate(over="ignore"):
        value = _BYTE[raw[np.repeat(starts, length) + place]]
        if int(length.max()) <= len(_PLACE):
            value *= _PLACE[place]
        else:
            value *= _PLACE[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
        sums = np.add.reduceat(value, offsets)
        return mix(sums + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_hashes(data: bytes) -> np.ndarray:
    return hash_spans(*word_spans(data))
