"""Many sources loaded one after the other, each under a guard and all within a budget; what failed is a table of its own.

Each source is read and written to the folder `at` by one job, so a failure of its tasks (a broken file, a bad value) shows there, before anything uses its rows. A source that fails leaves no
rows, the others are whole. A source is started while the budget is not used up; one that was started is finished, and those after it are recorded as not started.

Defined results: keys are distinct, else an error; a source without rows is a good one; no source at all, or none that is good, gives an empty table of the given schema; a source whose columns
are not those of the schema has failed; columns beyond the schema are left out.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBLEMS = "source string, kind string, detail string"


@dataclass
class Loaded:
    rows: DataFrame
    problems: DataFrame
    summary: DataFrame


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def load_sources(spark: SparkSession, sources: list[tuple[str, str, Callable[[str], DataFrame]]], schema: T.StructType | str, at: str, budget_seconds: float | None = None, budget_bytes: int | None = None, clock=time.monotonic) -> Loaded:
    """sources: (key, path, reader of that path), in the order in which they are loaded.

    rows: `source` and the columns of schema; problems: source, kind (missing, failed, not started), detail; summary: source, place, rows, bytes of all sources."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if len({key for key, _, _ in sources}) < len(sources):
        raise ValueError("two sources have one key")
    base = f"{at}/load-{uuid.uuid4().hex}"
    begun, used, problems, summary, good = clock(), 0, [], [], []
    for place, (key, path, read) in enumerate(sources):
        size, count, folder = 0, 0, f"{base}/{place}"
        if budget_seconds is not None and clock() - begun > budget_seconds:
            problems.append((key, "not started", f"the budget of {budget_seconds} seconds is used up"))
        elif budget_bytes is not None and used >= budget_bytes:
            problems.append((key, "not started", f"the budget of {budget_bytes} bytes is used up"))
        else:
            try:
                size = _bytes(spark, path)
                used += size
                read(path).select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).write.parquet(folder)
                count = spark.read.schema(schema).parquet(folder).count()
                good.append((key, folder))
            except Exception as problem:  # whatever a source raises is its own problem only
                _remove(spark, folder)
                problems.append((key, "missing" if "FileNotFound" in str(problem) or "PATH_NOT_FOUND" in str(problem) else "failed", repr(problem)[:300]))
        summary.append((key, place, count, size))
    rows = spark.createDataFrame([], T.StructType([T.StructField("source", T.StringType()), *[T.StructField(f.name, f.dataType) for f in schema]]))
    if good:
        keys = F.create_map(*[F.lit(x) for k, (key, _, _) in enumerate(sources) for x in (str(k), key)])
        loaded = spark.read.schema(schema).parquet(*[folder for _, folder in good])
        place = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        rows = loaded.select(keys[place].alias("source"), *[F.col(f"`{f.name}`") for f in schema])
    return Loaded(rows, spark.createDataFrame(problems, PROBLEMS), spark.createDataFrame(summary, "source string, place int, rows long, bytes long"))
