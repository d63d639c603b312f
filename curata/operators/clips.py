"""A persistent index of the clips that were made for texts: equal texts share a clip, unchanged ones are not made again, clips of removed texts go.

The folder holds `index` (a committed table of digest, n_bytes, version, made_at, batch; no payloads) and `clips/<batch>` (digest, payload), one folder per run that made something. Runs compare
digests only: new work is an anti-join of the distinct texts with the index, so a second run over the same texts makes and writes nothing. An entry counts while its version is the run's and it is
younger than the time to live. A run that fails before its commit leaves the index as it was; the batch it wrote is swept by the next run that commits.

Defined results: a text that is null or shorter than `least` characters after trimming blanks is `short` and has no clip; one for which `make` gives no row or a null payload is `silent` and is tried again
in the next run; repeated keys keep their rows; an empty table of phrases removes every clip.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.sources import committed

INDEX = "digest string, n_bytes long, version string, made_at timestamp, batch string"


def _index(spark: SparkSession, path: str) -> DataFrame:
    try:
        return committed.read_committed(spark, f"{path}/index")
    except FileNotFoundError:
        return spark.createDataFrame([], INDEX)


def refresh(phrases: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], version: str, now, key: str = "key", text: str = "text", least: int = 1, hours: int = 24) -> DataFrame:
    """phrases (key, text); make takes the new (digest, text) and gives (digest, payload). Returns key, clip (the text's digest or null) and status: reused, new, short or silent."""
    spark = phrases.sparkSession
    spoken = F.coalesce(F.length(F.trim(text)) >= least, F.lit(False))
    keyed = phrases.select(F.col(key).alias("key"), F.when(spoken, F.sha2(F.col(text), 256)).alias("digest"), F.col(text).alias("text"))
    wanted = keyed.where("digest is not null").groupBy("digest").agg(F.any_value("text").alias("text"))
    index = _index(spark, path)
    live = index.where((F.col("version") == version) & (F.col("made_at") > F.lit(now) - F.expr(f"interval {int(hours)} hours")))
    kept = live.join(wanted.select("digest"), "digest", "left_semi")
    batch = uuid.uuid4().hex
    at = f"{path}/clips/{batch}"
    make(wanted.join(live.select("digest"), "digest", "left_anti")).where("payload is not null").select("digest", "payload").dropDuplicates(["digest"]).write.parquet(at)
    made = spark.read.schema("digest string, payload binary").parquet(at).select("digest", F.length("payload").cast("long").alias("n_bytes"), F.lit(version).alias("version"), F.lit(now).cast("timestamp").alias("made_at"), F.lit(batch).alias("batch"))
    n_made, n_kept, n_before = made.count(), kept.count(), index.count()
    if n_made or n_kept < n_before:
        committed.write_committed(kept.unionByName(made), f"{path}/index")
    sweep(spark, path)
    current = _index(spark, path).select("digest", "batch")
    status = F.when(F.col("digest").isNull(), "short").when(F.col("batch").isNull(), "silent").when(F.col("batch") == batch, "new").otherwise("reused")
    return keyed.select("key", "digest").join(current, "digest", "left").select("key", F.when(F.col("batch").isNotNull(), F.col("digest")).alias("clip"), status.alias("status"))


def clips(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload of every entry of the index."""
    index = _index(spark, path)
    batches = [r.batch for r in index.select("batch").distinct().collect()]  # one row per run that made clips still in use
    if not batches:
        return spark.createDataFrame([], "digest string, payload binary")
    payloads = spark.read.parquet(*[f"{path}/clips/{b}" for b in batches]).withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return payloads.join(index.select("digest", "batch"), ["digest", "batch"]).select("digest", "payload")


def sweep(spark: SparkSession, path: str, least_used: float = 0.5) -> int:
    """Removes old versions of the index and batches without an entry, and writes batches anew of whose clips less than `least_used` are in use; how many batches went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/clips")
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return 0
    index = _index(spark, path)
    used = {r.batch: r.n for r in index.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    thin = [b for b, n in used.items() if n < least_used * spark.read.parquet(f"{path}/clips/{b}").count()]
    if thin:
        batch = uuid.uuid4().hex
        spark.read.parquet(*[f"{path}/clips/{b}" for b in thin]).join(index.where(F.col("batch").isin(thin)).select("digest"), "digest", "left_semi").write.parquet(f"{path}/clips/{batch}")
        committed.write_committed(index.withColumn("batch", F.when(F.col("batch").isin(thin), batch).otherwise(F.col("batch"))), f"{path}/index")
        used = {b: n for b, n in used.items() if b not in thin} | {batch: 0}
    if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/index")):
        committed.clean(spark, f"{path}/index")
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
