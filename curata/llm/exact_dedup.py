"""Exact dedup with a persistent digest index (DataFrame functions only).

The index is a parquet table with one row per distinct digest, bucketed and sorted by digest. New data is reduced to
one row per digest before any shuffle of rows (map-side partial aggregation), anti-joined with the index by a
sort-merge join, and what remains is appended. Rows are resolved against the index with both sides exchanged, so that
adaptive execution can split the rows of a very common digest over many tasks.

Defined results: a null text counts as empty; empty texts are equal to each other; texts of any length are read whole;
rows with the same text and doc_id are copies of one row (all carry kept = true in the report, `distinct_rows` keeps
one); a null doc_id is kept only when every row of its group has none; empty input gives an empty result; other columns
of the input are ignored by the report and carried through by `distinct_rows`. A digest that a later ingest brings again keeps the keep_id and
group_size of the ingest that added it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import fresh, materialise, remove, scratch_path, table, text_of


def digest(text: Column, normalise: Callable[[Column], Column] | None = None) -> Column:
    """Lower-case hex SHA-256 of the (normalised) text in UTF-8."""
    return F.sha2((normalise(text) if normalise else text).cast("binary"), 256)


def reduced(digests: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per digest: the largest id and the number of rows; each map task sends one row per digest at most."""
    return digests.groupBy("digest").agg(F.max(id_column).cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """A persistent set of digests: (digest, keep_id, group_size), bucketed and sorted by digest."""

    SCHEMA = "digest string, keep_id long, group_size long"

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, "digest_index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], self.SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.option("path", self.path).mode("append").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The index without its bucketing, for joins whose other side may be skewed."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def ingest(self, digests: DataFrame, id_column: str = "doc_id") -> None:
        """Append the digests that the index lacks. digests: (id_column, digest)."""
        # written out: else the optimiser moves the anti-join below the aggregate, and every row of a common digest meets in one task
        batch = materialise(reduced(digests, id_column), "digests")
        self._append(batch.join(self.table().select("digest").hint("merge"), "digest", "left_anti"))
        remove(batch)

    def resolve(self, digests: DataFrame) -> DataFrame:
        """Each row with the keep_id and group_size of its digest."""
        return digests.join(self.rows(), "digest", "left")


def report(docs: DataFrame, index: DigestIndex | None = None, normalise=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = index or DigestIndex(docs.sparkSession)
    digests = docs.select("doc_id", digest(text_of(), normalise).alias("digest"))
    index.ingest(digests)
    found = index.resolve(digests)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def distinct_rows(docs: DataFrame, index: DigestIndex | None = None, normalise=None) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the largest doc_id."""
    index = index or DigestIndex(docs.sparkSession)
    key, keep, place = fresh(docs, "digest_"), fresh(docs, "keep_id_"), fresh(docs, "place_")
    with_key = docs.withColumn(key, digest(text_of(), normalise))
    index.ingest(with_key.select("doc_id", F.col(key).alias("digest")))
    keepers = index.rows().select(F.col("digest").alias(key), F.col("keep_id").alias(keep))
    same = (with_key[key] == keepers[key]) & with_key["doc_id"].eqNullSafe(keepers[keep])
    stay = with_key.join(keepers, same, "left_semi")
    one = Window.partitionBy(key, "doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])
    return stay.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
