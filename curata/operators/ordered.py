"""Global row numbers and running sums without a single-task window: rows are sorted by range, each range is numbered on its own and shifted by the
totals of the ranges before it. Only one row per range meets in one task. Rows with equal order keys may be numbered in any order, so give a unique last key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.operators.scratch import stored


#: Characters by which long texts are cut into ranges; texts that begin with the same ones are sorted by one task.
BEGINNING = 256


def _sorted(rows: DataFrame, order: list, long: str | None) -> DataFrame:
    """rows in global order. Sorting draws a sample of the order's keys to the driver, whole; by a `long` text that is first in the order it draws beginnings only. A text's
    beginning is never after that of a larger text, and equal ones fall in one range."""
    if long is None:
        return rows.orderBy(*order)
    return rows.withColumn("_range", F.substring(long, 1, BEGINNING)).repartitionByRange("_range").sortWithinPartitions(*order).drop("_range")


def running(rows: DataFrame, order: list, amount, name: str, long: str | None = None) -> DataFrame:
    """Adds `name`: the sum of `amount` over all rows up to this one, in order. long: the first column of the order, if it holds long texts."""
    cut = stored(_sorted(rows.withColumn("_amount", amount), order, long).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = cut.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumn("_upto", F.sum("_amount").over(inside)).join(offsets, "_part")
    return found.withColumn(name, F.col("_offset") + F.col("_upto")).drop("_amount", "_part", "_at", "_upto", "_offset")


def ranked(rows: DataFrame, order: list, name: str = "place", long: str | None = None) -> DataFrame:
    """Adds `name`: the row's number in the order, from 1. long: as in running."""
    return running(rows, order, F.lit(1).cast("long"), name, long)


def drawn(rows: DataFrame, id_column: str, weight: str, draws: int, seed: str = "draw", buckets: int = 4096) -> DataFrame:
    """`draws` draws with replacement, chances in proportion to the whole-number `weight`: (draw, id_column). A draw's place in the running sum of weights
    is a hash of its number; rows and draws meet by equal buckets of that range."""
    placed = running(rows.where(F.col(weight) > 0).select(id_column, F.col(weight).cast("long").alias("w")), [id_column], F.col("w"), "upto")
    total = placed.agg(F.sum("w")).first()[0]
    if not total:
        return placed.select(F.lit(0).cast("long").alias("draw"), id_column).limit(0)
    wide = -(-total // buckets)
    ranges = placed.withColumn("from", F.col("upto") - F.col("w")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / wide), F.floor((F.col("upto") - 1) / wide))))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long")
    points = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), (u % total).alias("at")).withColumn("bucket", F.floor(F.col("at") / wide))
    return points.join(ranges, "bucket").where("at >= from and at < upto").select("draw", id_column)
