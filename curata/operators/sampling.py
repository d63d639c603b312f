"""Seeded samples, fair caps, weights and splits."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.text import stable_bucket
from curata.operators import ordered
from curata.operators.scratch import stored


def draw_order(seed: str, id_column: str):
    """A reproducible random order: md5 of the seed and the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def sample_per_key(rows: DataFrame, keys: list[str], id_column: str, n: int, seed: str = "s") -> DataFrame:
    """At most n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(draw_order(seed, id_column), id_column)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def fair_shares(sizes: DataFrame, key: str, source: str, cap: int) -> DataFrame:
    """sizes (key, source, n): each source takes min(n, floor(left / sources left)), smallest first. Adds take."""
    order = F.array_sort(F.collect_list(F.struct("n", F.col(source).alias("source"))))
    start = F.struct(F.lit(cap).cast("long").alias("left"), F.array().cast("array<struct<source:string,take:long>>").alias("out"))
    packed = sizes.groupBy(key).agg(order.alias("all"))

    def step(state, x):
        share = F.least(x["n"], F.floor(state["left"] / (F.size("all") - F.size(state["out"]))))
        return F.struct((state["left"] - share).alias("left"), F.concat(state["out"], F.array(F.struct(x["source"].cast("string").alias("source"), share.alias("take")))).alias("out"))

    folded = packed.select(key, F.explode(F.aggregate("all", start, step)["out"]).alias("x"))
    return folded.select(key, F.col("x.source").alias(source), F.col("x.take").alias("take"))


def fair_cap(rows: DataFrame, key: str, source: str, id_column: str, cap: int, seed: str = "s") -> DataFrame:
    """At most cap rows of each key, shared fairly between its sources."""
    shares = fair_shares(rows.groupBy(key, source).agg(F.count(F.lit(1)).alias("n")), key, source, cap)
    w = Window.partitionBy(key, source).orderBy(draw_order(seed, id_column), id_column)
    return rows.join(shares, [key, source]).withColumn("_place", F.row_number().over(w)).where("_place <= take").drop("_place", "take")


def group_split(rows: DataFrame, group: str, official: str, folds: int = 5) -> DataFrame:
    """Split by group: the official split's mode in the group (ties to the smaller name), else val where the group's md5 bucket is 0."""
    named = rows.join(rows.groupBy(group).agg(F.mode(official, True).alias("_mode")), group)
    bucket = stable_bucket(F.col(group).cast("string"), folds)
    return named.withColumn("split", F.coalesce("_mode", F.when(bucket == 0, "val").otherwise("train"))).drop("_mode")


def cluster_split(clusters: DataFrame, share: float = 0.15, seed: str = "split") -> DataFrame:
    """clusters (cluster, label, size): per label, clusters in seeded order go to test until their rows reach the share. Adds split."""
    w = Window.partitionBy("label").orderBy(draw_order(seed, "cluster"), "cluster")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(Window.partitionBy("label"))
    return clusters.withColumn("split", F.when(before < F.lit(share) * total, "test").otherwise("train"))


def boosted_weights(rows: DataFrame, label: str, field: str, boost: float = 3.0) -> DataFrame:
    """Weights that sum to 1 in each class, field rows counting `boost` times."""
    raw = F.when(F.col(field), F.lit(boost)).otherwise(F.lit(1.0))
    return rows.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy(label)))


def capped_weights(rows: DataFrame, label: str, draws: int, most: int = 4) -> DataFrame:
    """Equal shares of the draws per class, no row expected more than `most` times."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = sizes.agg(F.count(F.lit(1)).alias("_classes"))
    shares = sizes.join(F.broadcast(classes)).withColumn("weight", F.least(F.lit(float(draws)) / F.col("_classes"), F.lit(float(most)) * F.col("_n")) / F.col("_n"))
    return rows.join(shares.select(label, "weight"), label)


def weighted_draw(rows: DataFrame, id_column: str, weight: str, seed: str = "draw") -> DataFrame:
    """Expected `weight` copies of each row: its whole part, and one more with the rest as chance, by a hash of the id. Adds copies."""
    u = F.conv(F.substring(draw_order(seed, id_column), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return rows.withColumn("copies", (F.floor(weight) + (u < F.col(weight) - F.floor(weight)).cast("int")).cast("long")).where("copies > 0")


def capped_classes(rows: DataFrame, label: str, source: str, id_column: str, per_source: int, per_class: int, least: int, seed: str = "s") -> DataFrame:
    """Classes of fewer than `least` rows go; of the others each source gives at most `per_source` rows, and the class at most `per_class`, shared fairly."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(label)
    some = sample_per_key(rows.join(sizes, label, "left_semi"), [label, source], id_column, per_source, seed)
    return fair_cap(some, label, source, id_column, per_class, seed)


def background_pool(rows: DataFrame, crop: str, id_column: str, n: int) -> DataFrame:
    """For each crop at most n rows of other crops, in seeded order. Of each crop only its n first rows for every other crop can be among them, so
    each pair of crops is cut on its own before the crops meet."""
    crops = rows.select(F.col(crop).alias("_for")).distinct()
    key = F.md5(F.concat(F.col("_for"), F.lit(":"), F.col(id_column).cast("string")))
    other = rows.join(crops, F.col(crop) != F.col("_for")).withColumn("_key", key)  # one copy per crop, cut at once
    each = other.withColumn("_k", F.row_number().over(Window.partitionBy("_for", crop).orderBy("_key", id_column))).where(F.col("_k") <= n)
    best = each.withColumn("_k", F.row_number().over(Window.partitionBy("_for").orderBy("_key", id_column))).where(F.col("_k") <= n)
    return best.select(F.col("_for").alias(crop), id_column)


def seeded_positions(key: str, rows: int, n: int) -> list[int]:
    """The places that a Mersenne generator seeded with the first 12 hex digits of the key's MD5 samples from `rows` rows, in the order drawn; all of them, in order, if rows <= n."""
    if rows <= n:
        return list(range(rows))
    return random.Random(int(hashlib.md5(key.encode()).hexdigest()[:12], 16)).sample(range(rows), n)


def seeded_sample(rows: DataFrame, key: str, id_column: str, n: int) -> DataFrame:
    """Per value of `key` the `n` rows that the seeded generator draws from them in the order of id_column, with `drawn`, the place in the draw. The generator sees only a
    key and its number of rows; places are global row numbers, so no key is gathered. Null keys are drawn from as the empty key would be, null ids come first."""
    named = rows.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    placed = stored(ordered.ranked(named, [F.col("_key"), F.col(id_column).asc_nulls_first()], "_rank"))
    sizes = placed.groupBy("_key").agg(F.min("_rank").alias("first"), F.count(F.lit(1)).alias("size"))

    def draw(batches):
        for pdf in batches:
            found = [(first + place, k) for name, first, size in pdf.itertuples(index=False) for k, place in enumerate(seeded_positions(name, size, n))]
            yield pd.DataFrame(found, columns=["_rank", "drawn"], dtype="int64")

    return placed.join(sizes.mapInPandas(draw, "_rank long, drawn long"), "_rank").drop("_rank", "_key")
