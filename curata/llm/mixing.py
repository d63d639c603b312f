"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words: weights share all words, no target exceeds `max_epochs` times its source,
and what is above goes back to the others by weight (solved in closed form over the sources in the order of size to
weight, so no loop). A document is taken once for each complete epoch of its source; the rest of the target goes to the
documents of smallest key -ln(u) / quality, u a hash of doc_id and the seed, whole documents while the prefix sum of their sizes
stays within it, the last one if that brings the source nearer to its target.

The prefix sums do not gather a source in one task: rows are range-partitioned by source and key, cut at quantiles of the keys that are there, whatever the weights; each
(source, range) is summed on its own, and ranges are offset by the totals before them.

Defined results: a null text has size 0; a null source is a source, ordered last; empty texts and empty sources take 0 words;
rows that repeat a doc_id are separate documents with the same key, also in several sources; equal keys are ordered by doc_id, size and a hash of the text; an empty table gives an empty mix; extra
columns are ignored by `mix` and carried through by `mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import fresh, materialise, remove, table, text_of, word_count

WEIGHTS = (5, 2, 1)


def quality_weight(text: Column, size: Column) -> Column:
    """From 0.1 to 1: falls as the mean length of a word with its space leaves the 4 to 10 characters of prose."""
    mean = F.length(text) / size
    off = F.greatest(F.lit(4.0) - mean, mean - F.lit(10.0), F.lit(0.0))
    return F.when(size > 0, F.greatest(F.lit(0.1), F.lit(1.0) / (F.lit(1.0) + off))).otherwise(F.lit(0.1))


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """Efraimidis-Spirakis: the smallest of -ln(u) / weight are the sample."""
    words = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return -F.ln((words + 0.5) / F.lit(float(2**52))) / weight


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sizes: (source, source_size). Adds weight and target. One row per source; only these few rows meet in one task."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(named) - 1) % len(weights) + 1))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    rows = rows.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(everything))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    rows = rows.withColumn("level", level)  # past the first source that stays below its cap the levels only fall
    return rows.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3, seed: str = "mix", quality: Column | None = None) -> DataFrame:
    """docs: doc_id, text, source and, for `quality`, what that column reads. Per row: doc_id, size, source_size, target, taken, source, epochs, sampling_key."""
    spark = docs.sparkSession
    ranges = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = docs.withColumn("size", word_count(text_of()))
    weight = quality if quality is not None else quality_weight(text_of(), F.col("size"))
    keyed = sized.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", F.xxhash64(text_of()).alias("text_hash"), sampling_key(F.col("doc_id"), weight, seed).alias("sampling_key"))
    sized = materialise(keyed, "mix_sizes")  # so that cutting the ranges does not read the texts again
    keyed = materialise(sized.repartitionByRange(ranges, "source", "sampling_key", "doc_id", "size", "text_hash").withColumn("part", F.spark_partition_id()), "mix")
    remove(sized)
    totals = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    quotas = targets(totals.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    offsets = offsets.join(quotas, same(offsets, quotas)).select(offsets["source"].alias("source_"), F.col("part").alias("part_"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("sampling_key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("prefix", F.sum("size").over(inside))
    rows = placed.join(offsets, F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_")))
    rows = rows.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    upto = F.col("offset") + F.col("prefix")
    start = upto - F.col("size")
    extra = (F.col("size") > 0) & ((upto <= left) | ((start < left) & (upto - left <= left - start)))  # an empty text adds nothing to a remainder
    taken = F.col("size") * (F.col("epochs") + extra.cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", (F.col("epochs") + extra.cast("long")).alias("copies"), "text_hash")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes at least once, with all their columns; rows that the mix takes several times come as often."""
    key, source, hash_, total, rows, times, place = (fresh(docs, c) for c in ("doc_id_", "source_", "hash_", "total_", "rows_", "times_", "place_"))
    plan = mix(docs, **options).groupBy(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("text_hash").alias(hash_)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows))
    plan = materialise(plan.where(F.col(total) > 0), "mix_plan")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & docs["source"].eqNullSafe(F.col(source)) & (F.xxhash64(text_of()) == F.col(hash_))
    names = [F.col(c) for c in docs.columns]
    each = F.floor(F.col(total) / F.col(rows)).cast("int")
    even = docs.join(plan.where(F.col(total) % F.col(rows) == 0), same).withColumn(times, each)
    # repeated rows of which the mix takes some once more than others: those first by their columns
    first = Window.partitionBy(key, source, hash_).orderBy(*docs.columns)
    uneven = docs.join(plan.where(F.col(total) % F.col(rows) != 0), same).withColumn(place, F.row_number().over(first))
    uneven = uneven.withColumn(times, each + (F.col(place) <= F.col(total) % F.col(rows)).cast("int")).drop(place)
    taken = even.unionByName(uneven).where(F.col(times) > 0)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
    / CASE WHEN size > 0 THEN greatest(0.1, 1.0 / (1.0 + greatest(4.0 - length(t) / size, length(t) / size - 10.0, 0.0))) ELSE 0.1 END AS sampling_key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_value(5.0, 2.0, 1.0)[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM k GROUP BY source),
o AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
l AS (SELECT max((total - done) / rest) FILTER (WHERE (total - done) / rest <= cap / weight) AS level FROM o),
q AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap)::DOUBLE AS target FROM o, l),
p AS (
  SELECT k.doc_id, k.source, k.size, source_size, target, sum(k.size) OVER (PARTITION BY k.source ORDER BY sampling_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN upto <= target - epochs * source_size OR (upto - size < target - epochs * source_size AND upto - (target - epochs * source_size) <= (target - epochs * source_size) - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken, source
FROM p
"""
