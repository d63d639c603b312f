"""Connected components by alternating large-star and small-star steps, distributed throughout.

Every step is an aggregation and a join on node ids; the edge list is written to the shared folder after each round, so
lineage stays short and a lost executor costs one round. A node with very many neighbours is one key of a join with both sides
exchanged, which adaptive execution splits. Self-links and nulls are ignored, repeated links count once, no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import materialise, remove


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: two long columns. Per node in a link: node, component (the smallest node reachable)."""
    a, b = links.columns
    edges = links.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges, "links")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = small.union(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialise(done, "links")
        remove(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
