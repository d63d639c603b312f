"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are first reduced to one class with a count. Centroids are fitted on a bounded sample (`sample` vectors, a
documented parameter); every class is then placed in its `probes` nearest cells. A pair is compared in the smallest cell
that both have, so each is counted once. Cells are cut into blocks of `block` vectors and each pair of blocks is a task of
its own, so a crowded cell is spread; tasks give sums and links to the smallest member of a local group, never pairs.
Cosines are computed in double precision; no pair below the threshold is linked. Recall against brute force is that both
vectors of a pair share a cell; the tests measure it.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing, and so does a null vec_id;
vectors of different lengths are not compared; equal rows are separate vectors that link with each other; an empty table
gives an empty result; extra columns (labels too) are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import materialise, table
from curata.llm.components import components


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids; an empty cell takes the vector that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ centroids.T
        home, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=k) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def _unit(flat: pa.ListArray) -> np.ndarray:
    x = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(ids, counts, x, cells, left, right, cell: int, threshold: float, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Linked counts of each row and the smallest id of its local group; left and right are the row numbers of the two blocks (the same
    array for one block)."""
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = place.copy()

    def find(i: np.ndarray) -> np.ndarray:
        while True:
            up = root[order[i]]
            if (up == i).all():
                return i
            i = up

    for a in range(0, len(left), tile):
        la = left[a : a + tile]
        for b in range(a if left is right else 0, len(right), tile):
            rb = right[b : b + tile]
            i, j = np.nonzero(x[la] @ x[rb].T >= threshold)
            i, j = la[i], rb[j]
            if left is right and a == b:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            same = cells[i][:, :, None] == cells[j][:, None, :]
            first = np.where(same.any(2), cells[i], np.iinfo(np.int32).max).min(1)
            i, j = i[first == cell], j[first == cell]
            np.add.at(links, i, counts[j])
            np.add.at(links, j, counts[i])
            p, q = place[i], place[j]
            while len(p):  # hook the larger root under the smaller one until all pairs agree
                p, q = find(p), find(q)
                p, q = p[p != q], q[p != q]
                np.minimum.at(root, order[np.maximum(p, q)], np.minimum(p, q))
    return links, order[find(place)]


def dedup(vectors: DataFrame, threshold: float = 0.9, probes: int = 4, sample: int = 8192, cell_size: int = 512, block: int = 2048) -> DataFrame:
    """vectors: vec_id, embedding. Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = materialise(rows.withColumn("usable", usable), "vectors")
    classes = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.withColumn("dim", F.size("embedding")), "vector_classes")
    total = classes.count()
    drawn = classes.select("dim", "embedding", "id").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    dims = np.asarray(drawn.column("dim"))
    fitted = {}
    for d in np.unique(dims):
        own = _unit(drawn.column("embedding").combine_chunks().filter(pa.array(dims == d)))
        fitted[int(d)] = spherical_kmeans(own, int(max(1, min(len(own) // 16, -(-total // cell_size)))))
    shared = spark.sparkContext.broadcast(fitted)  # at most sample/16 centroids

    def place(batches):
        for batch in batches:
            dim, flat = np.asarray(batch.column("dim")), batch.column("embedding")
            cells = [[0]] * batch.num_rows
            for d in np.unique(dim):
                if int(d) in shared.value:
                    at, c = np.flatnonzero(dim == d), shared.value[int(d)]
                    near = _unit(flat.take(pa.array(at))) @ c.T
                    top = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :probes], axis=1)
                    for i, t in zip(at, top.tolist(), strict=True):
                        cells[i] = t
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("dim"), flat, pa.array(cells, pa.list_(pa.int32()))], ["id", "n", "dim", "embedding", "cells"])

    placed = classes.select("id", "n", "dim", "embedding").mapInArrow(place, "id long, n long, dim int, embedding array<double>, cells array<int>")
    placed = materialise(placed, "vector_cells")
    sizes = placed.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    spread = placed.withColumn("cell", F.explode("cells")).join(sizes, ["dim", "cell"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("dim", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "embedding", "cells")

    def solve(key, group):
        _, cell, i, j = (k.as_py() for k in key)
        group = group.combine_chunks()
        ids, counts, own = (np.asarray(group.column(c)) for c in ("id", "n", "own"))
        column = group.column("cells").combine_chunks()
        width = max(len(c) for c in column)
        cells = np.asarray(column.flatten(), np.int32).reshape(len(ids), width)
        flat = group.column("embedding").combine_chunks()
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        links, root = compare(ids, counts, _unit(flat), cells, left, right, cell, threshold)
        some = np.flatnonzero(links > 0)
        return pa.table({"id": ids[some], "links": links[some], "root": ids[root[some]]})

    found = spread.groupBy("dim", "cell", "i", "j").applyInArrow(solve, "id long, links long, root long")
    found = materialise(found, "vector_links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select("id", "root")).select(F.col("node").alias("id"), "component")
    facts = classes.join(sums, "id", "left").join(roots, "id", "left")
    facts = facts.select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("usable").join(facts, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id
"""
