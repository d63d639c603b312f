"""Order-dependent dedup and clustering, giving exactly what a scan in order gives.

A scan's decision on a row depends only on rows that it is linked with, directly or through others. So links are first contracted to components, and components
of at most `gather` links are packed by a hash into many tasks of bounded size, each of which scans its own in order. Only links of larger components go on in rounds: a round settles
all rows whose predecessors are settled; where a round settles fewer than a tenth of the links (long chains in id order), the rest is taken in slices of `gather` links in order, one task
each. So a component of n links ends after at most 22 * ln(n / gather) rounds and n / gather slices, and no task holds more than `gather` links of it.

Defined results: rows without links are kept, undropped and clusters of their own; repeated links, links of a row with itself, links with a null end and
links to unknown ids do not count; null labels are equal to each other; ids must be unique; empty tables give empty results. These take any links; where links are
those of near rows, `scans` gives the same without listing them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.operators import neardup, ordered, scans
from curata.operators.scans import CONFLICT, DUPLICATE, KEPT, Sets
from curata.operators.scratch import stored


def _pairs(links: DataFrame) -> DataFrame:
    """Distinct links from the smaller to the larger id: a, b. Dealt by a, so that they are shuffled once for this and for the join on a that follows."""
    pairs = links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    return pairs.where("a < b").repartition("a").dropDuplicates(["a", "b"])


def _arcs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct links from the smaller to the larger id, with both labels: a, b, la, lb."""
    pairs = _pairs(links)
    label = lambda s: rows.select(F.col("id").cast("long").alias(s), F.col("label").alias(f"l{s}"))
    return pairs.join(label("a"), "a").join(label("b"), "b")


def components(pairs: DataFrame) -> DataFrame:
    """Per node of pairs (a, b): node, component (the smallest node it reaches). Each task first contracts the pairs that it holds; then every node's neighbours are hung to the
    smallest of them, the larger ones and then the smaller ones, until nothing changes."""

    def contracted(batches):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = sorted((top(a), top(b)))
                if a != b:
                    up[b] = a
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], ["u", "v"])

    edges, before = stored(pairs.select("a", "b").mapInArrow(contracted, "u long, v long")), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = state
        ends = edges.union(edges.select("v", "u"))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = ends.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(lower, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).union(lower)
        edges = stored(moved.where("u <> v").distinct())


def _packed(arcs: DataFrame, gather: int) -> tuple[DataFrame, DataFrame | None]:
    """Arcs of components of at most `gather` arcs with a bucket, dealt to a task for each bucket; and those of larger components, if there are any."""
    named = stored(arcs.join(components(arcs).select(F.col("node").alias("a"), "component"), "a").select(*arcs.columns, "component"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = named.count()
    large = stored(sizes.where(F.col("n") > gather).select("component"))
    buckets = max(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * total // gather))
    small = named.join(large, "component", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    rest = None if large.isEmpty() else stored(named.join(large, "component", "left_semi").select(*arcs.columns))
    return small.drop("component").repartition(buckets, "bucket"), rest


def _scan(table):
    """What nodes are beaten by arcs (a, b) in order; lost: a is known to be beaten."""
    out: set[int] = set()
    for a, b, lost in sorted(zip(*(table.column(c).to_pylist() for c in ("a", "b", "lost")), strict=True)):
        if not lost and a not in out:
            out.add(b)
    return pa.table({"node": pa.array(sorted(out), pa.int64())})


def beaten(arcs: DataFrame, gather: int = 200_000) -> DataFrame:
    """arcs (a, b), a < b, distinct and stored. The nodes that some unbeaten smaller node has an arc to, as `node`: every node in id order beats
    its larger neighbours unless it is beaten itself."""
    arcs = arcs.select("a", "b")
    if arcs.isEmpty():
        return arcs.select(F.col("b").alias("node"))
    small, arcs = _packed(arcs, gather)
    lost = small.withColumn("lost", F.lit(False)).groupBy("bucket").applyInArrow(_scan, "node long")
    if arcs is None:
        return lost
    left = arcs.count()
    while left > gather:
        first = stored(arcs.select("a").distinct().join(arcs.select(F.col("b").alias("a")), "a", "left_anti"))
        out = stored(arcs.join(first, "a", "left_semi").select(F.col("b").alias("node")).distinct())
        lost = stored(lost.union(out))
        gone = out.select(F.col("node").alias("a"))
        arcs = stored(arcs.join(first, "a", "left_anti").join(gone, "a", "left_anti").join(out.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
        was, left = left, arcs.count()
        if 10 * left > 9 * was:
            break
    slices = stored(ordered.ranked(arcs, ["a", "b"], "_place"))
    beaten_here = lost.limit(0)
    for k in range(-(-left // gather)):
        part = slices.where((F.col("_place") > k * gather) & (F.col("_place") <= (k + 1) * gather))
        known = part.join(beaten_here.select(F.col("node").alias("a"), F.lit(True).alias("lost")).distinct(), "a", "left").select("a", "b", F.coalesce("lost", F.lit(False)).alias("lost"))
        beaten_here = stored(beaten_here.union(known.groupBy().applyInArrow(_scan, "node long")))
    return lost.union(beaten_here).distinct()


def greedy_dedup(rows: DataFrame, links: DataFrame, gather: int = 200_000) -> DataFrame:
    """Scan in id order: a row takes its undecided neighbours; if any label differs (null-safe) all are conflicts, else it is kept and they are
    duplicates. rows: id, label. Returns id, status."""
    arcs = stored(_arcs(rows, links))
    taken = stored(beaten(arcs, gather))
    heads = arcs.join(taken.select(F.col("node").alias("a")), "a", "left_anti")
    # a taken row goes with the first unbeaten row that it is linked with
    owner = heads.groupBy("b").agg(F.min(F.struct("a", (~F.col("la").eqNullSafe(F.col("lb"))).alias("differs"))).alias("x")).select("b", "x.*")
    owner = stored(owner)
    clash = owner.groupBy("a").agg(F.max("differs").alias("clash"))
    members = owner.join(clash, "a").select(F.col("b").alias("id"), F.when(F.col("clash"), CONFLICT).otherwise(DUPLICATE).alias("status"))
    leads = clash.select(F.col("a").alias("id"), F.when(F.col("clash"), CONFLICT).otherwise(KEPT).alias("status"))
    found = members.unionByName(leads)
    return rows.select(F.col("id").cast("long").alias("id")).join(found, "id", "left").select("id", F.coalesce("status", F.lit(KEPT)).alias("status"))


def merge_copies(rows: DataFrame, links: DataFrame, gather: int = 200_000) -> DataFrame:
    """Pairs in order: labels differ, both go; else the second goes if the first is still there. rows: id, label. Returns id, dropped."""
    arcs = _arcs(rows, links).withColumn("differs", ~F.col("la").eqNullSafe(F.col("lb")))
    arcs = stored(arcs.select("a", "b", "differs"))
    # a row drops others until its first conflict with a larger one, unless a smaller one has dropped it by then
    until = arcs.where("differs").groupBy("a").agg(F.min("b").alias("until"))
    dead = arcs.where("differs").select(F.col("b").alias("node")).distinct()
    live = arcs.where("not differs").join(until, "a", "left").where("until is null or b < until").select("a", "b")
    live = live.join(dead.select(F.col("node").alias("a")), "a", "left_anti").join(dead.select(F.col("node").alias("b")), "b", "left_anti")
    gone = beaten(stored(live), gather).union(dead).union(arcs.where("differs").select("a")).distinct().select(F.col("node").alias("id"), F.lit(True).alias("dropped"))
    return rows.select(F.col("id").cast("long").alias("id")).join(gone, "id", "left").select("id", F.coalesce("dropped", F.lit(False)).alias("dropped"))


def _joined(most: int):
    """Pairs in order join their clusters (ca of sa members, cb of sb), none beyond `most`: the clusters that moved with their new size, and the first rows of skipped pairs."""

    def run(table):
        sets, skips = Sets(), []
        for a, _, ca, cb, sa, sb in sorted(zip(*(table.column(c).to_pylist() for c in ("a", "b", "ca", "cb", "sa", "sb")), strict=True)):
            one, other = sets.of(ca, sa), sets.of(cb, sb)
            if one is other:
                continue
            if one[0] + other[0] <= most:
                sets.join(one, other)
            else:
                skips.append(a)
        was = list(sets.home)
        names = {id(s): min(s[1:]) for s in sets.home.values()}
        long = lambda x: pa.array(x, pa.int64())
        blank = [None] * len(skips)
        return pa.table({"was": long(was + blank), "now": long([names[id(sets.home[c])] for c in was] + blank), "size": long([sets.home[c][0] for c in was] + blank), "skip": long([None] * len(was) + skips)})

    return run


_MOVES = "was long, now long, size long, skip long"


def capped_clusters(rows: DataFrame, links: DataFrame, most: int = 64, gather: int = 200_000) -> DataFrame:
    """Pairs in order join their clusters; a union that would pass `most` members is skipped and counted. rows: id, label (not read). Returns id, cluster
    (its smallest id), blocked (skipped unions whose first row it is)."""
    pairs = _pairs(links)
    ids = rows.select(F.col("id").cast("long").alias("id"))
    pairs = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    pairs = stored(pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"), F.lit(1).cast("long").alias("sa"), F.lit(1).cast("long").alias("sb")))
    homes = ids.select("id", F.col("id").alias("cluster"))
    if pairs.isEmpty():
        return homes.withColumn("blocked", F.lit(0).cast("long"))
    small, pairs = _packed(pairs, gather)
    moves = stored(small.groupBy("bucket").applyInArrow(_joined(most), _MOVES))
    skipped = moves.where("skip is not null").select(F.col("skip").alias("id"))

    def moved(homes: DataFrame, moves: DataFrame) -> DataFrame:
        return homes.join(moves.where("was is not null").select(F.col("was").alias("cluster"), "now"), "cluster", "left").select("id", F.coalesce("now", "cluster").alias("cluster"))

    homes = moved(homes, moves)
    left, slow = pairs.count() if pairs is not None else 0, False
    while left:
        if left > gather and not slow:
            # a pair is settled now if no earlier one touches either of its clusters
            first = pairs.select(F.explode(F.array("ca", "cb")).alias("c"), "a", "b").groupBy("c").agg(F.min(F.struct("a", "b")).alias("x")).select("c", "x.*")
            ready = pairs.join(first.withColumnRenamed("c", "ca"), ["ca", "a", "b"], "left_semi").join(first.withColumnRenamed("c", "cb"), ["cb", "a", "b"], "left_semi")
            ready = stored(ready.withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(-(-4 * left // gather)))))
            moves = stored(ready.groupBy("bucket").applyInArrow(_joined(most), _MOVES))
        else:
            ready = stored(pairs.orderBy("a", "b").limit(gather))
            moves = stored(ready.groupBy().applyInArrow(_joined(most), _MOVES))
        homes = stored(moved(homes, moves))
        skipped = skipped.union(moves.where("skip is not null").select(F.col("skip").alias("id")))
        pairs = pairs.join(ready.select("a", "b"), ["a", "b"], "left_anti")
        for s in ("a", "b"):
            found = moves.where("was is not null").select(F.col("was").alias(f"c{s}"), F.col("now").alias("now"), F.col("size").alias("grown"))
            pairs = pairs.join(found, f"c{s}", "left").withColumn(f"c{s}", F.coalesce("now", f"c{s}")).withColumn(f"s{s}", F.coalesce("grown", f"s{s}")).drop("now", "grown")
        pairs = stored(pairs.where("ca <> cb").select("a", "b", "ca", "cb", "sa", "sb"))
        was, left = left, pairs.count()
        slow = slow or 10 * left > 9 * was
    counts = skipped.groupBy("id").agg(F.count(F.lit(1)).alias("blocked"))
    return homes.join(counts, "id", "left").select("id", "cluster", F.coalesce("blocked", F.lit(0)).alias("blocked"))


def dedup_statuses(rows: DataFrame, key: str, label: str, source: str, priority: dict[str, int], protected: str, near: tuple, leak: tuple) -> DataFrame:
    """A pool's statuses: protected rows are deduplicated alone; of the others those near a protected row are look-alikes, and the rest is deduplicated
    in the order of its sources' priority, then of key. rows: key, label, source, unit, bits. Returns key, source, status."""
    names = F.create_map(*[F.lit(x) for pair in ((KEPT, "kept"), (DUPLICATE, "duplicate"), (CONFLICT, "label_conflict")) for x in pair])

    def scanned(some: DataFrame, place) -> DataFrame:
        numbered = stored(ordered.ranked(some.withColumn("_rank", place), ["_rank", key], "_place"))
        found = scans.greedy_dedup(numbered, "_place", None, label, *near)
        found = found.select(F.col("id").alias("_place"), F.element_at(names, F.col("status")).alias("_status"))
        return numbered.join(found, "_place").select(key, source, F.col("_status").alias("status"))

    safe, others = rows.where(F.col(source) == protected), rows.where(F.col(source) != protected)
    clear = neardup.unleaked(others, safe, key, *leak)
    lost = others.join(clear.select(key), key, "left_anti").select(key, source, F.lit("lookalike").alias("status"))
    ranks = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    return scanned(safe, F.lit(0)).unionByName(lost).unionByName(scanned(clear, F.element_at(ranks, F.col(source))))
