"""Prefix tries of conversations: which conversations share their first turns, and how many words sharing saves.

Turns become digests before anything is shuffled. A turn's place in its conversation and the digest of all turns up to it come from running sums
over ranges of (conversation, turn), each range on its own and then offset by the ranges before it, so that no conversation has to fit in a
task. A prefix is known by two 64-bit sums (exclusive or) of hashes of each turn and its place; equal prefixes are one node.

Nodes are hash-partitioned by the digest of their first turn, and each bucket builds its tries as dictionaries of pointers and walks them in iterative postorder.
A first turn with more than `most` nodes is divided by the next turn, and again up to `levels` times: the node above takes its totals from the counts of what
lies below it. What is still too large then (paths that do not branch) gets its totals from sums along its conversations instead, so that there is no bound.

Defined results: turns are ordered by turn (null first), then by role and the digest of role and text; null role or text is empty; rows with a null
conv_id are left out; equal rows are separate turns; an empty table gives no nodes, not even a root; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import materialise, remove, table, text_of, word_count

_COMBINE = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def running(rows: DataFrame, by: str, order: list, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds columns with running sums within `by` in `order`, the row itself included. sums: name -> ("sum" or "xor", column). Ranges of (by, order) are summed
    each on its own and offset by the ranges of the same `by` before them; rows equal in both come in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(n, F.col(by), *order).withColumn("part_", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(by, "part_").agg(*[_COMBINE[kind][0](c).alias(f"{name}_") for name, (kind, c) in sums.items()])
    totals = totals.select(F.col(by).alias("by_"), F.col("part_").alias("at_"), *[_COMBINE[kind][0](f"{name}_").over(before).alias(f"{name}_") for name, (kind, _) in sums.items()])
    inside = Window.partitionBy(by, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[_COMBINE[kind][0](c).over(inside).alias(name) for name, (kind, c) in sums.items()])
    joined = summed.join(totals, (F.col(by) == F.col("by_")) & (F.col("part_") == F.col("at_")))
    return joined.select(*[c for c in rows.columns], *[_COMBINE[kind][1](F.col(name), F.coalesce(f"{name}_", F.lit(0))).alias(name) for name, (kind, _) in sums.items()])


def numbered(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text. Per turn: conv_id, pos (from 1), digest, words."""
    role, text = F.coalesce("role", F.lit("")), text_of()
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), word_count(text).alias("words"), F.lit(1).cast("long").alias("one"))
    return running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], {"pos": ("sum", "one")}).select("conv_id", "pos", "digest", "words")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of conversation c - c % every: the first h of it, h = crc32(c) % heads, then their own after the first h.
    Returns the turns (conv_id, d, digest, words, last) and the conversations (conv_id, length)."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialise(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    first = turns.where(f"pos < {heads}").select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "digest", "words")
    head = convs.join(first, "base").where("d <= taken").select("conv_id", "d", "digest", "words", (F.col("d") == F.col("length")).alias("last"))
    tail = turns.join(convs, "conv_id").where("pos > h").withColumn("d", F.col("pos") - F.col("h") + F.col("taken"))
    return head.unionByName(tail.select("conv_id", "d", "digest", "words", (F.col("d") == F.col("length")).alias("last"))), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns: conv_id, d, digest, words, last. Adds k1, k2 (the prefix up to this turn) and p1, p2 (the one before it; 0, 0 for the root)."""
    keyed = turns.withColumn("t1", F.xxhash64("d", "digest")).withColumn("t2", F.xxhash64("digest", F.lit("prefix"), "d"))
    found = running(keyed, "conv_id", [F.col("d")], {"k1": ("xor", "t1"), "k2": ("xor", "t2")})
    before = lambda k, t: F.col(k).bitwiseXOR(F.col(t))
    return found.select("conv_id", "d", "words", "last", "k1", "k2", before("k1", "t1").alias("p1"), before("k2", "t2").alias("p2"))


def _subtries(table_: pa.Table) -> pa.Table:
    """The totals of every node of the tries in one bucket: children, leaves, words saved. Nodes whose parent is not in the bucket are tops."""
    columns = [table_.column(c).to_pylist() for c in ("k1", "k2", "p1", "p2", "own")]
    place = {key: i for i, key in enumerate(zip(columns[0], columns[1], strict=True))}
    pointers: list[dict] = [{} for _ in place]
    tops = []
    for i, (k1, k2, p1, p2) in enumerate(zip(*columns[:4], strict=True)):
        parent = place.get((p1, p2))
        if parent is None:
            tops.append(i)
        else:
            pointers[parent][k1 ^ p1, k2 ^ p2] = i  # the edge is the turn's own hash
    leaves, saved = [0] * len(place), list(columns[4])
    for top in tops:
        path = [(top, iter(pointers[top].values()))]
        while path:
            node, rest = path[-1]
            child = next(rest, None)
            if child is not None:
                path.append((child, iter(pointers[child].values())))
                continue
            path.pop()
            leaves[node] = leaves[node] or 1
            if path:
                above = path[-1][0]
                leaves[above] += leaves[node]
                saved[above] += saved[node]
    long = lambda x: pa.array(x, pa.int64())
    return pa.table({"k1": long(columns[0]), "k2": long(columns[1]), "n_children": long([len(p) for p in pointers]), "n_leaves": long(leaves), "saved_tokens": long(saved)})


_TOTALS = "k1 long, k2 long, n_children long, n_leaves long, saved_tokens long"


def _along_paths(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of the wanted nodes (k1, k2) by sums along the conversations that pass them: a turn saves its words unless its
    conversation is the smallest of its node, and a leaf counts on the path of its smallest conversation."""
    key = ["k1", "k2"]
    passing = rows.join(wanted, key, "left_semi").select("conv_id").distinct()
    facts = nodes.select(*key, F.col("conv_id").alias("least"), (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    some = rows.join(passing, "conv_id", "left_semi").join(facts, key)
    some = some.select("conv_id", "d", *key, F.when(F.col("conv_id") == F.col("least"), F.lit(0)).otherwise(F.col("words")).alias("spare"), (F.col("last") & F.col("leaf") & (F.col("conv_id") == F.col("least"))).cast("long").alias("end_leaf"))
    after = running(some, "conv_id", [F.col("d").desc()], {"saved": ("sum", "spare"), "leaves": ("sum", "end_leaf")})
    return after.join(wanted, key, "left_semi").groupBy(*key).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def node_totals(rows: DataFrame, nodes: DataFrame, most: int = 20_000, levels: int = 8) -> DataFrame:
    """Per node: k1, k2, n_children, n_leaves, saved_tokens."""
    key = ["k1", "k2"]
    open_, level, settled, tops = nodes, 1, [], []
    while True:
        at = rows.where(F.col("d") == level).select("conv_id", F.col("k1").alias("g1"), F.col("k2").alias("g2"))
        named = materialise(open_.where(F.col("depth") >= level).join(at, "conv_id"), "trie_groups")
        sizes = named.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("saved_tokens"), F.sum((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("n_leaves"))
        large = materialise(sizes.where(F.col("n") > most), "large_groups")
        settled.append(named.join(large, ["g1", "g2"], "left_anti"))
        open_ = named.join(large.select("g1", "g2"), ["g1", "g2"], "left_semi").drop("g1", "g2")
        if level == levels or large.isEmpty():
            break
        tops.append(large.select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "n_leaves", "saved_tokens"))
        open_, level = open_.where(F.col("depth") > level), level + 1
    small = settled[0]
    for more in settled[1:]:
        small = small.unionByName(more)
    buckets = max(1, -(-4 * nodes.count() // most))  # a quarter of `most` on average, since one group may come on top
    bucket = F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)).alias("bucket")
    found = small.select(bucket, *key, "p1", "p2", "own").groupBy("bucket").applyInArrow(_subtries, _TOTALS)
    if not large.isEmpty():
        tops.append(_along_paths(rows, nodes, materialise(open_.select(*key), "deep_nodes")))
    if tops:
        above = tops[0]
        for more in tops[1:]:
            above = above.unionByName(more)
        children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
        found = found.unionByName(above.join(children, key, "left").select(*key, F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens"))
    return found


def ends_digests(members: DataFrame, chunk: int = 4096) -> DataFrame:
    """members: k1, k2, conv_id. Per (k1, k2) the SHA-256 of its ids in ascending order, joined by commas. Ranges of (key, id) are first joined to pieces of at most
    `chunk` ids; the pieces of a key then pass one task one after another, which keeps nothing but the digest's state."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.repartitionByRange(n, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")

    def pieces(batches):
        for batch in batches:
            out: list[tuple] = []
            last, ids = None, []
            for k1, k2, c in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "conv_id")), strict=True):
                if (k1, k2) != last or len(ids) == chunk:
                    if ids:
                        out.append((*last, ids[0], ",".join(map(str, ids))))
                    last, ids = (k1, k2), []
                ids.append(c)
            if ids:
                out.append((*last, ids[0], ",".join(map(str, ids))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "first", "ids"])

    def digest(batches):
        last, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, ids in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != last:
                    if state:
                        out.append((*last, state.hexdigest()))
                    last, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([state.hexdigest()])], ["k1", "k2", "ends_sha256"])

    found = ranged.mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return found.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, every: int = 20, heads: int = 4, most: int = 20_000, levels: int = 8) -> DataFrame:
    """Per node of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key, zero = ["k1", "k2"], F.lit(0).cast("long")
    turns = materialise(numbered(conversations), "turns")
    again, convs = rebuilt(turns, every, heads)
    rows = materialise(prefixes(again), "prefixes")
    remove(turns)
    grouped = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    nodes = materialise(grouped.withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    totals = node_totals(rows, nodes, most, levels)
    below = nodes.agg(F.sum((F.col("depth") == 1).cast("long")).alias("n_children"), F.sum((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("n_leaves"), F.sum("own").alias("saved_tokens"))
    # one row with the totals of the table beside one row with those of the nodes
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").join(below, how="cross")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).unionByName(root.select(zero.alias("p1"), zero.alias("p2"), F.col("conv_id").alias("parent_conv_id")))
    found = nodes.select(*key, "p1", "p2", "conv_id", "depth", "n_convs").join(totals, key).join(parents, ["p1", "p2"])
    every_node = found.select(*root.columns).unionByName(root)
    members = rows.where("last").select(*key, "conv_id").unionByName(convs.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    ended = every_node.join(ends_digests(members), key, "left")
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: crc32 by its definition: for each byte an exclusive or, then eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(g ORDER BY turn NULLS FIRST, role, g) AS g, list(words ORDER BY turn NULLS FIRST, role, g) AS words FROM t GROUP BY conv_id),
h AS (SELECT *, ({_CRC}) % 4 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.g[1:h], []), h.g[h + 1:]) AS g, list_concat(coalesce(b.words[1:h], []), h.words[h + 1:]) AS words
  FROM (SELECT * FROM h) h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, array_to_string(g[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(g[1:d - 1], ',') END AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(g) AS last, list_transform(range(0, d + 1), lambda i: array_to_string(g[1:i], ',')) AS path
  FROM (SELECT *, unnest(range(0, len(g) + 1)) AS d FROM r)),
n AS (SELECT k, d AS depth, min(conv_id) AS conv_id, any_value(up) AS up, any_value(path) AS path, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE last) AS ends FROM p GROUP BY k, d),
c AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT a AS k, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves FROM (SELECT unnest(path) AS a, own, n_children FROM n LEFT JOIN c USING (k)) GROUP BY a)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN c USING (k) LEFT JOIN n q ON q.k = n.up
"""
