"""Ranked lexical search over a clustered index whose documents are reordered by recursive graph bisection.

Index. A first pass turns every document into its term hashes with frequencies. Recursive graph bisection is fitted on a bounded sample: the sampled documents are halved
again and again, and in each halving pairs of documents change sides while that lowers the summed logarithms of gaps in the terms' posting lists. Each halving leaves a
weight per term; every document of the corpus then descends the halvings by its terms to a cluster. Documents are range-partitioned by (cluster, lean of the last
halving), so that a crowded cluster is spread over many ranges, and each run of `shard` documents of a range becomes a shard: for each term of it one
row with its postings (place, score of the occurrence) and the largest such score. Every row of the corpus is indexed; the sample only shapes the order.

Search. The bound of a query on a shard is the sum of its terms' weights times their largest scores there. Each query visits the shards of the highest bounds first; then
those whose bound reaches its twentieth score so far, until none is left. A shard whose bound equals that score is visited too, since a tie may have a smaller doc_id. So
the result is exact, whatever the clusters are. Places are mapped back to doc_id inside the shard, where ties are broken by it.

Terms are compared by 64-bit hashes. Queries are a stated set, taken in blocks of `block` items, and so many passes over the visited shards are made.

Defined results: null and empty texts have no terms, do not count in N and are never found; rows that repeat a doc_id are separate documents; a null doc_id is ranked
behind others of equal score; rows that repeat an item_id are one item with the terms of all its rows; a null item_id is no item; items without a match give no rows; empty tables give
empty results; whole texts of any length are read; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import hash_spans, lower_bytes, materialise, mix, remove, table, text_of

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def term_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each term of a text, in order: runs of digits, letters (A-Z lower-cased) and anything beyond ASCII."""
    raw = np.frombuffer(lower_bytes(text), np.uint8)
    inside = np.concatenate(([False], _TERM[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return hash_spans(raw, edges[0::2], edges[1::2]).view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive pieces of an array as binary values."""
    offsets = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after another, and how many each row has."""
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), dtype), np.array([len(x) for x in found], np.int64) // np.dtype(dtype).itemsize


def forward(docs: DataFrame) -> DataFrame:
    """Per document with a term: doc_id, n (its terms with repeats), terms (int64, ascending), tfs (int32)."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                hashes = [term_hashes(t) for t in part.column("text").to_pylist()]
                found = [np.unique(h, return_counts=True) for h in hashes]
                has = np.array([len(h) > 0 for h in hashes])
                counts = np.array([len(t) for t, _ in found], np.int64)[has]
                joined = lambda i, t: np.concatenate([x[i] for x in found]).astype(t) if len(counts) else np.zeros(0, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(has)), pa.array([len(h) for h in hashes if len(h)], pa.int64()), _lists(joined(0, np.int64), counts), _lists(joined(1, np.int32), counts)], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


class Bisection:
    """Recursive graph bisection fitted on a sample of documents; `assign` brings any document to a cluster."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, docs: int, levels: int, rounds: int):
        """rows, terms: the postings of the sample, as numbers of documents and term hashes."""
        names, where, df = np.unique(terms, return_inverse=True, return_counts=True)
        useful = (df >= 2) & (2 * df <= 2 * max(docs - 1, 1))  # a term of one document or of all shapes no gap
        order = np.argsort(-df[useful], kind="stable")[: 1 << 14]
        self.terms = np.sort(names[useful][order])
        at = np.searchsorted(self.terms, terms)
        known = (at < len(self.terms)) & (self.terms[np.minimum(at, max(len(self.terms) - 1, 0))] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        rows, cols = rows[known], at[known]
        self.levels, width = levels, len(self.terms)
        self.weights = np.zeros((2**levels - 1, width), np.float32)
        sides = np.zeros(docs, np.int64)  # the node that each document is in, on its level
        for level in range(levels):
            for node in range(2**level):
                own = np.flatnonzero(sides == node)
                right = self._halve(rows, cols, own, docs, width, 2**level - 1 + node, rounds) if len(own) > 1 else np.zeros(len(own), bool)
                sides[own] = 2 * node + right

    def _halve(self, rows, cols, own, docs, width, node, rounds) -> np.ndarray:
        number = np.full(docs, -1, np.int64)
        number[own] = np.arange(len(own))
        inside = number[rows] >= 0
        r, c = number[rows[inside]], cols[inside]
        right = np.arange(len(own)) >= len(own) // 2
        sizes = np.array([len(own) // 2, len(own) - len(own) // 2], float)
        cost = lambda deg, n: deg * np.log2(n / (deg + 1))
        for _ in range(rounds):
            deg = [np.bincount(c[right[r] == s], minlength=width).astype(float) for s in (False, True)]
            gain = np.zeros(len(own))
            for side in (0, 1):
                a, b = deg[side], deg[1 - side]
                change = cost(a, sizes[side]) + cost(b, sizes[1 - side]) - cost(np.maximum(a - 1, 0), sizes[side]) - cost(b + 1, sizes[1 - side])
                mine = right[r] == bool(side)
                gain += np.bincount(r[mine], change[c[mine]], minlength=len(own))
            left_first, right_first = (np.flatnonzero(right == s)[np.argsort(-gain[right == s], kind="stable")] for s in (False, True))
            pairs = min(len(left_first), len(right_first))
            swap = gain[left_first[:pairs]] + gain[right_first[:pairs]] > 1e-9
            if not swap.any():
                break
            right[left_first[:pairs][swap]], right[right_first[:pairs][swap]] = True, False
        deg = [np.bincount(c[right[r] == s], minlength=width).astype(float) for s in (False, True)]
        self.weights[node] = np.log2((deg[1] + 1) / sizes[1]) - np.log2((deg[0] + 1) / sizes[0])
        return right

    def assign(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents with terms one after another, counts of them each: the cluster, and the lean of the last halving."""
        n = len(counts)
        node, lean = np.zeros(n, np.int64), np.zeros(n)
        if not len(self.terms):
            return node, lean
        rows, at = np.repeat(np.arange(n), counts), np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        rows, at = rows[known], at[known]
        for level in range(self.levels):
            lean = np.bincount(rows, self.weights[2**level - 1 + node[rows], at], minlength=n)
            node = 2 * node + (lean > 0)
        return node, lean


def fitted(forward_: DataFrame, sample: int = 2048, most_terms: int = 256, levels: int = 6, rounds: int = 12) -> Bisection:
    """Bisection fitted on the `sample` documents of smallest hash, at most `most_terms` terms of each (those of smallest hash): at most sample * most_terms postings reach the driver."""

    def few(batches):
        for batch in batches:
            terms = [np.frombuffer(t, np.int64) for t in batch.column("terms").to_pylist()]
            kept = [t[np.argsort(mix(t.view(np.uint64)))[:most_terms]] for t in terms]
            yield pa.RecordBatch.from_arrays([_lists(np.concatenate(kept) if kept else np.zeros(0, np.int64), np.array([len(k) for k in kept], np.int64))], ["terms"])

    chosen = forward_.select(F.xxhash64("doc_id", F.lit("sample")).alias("h"), "doc_id", "n", "terms").orderBy("h", "doc_id", "n").limit(sample).select("terms").mapInArrow(few, "terms binary")
    terms, counts = _joined(chosen.toArrow().column("terms"), np.int64)
    return Bisection(np.repeat(np.arange(len(counts)), counts), terms, len(counts), levels, rounds)


class Index:
    """postings: (shard, term, df, best, places, scores); documents: (shard, doc_ids); n_docs documents with a term."""

    def __init__(self, postings: DataFrame, documents: DataFrame, n_docs: int):
        self.postings, self.documents, self.n_docs = postings, documents, n_docs


def build(docs: DataFrame, shard: int = 2048, shards_per_range: int = 4, **fit) -> Index:
    """Index of all rows of docs: doc_id, text."""
    spark = docs.sparkSession
    rows = materialise(forward(docs), "forward")
    n_docs, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = spark.sparkContext.broadcast(fitted(rows, **fit))  # at most 2^levels * 16,384 weights

    def clustered(batches):
        for batch in batches:
            if batch.num_rows:
                cluster, lean = model.value.assign(*_joined(batch.column("terms"), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(lean), *(batch.column(c) for c in ("doc_id", "n", "terms", "tfs"))], ["cluster", "lean", "doc_id", "n", "terms", "tfs"])

    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // (shard * shards_per_range)), 1)
    dealt = rows.mapInArrow(clustered, "cluster long, lean double, doc_id long, n long, terms binary, tfs binary")
    dealt = dealt.repartitionByRange(ranges, "cluster", "lean", F.xxhash64("doc_id", "n")).sortWithinPartitions("cluster", "lean", "doc_id", "n").withColumn("part", F.spark_partition_id().cast("long") * F.lit(1 << 32))

    def blocks(held: list[pa.RecordBatch], name: int):
        whole = pa.Table.from_batches(held)
        terms, counts = _joined(whole.column("terms"), np.int64)
        tfs = _joined(whole.column("tfs"), np.int32)[0].astype(np.int64)
        m = 75 + (25 * n_docs * np.asarray(whole.column("n"), np.int64)) // total
        places = np.repeat(np.arange(len(counts)), counts)
        scores = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[places])
        order = np.argsort(terms, kind="stable")
        names, starts, df = np.unique(terms[order], return_index=True, return_counts=True)
        scores = scores[order]
        ids = pa.array([whole.column("doc_id").combine_chunks().to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), name)), pa.array(names), pa.array(df.astype(np.int64)), pa.array(np.maximum.reduceat(scores, starts)), _lists(places[order].astype(np.int32), df), _lists(scores.astype(np.int32), df), pa.nulls(len(names), pa.list_(pa.int64()))], wanted)
        yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())), ids], wanted)

    wanted = ["shard", "term", "df", "best", "places", "scores", "doc_ids"]

    def cut(batches):
        held, have, done = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, shard - have)
                held.append(part)
                have, at = have + part.num_rows, at + part.num_rows
                if have == shard:
                    yield from blocks(held, held[0].column("part")[0].as_py() + done)
                    held, have, done = [], 0, done + 1
        if held:
            yield from blocks(held, held[0].column("part")[0].as_py() + done)

    made = materialise(dealt.mapInArrow(cut, "shard long, term long, df long, best long, places binary, scores binary, doc_ids array<long>"), "index")
    remove(rows)
    return Index(made.where("doc_ids is null").drop("doc_ids"), made.where("doc_ids is not null").select("shard", "doc_ids"), n_docs)


def query_terms(items: DataFrame) -> DataFrame:
    """items: item_id, text. Per (item_id, term): how often the item has it."""

    def run(batches):
        for batch in batches:
            hashes = [np.unique(term_hashes(t), return_counts=True) for t in batch.column("text").to_pylist()]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(h) for h, _ in hashes]))
            joined = lambda i: np.concatenate([h[i] for h in hashes]) if hashes else np.zeros(0, np.int64)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(rows), pa.array(joined(0), pa.int64()), pa.array(joined(1), pa.int64())], ["item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.where("item_id is not null").select("item_id", text_of().alias("text")).mapInArrow(run, f"item_id {kind}, term long, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _scored(kind: str, top: int):
    """The best `top` documents of each (item) on one shard: its postings beside the (item_id, term, weight, least) that visit it."""
    schema = pa.schema([("item_id", pa.from_numpy_dtype(np.int64) if kind in ("bigint", "long") else pa.int32() if kind == "int" else pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(key, postings: pa.Table, visits: pa.Table) -> pa.Table:
        if not postings.num_rows or not visits.num_rows:
            return schema.empty_table()
        ids_at = postings.column("doc_ids").is_valid().to_pylist().index(True)
        ids = postings.column("doc_ids")[ids_at].as_py()
        terms = postings.column("term").to_pylist()
        places, scores = ([None if x is None else np.frombuffer(x, np.int32) for x in postings.column(c).to_pylist()] for c in ("places", "scores"))
        row = {t: i for i, t in enumerate(terms) if t is not None}
        order = np.array([i for i, _ in sorted(enumerate(ids), key=lambda x: (x[1] is None, x[1] or 0))])  # ties by doc_id, null last
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        by_item: dict = {}
        for item, term, weight, least in zip(*(visits.column(c).to_pylist() for c in ("item_id", "term", "weight", "least")), strict=True):
            by_item.setdefault(item, (least, []))[1].append((row[term], weight))
        out: tuple[list, list, list] = ([], [], [])
        for item, (least, wanted) in by_item.items():
            sums = np.zeros(len(ids), np.int64)
            for i, weight in wanted:
                sums[places[i]] += weight * scores[i].astype(np.int64)
            found = np.flatnonzero(sums >= max(least, 1))
            if len(found) > top:
                found = found[np.lexsort((rank[found], -sums[found]))[:top]]
            out[0].extend([item] * len(found))
            out[1].extend(ids[i] for i in found)
            out[2].extend(sums[found].tolist())
        return pa.table([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    return run


def search(index: Index, items: DataFrame, top: int = 20, first: int = 4, block: int = 1024) -> DataFrame:
    """Per item_id its `top` documents by score, above 0: item_id, rank, doc_id, score."""
    kind = items.schema["item_id"].dataType.simpleString()
    asked = materialise(query_terms(items), "query_terms")
    blocks = -(-asked.select("item_id").distinct().count() // block)
    best_of = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= top)
    empty = items.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        # the index's rows of the terms that are asked for; the text collection is not read again
        rows = materialise(index.postings.join(own.select("term").distinct(), "term", "left_semi"), "asked_postings")
        df = rows.groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * index.n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
        weighted = own.join(df, "term").select("item_id", "term", (F.col("times") * weight).alias("weight"))
        pairs = materialise(rows.select("shard", "term", "best").join(weighted, "term").select("shard", "item_id", "term", "weight", (F.col("weight") * F.col("best")).alias("most")), "query_shards")
        bounds = materialise(pairs.groupBy("item_id", "shard").agg(F.sum("most").alias("bound")).where("bound > 0"), "bounds")
        held = rows.withColumn("doc_ids", F.lit(None).cast("array<long>")).select("shard", "term", "places", "scores", "doc_ids")
        held = held.unionByName(index.documents.select("shard", F.lit(None).cast("long").alias("term"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("scores"), "doc_ids"))

        def visited(chosen: DataFrame) -> DataFrame:
            """chosen: item_id, shard, least. The best documents of these items on these shards."""
            seen = pairs.join(chosen, ["item_id", "shard"]).select("shard", "item_id", "term", "weight", "least")  # noqa: B023
            some = held.join(chosen.select("shard").distinct(), "shard", "left_semi")  # noqa: B023
            return some.groupBy("shard").cogroup(seen.groupBy("shard")).applyInArrow(_scored(kind, top), f"item_id {kind}, doc_id long, score long")

        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("bound").desc(), "shard"))
        start = materialise(bounds.withColumn("place", place).where(F.col("place") <= first).select("item_id", "shard", F.lit(1).cast("long").alias("least")), "first_visits")
        results = materialise(best_of(visited(start)).select("item_id", "doc_id", "score"), "best")
        seen = start.select("item_id", "shard")
        for share in (8, None):  # then the next eight times as many, then all that may still matter
            least = results.groupBy("item_id").agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).otherwise(F.lit(1)).cast("long").alias("least"))
            left = bounds.join(least, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).where("bound >= least").join(seen, ["item_id", "shard"], "left_anti")
            if share:
                left = left.withColumn("place", place).where(F.col("place") <= first * share)
            now = materialise(left.select("item_id", "shard", "least"), "visits")
            if now.isEmpty():
                break
            results = materialise(best_of(visited(now).unionByName(results)).select("item_id", "doc_id", "score"), "best")
            seen = seen.unionByName(now.select("item_id", "shard"))
        found = results if found is None else found.unionByName(results)
        remove(rows)
        remove(pairs)
    return best_of(empty if found is None else found).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, g WHERE t IN (SELECT t FROM q) GROUP BY t, n_docs),
s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))))::BIGINT AS score FROM q JOIN f USING (t) JOIN p USING (t), g GROUP BY item_id, doc_id)
SELECT item_id, place::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 20
"""
