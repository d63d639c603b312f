"""Near-duplicate documents by HyperMinHash, with links confirmed on full shingle sets.

Sketch: the hashes of a document's shingles are dealt over `buckets`; a bucket keeps the smallest hash as its count of leading zeros and the
`MANTISSA` bits after them (16 bits in all). Registers are cut into bands; documents that agree on a band are candidates. Beside the registers
stands an odd sketch: `ODD_BITS` bits, each the parity of the number of shingles dealt to it. A candidate pair is dropped where its sketches rule it
out: the share of buckets whose registers agree, corrected for agreement by chance, estimates the Jaccard similarity, and a pair goes where that many agreeing buckets
or fewer have a chance below `MISS` at the threshold; of the rest, shingles of both documents cancel out of the odd sketches, so these differ in at most as many bits
as there are shingles that one document lacks, and more differing bits than a pair at the threshold can have differing shingles decide it without loss.
Every other pair is confirmed on the shingle sets of the whole texts.

Documents with equal shingle sets form one class and only one of them goes on. Inside a band the members are first compared
with one hub each, so that a group of near copies costs one comparison per member; then, in `hub_rounds` rounds, the members of bands that still
hold several components are compared with another hub, a band no longer once its members have all met. What is left is compared by sketch in blocks of bounded size, each pair only in the
first band that both share, and of the pairs that pass a block returns those of a spanning forest of its components; once these are confirmed or refuted,
blocks with untested pairs are asked again for four times as many, until no untested pair joins two components. So confirmed links stay
linear in the members, and a pair is left unconfirmed only where its documents already have the same component, which is all that the result says of it.

Defined results: null and empty texts and texts of white space have no shingles and link with nothing; a text with fewer words than a shingle has the whole
sequence as its one shingle; whole texts of any length are read; rows with equal texts fall in one class; rows that repeat a doc_id with other texts are
documents of their own; a null doc_id links with nothing and stays; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import fresh, hash_spans, lower_bytes, materialise, mix, remove, table, word_spans
from curata.llm.components import components

MANTISSA, EMPTY, ODD_BITS = 10, 0xFFFF, 2048
#: The chance with which the estimate may drop a pair at the threshold.
MISS = 1e-9
_ODD = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = hash_spans(*word_spans(lower_bytes(text)))
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        k = min(n, width)
        total = np.full(n - k + 1, (k * 0x9E3779B97F4A7C15) % 2**64, np.uint64)
        for i in range(k):
            total += mix(words[i : n - k + 1 + i] * _ODD[i % 64] + np.uint64(i))
    return np.unique(mix(total))


def sketch(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """Registers: leading zeros and mantissa of the smallest hash of each bucket, EMPTY where none fell."""
    least = np.full(buckets, 2**64 - 1, np.uint64)
    bucket = ((shingles >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, bucket, mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)))
    used = np.zeros(buckets, bool)
    used[bucket] = True
    zeros = np.uint64(53) - np.frexp((least >> np.uint64(11)).astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(53))
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(used, (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16), np.uint16(EMPTY))


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """ODD_BITS parities, packed in bytes: of how many shingles fell on each bit."""
    at = (mix(shingles ^ np.uint64(0x3C3C3C3CC3C3C3C3)) >> np.uint64(32)) % np.uint64(ODD_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=ODD_BITS).astype(np.uint8) & 1)


def odd_differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits odd sketches differ: never more than the shingles that only one of the two documents has."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(-1, dtype=np.int64)


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band that holds a register; the key depends on the band's number."""
    return all_band_keys(registers, bands)[_used(registers.reshape(bands, -1))]


def _used(rows: np.ndarray) -> np.ndarray:
    return (rows != EMPTY).any(-1)


def all_band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """The keys of all bands, empty ones too; of one document or of one in each row."""
    rows = registers.reshape(*registers.shape[:-1], bands, -1)
    with np.errstate(over="ignore"):
        keys = mix((rows.astype(np.uint64) + np.uint64(1)) * _ODD[: rows.shape[-1]])
        keys = mix(keys.sum(-1) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def first_shared(one: np.ndarray, others: np.ndarray, bands: int) -> np.ndarray:
    """The number of the first band that holds a register and is equal in `one` and in each row of `others`; -1 for none."""
    mine, rows = one.reshape(bands, -1), others.reshape(len(others), bands, len(one) // bands)
    same = (rows == mine).all(2) & _used(mine)
    return np.where(same.any(1), same.argmax(1), -1)


@lru_cache(4096)
def chance_collision(n: int, m: int, buckets: int) -> float:
    """Probability that a bucket's registers agree for disjoint sets of about n and m elements."""
    zeros = np.arange(54, dtype=np.float64)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(2**MANTISSA)[None, :] / 2**MANTISSA)
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    holds = [np.exp(-x / buckets * low) - np.exp(-x / buckets * high) for x in (n, m)]
    either = 1 - math.exp(-(n + m) / buckets)
    return float((holds[0] * holds[1]).sum() / either) if either > 0 else 0.0


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of sketches (a row each) of sets of n and m shingles, corrected for agreement by chance, and how many buckets each rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    seen = used.sum(-1)
    grid = lambda x: np.rint(4 * np.log2(np.maximum(x, 1))).astype(np.int64)
    kinds, which = np.unique(grid(n) * 1024 + grid(m), return_inverse=True)
    size = lambda g: round(2 ** (int(g) / 4))
    chance = np.array([chance_collision(size(k // 1024), size(k % 1024), a.shape[-1]) for k in kinds])[which]
    share = (used & (a == b)).sum(-1) / np.maximum(seen, 1)
    return np.where(seen > 0, (share - chance) / (1 - chance), 0.0), seen


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """The estimate of one pair."""
    return float(estimates(a[None], b[None], np.array([n]), np.array([m]))[0][0])


@lru_cache(8)
def least_agreeing(buckets: int, percent: int) -> np.ndarray:
    """For each number of used buckets: the least number of agreeing ones that a pair at the threshold keeps, but for a chance of MISS. Buckets are taken as
    independent; they are drawn without replacement, which only narrows the spread."""
    t, out = percent / 100, np.zeros(buckets + 1)
    for seen in range(1, buckets + 1):
        k = np.arange(seen + 1)
        ways = math.lgamma(seen + 1) - np.array([math.lgamma(x + 1) + math.lgamma(seen - x + 1) for x in k])
        below = np.cumsum(np.exp(ways + k * math.log(t) + (seen - k) * math.log(1 - t)) if t < 1 else (k == seen).astype(float))
        out[seen] = (below <= MISS).sum()
    return out


def most_differing(n, m, percent: int):
    """Most shingles that one of two documents with sets of n and m can lack at the threshold: the union holds at most
    (n + m) / (1 + t), of which the share 1 - t differs."""
    return (n + m) * (100 - percent) // (100 + percent)


def sketches(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, two hashes of the set, registers, odd sketch."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                out[0].append(len(s))
                with np.errstate(over="ignore"):
                    for k, salt in ((1, 0x1234567), (2, 0x89ABCDEF)):
                        out[k].append(int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)))
                out[3].append(sketch(s, buckets).tobytes() if len(s) else None)
                out[4].append(odd_sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.binary()) for x in out[3:])], ["doc_id", "text_hash", "n_shingles", "h1", "h2", "registers", "odd"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, registers binary, odd binary")


def _stack(column, dtype) -> np.ndarray:
    """A binary column of equal lengths as rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _may_reach(sizes_a, sizes_b, regs_a, regs_b, odd_a, odd_b, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may reach the threshold by their sketches, and how near to its bound each is (0: equal sketches)."""
    low, high = np.minimum(sizes_a, sizes_b), np.maximum(sizes_a, sizes_b)
    differ, most = odd_differ(odd_a, odd_b), most_differing(sizes_a, sizes_b, percent)
    fits = (100 * low >= percent * high) & (differ <= most)
    likely = np.flatnonzero(fits)
    if len(likely):
        x, y = (regs_a[likely] if regs_a.ndim == 2 else regs_a), (regs_b[likely] if regs_b.ndim == 2 else regs_b)
        found, seen = estimates(*np.broadcast_arrays(x, y), low[likely], high[likely])
        # half a bucket is left to the correction, which takes less than that from a pair at the threshold
        fits[likely] = found * seen + 0.5 >= least_agreeing(x.shape[-1], percent)[seen]
    return fits, differ / (most + 1)


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by their sketches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = [np.asarray(batch.column(c)) for c in ("na", "nb")]
                fits, _ = _may_reach(*sizes, *(_stack(batch.column(c), np.uint16) for c in ("ra", "rb")), *(_stack(batch.column(c), np.uint8) for c in ("oa", "ob")), percent)
                yield batch.filter(pa.array(fits)).select(["a", "b"])

    side = lambda s: reps.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("registers").alias(f"r{s}"), F.col("odd").alias(f"o{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb", "oa", "ob").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. texts: (node, text) of candidates."""

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if last[0] != a:
                    last = (a, shingle_set(ta, width))
                x, y = last[1], shingle_set(tb, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"t{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _best_candidates(ids, parts, sizes, regs, odds, left, right, band: int, bands: int, percent: int, failed: set, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the pairs between two blocks that lie in different components and whose sketches allow a link: those of a spanning forest
    of the components, nearest sketches first, then further ones, at most `most` for a pair of components. Row numbers, scores, and
    how many such pairs there are. A pair counts only in the first band that its documents share, and not if it has failed."""
    found: list[tuple] = []
    for p in left:
        q = right[right > p] if left is right else right
        q = q[parts[q] != parts[p]]
        if not len(q):
            continue
        fits, score = _may_reach(sizes[q], sizes[p], regs[q], regs[p], odds[q], odds[p], percent)
        q, score = q[fits], score[fits]
        if len(q):
            here = first_shared(regs[p], regs[q], bands) == band
            found.append((np.full(int(here.sum()), p), q[here], score[here]))
    none = np.zeros(0, np.int64)
    x, y, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none.astype(float))
    if failed and len(x):
        fresh_ = np.array([(min(a, b), max(a, b)) not in failed for a, b in zip(ids[x].tolist(), ids[y].tolist(), strict=True)])
        x, y, score = x[fresh_], y[fresh_], score[fresh_]
    order = np.argsort(score, kind="stable")
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            c = up
        return c

    chosen, spare, seen = [], [], {}
    for k in order.tolist():
        u, v = sorted((int(parts[x[k]]), int(parts[y[k]])))
        if (ru := top(u)) != (rv := top(v)):
            root[max(ru, rv)] = min(ru, rv)
            chosen.append(k)
            seen[u, v] = seen.get((u, v), 0) + 1
        elif seen.get((u, v), 0) < most - 1:
            seen[u, v] = seen.get((u, v), 0) + 1
            spare.append(k)
    chosen = np.array(chosen + spare[: len(chosen) * (most - 1)], np.int64)
    return x[chosen], y[chosen], score[chosen], len(x)


def classes(docs: DataFrame, width: int = 3, percent: int = 85, buckets: int = 192, bands: int = 32, block: int = 2048, hub_rounds: int = 3) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    rows = materialise(sketches(docs, width, buckets), "sketches")
    key = ["h1", "h2", "n_shingles"]
    filled = rows.where("doc_id is not null and n_shingles > 0")
    first = F.struct("doc_id", "text_hash")
    firsts = filled.groupBy(*key).agg(F.min(first).alias("rep")).select(*key, "rep.*").orderBy("doc_id", "text_hash")
    # numbered in the order of doc_id, and written once, so that node numbers are the same in every later read
    firsts = materialise(firsts.withColumn("node", F.monotonically_increasing_id()), "classes")
    of_node = firsts.select("doc_id", "text_hash", "node", *key)
    reps = filled.select("doc_id", "text_hash", *key, "registers", "odd").join(of_node, ["doc_id", "text_hash", *key])
    repeats = filled.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
    reps = reps.dropDuplicates(["node"]) if repeats else reps
    reps = materialise(reps.select("node", "doc_id", "text_hash", "n_shingles", "registers", "odd"), "reps")

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                registers = _stack(batch.column("registers"), np.uint16)
                used = _used(registers.reshape(len(registers), bands, -1))
                ids = np.repeat(np.asarray(batch.column("node")), used.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(all_band_keys(registers, bands)[used]), pa.array(ids, pa.int64())], ["key", "node"])

    banded = reps.select("node", "registers").mapInArrow(keys, "key long, node long")
    shared = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(banded.join(shared.select("key", "hub"), "key"), "members")
    candidates = reps.select("node", "doc_id", "text_hash").join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).join(candidates, ["doc_id", "text_hash"]).select("node", "text")
    texts = materialise(texts.dropDuplicates(["node"]) if repeats else texts, "texts")

    # each document with its smallest hub
    hubs = members.where("hub <> node").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    known = materialise(_likely(hubs, reps, percent), "known")
    links = materialise(_confirmed(known, texts, width, percent), "confirmed")
    labels = materialise(components(links).select("node", "component"), "labels")

    def merged(found: DataFrame) -> DataFrame:
        """The labels after the confirmed pairs found, which are first contracted to pairs of components."""
        nonlocal labels
        if not found.isEmpty():
            ends = found.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            moves = components(ends.select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).distinct()).select(F.col("node").alias("was"), F.col("component").alias("now"))
            old = labels.join(moves, labels["component"] == moves["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
            new = moves.join(labels.select(F.col("node").alias("was")), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
            before, labels = labels, materialise(old.unionByName(new), "labels")
            remove(before)
        return labels

    # bands that still hold several components: every member with one hub, another one each round; round k leaves no pair of
    # k + 2 members or fewer untested, so that only larger bands go on
    open_members = members.select("key", "node").withColumn("first", F.lit(None).cast("long")).withColumn("last", F.lit(None).cast("long"))
    spent = []
    for k in range(hub_rounds):
        named = _labelled(open_members, labels)
        order = F.xxhash64("node", "key")
        hub = F.min("node") if k == 0 else F.min_by("node", F.when((F.col("node") != F.col("first")) & (F.col("last").isNull() | (order > F.col("last"))), order))
        mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), hub.alias("hub"))
        mixed = mixed.where(f"low <> high and n > {k + 1}").select("key", "n", "hub")
        joined = named.select("key", "node", "first", "last").join(mixed, "key")
        state = joined.withColumn("first", F.coalesce("first", "hub")).withColumn("last", F.xxhash64("hub", "key") if k else F.lit(None).cast("long"))
        after = materialise(state.select("key", "node", "first", "last", "n", "hub"), "open")
        if k:
            remove(open_members)
        pairs = _cross(after.where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), labels)
        stars = materialise(_likely(pairs.join(known, ["a", "b"], "left_anti"), reps, percent), "stars")
        open_members = after.where(f"n > {k + 2}").select("key", "node", "first", "last")
        spent.append(stars)
        tested = stars.count()
        if tested:
            found = materialise(_confirmed(stars, texts, width, percent), "confirmed")
            merged(found)
            remove(found)
            known = known.unionByName(stars)
        # a round that tests few pairs merges few components: what is left goes to the blocks
        if 64 * tested < after.count():
            break

    # what is left inside a band across components, in blocks of bounded size; a block returns only while it has untested pairs
    named = _labelled(open_members.select("key", "node"), labels)
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")).where("low <> high")
    spread = named.select("key", "node").join(mixed.select("key", "blocks"), "key")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    one = spread.where("blocks = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "node")
    several = spread.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = materialise(one.unionByName(several.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")), "blocks")
    at = ["key", "i", "j"]
    out = "key long, i int, j int, a long, b long, ca long, cb long, score double, n long"
    failed, active, most = None, spread, 1

    def solver(most: int):
        def solve(place, group, lost=None):
            where = [k.as_py() for k in place]
            nothing = pa.schema([(n, pa.int32() if n in "ij" else pa.float64() if n == "score" else pa.int64()) for n in (c.split(" ")[0] for c in out.split(", "))])
            if not group.num_rows:
                return nothing.empty_table()
            ids, parts, sizes, own_ = (np.asarray(group.column(c)) for c in ("node", "component", "n_shingles", "own"))
            regs, odds = _stack(group.column("registers"), np.uint16), _stack(group.column("odd"), np.uint8)
            band = int(np.flatnonzero(all_band_keys(regs[0], bands) == where[0])[0])
            left = np.flatnonzero(own_ == where[1])
            right = left if where[1] == where[2] else np.flatnonzero(own_ == where[2])
            gone = set(zip(lost.column("a").to_pylist(), lost.column("b").to_pylist(), strict=True)) if lost is not None else set()
            x, y, score, n = _best_candidates(ids, parts, sizes, regs, odds, left, right, band, bands, percent, gone, most)
            a, b, m = ids[x], ids[y], len(x)
            swap = a > b
            columns = [np.full(m, w) for w in where] + [np.where(swap, b, a), np.where(swap, a, b), np.minimum(parts[x], parts[y]), np.maximum(parts[x], parts[y]), score, np.full(m, n)]
            return pa.table([pa.array(c, t.type) for c, t in zip(columns, nothing, strict=True)], schema=nothing)

        return lambda place, group: solve(place, group), lambda place, group, lost: solve(place, group, lost)

    while True:
        held = _labelled(active, labels).join(reps.select("node", "n_shingles", "registers", "odd"), "node")
        first_time, again = solver(most)
        grouped = held.groupBy(*at)
        found = grouped.applyInArrow(first_time, out) if failed is None else grouped.cogroup(failed.groupBy(*at)).applyInArrow(again, out)
        emitted = materialise(found, "candidates")
        best = Window.partitionBy("ca", "cb").orderBy("score", "a", "b")
        chosen = emitted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select(*at, "a", "b")
        chosen = materialise(chosen, "chosen")
        if chosen.isEmpty():
            break
        links = materialise(_confirmed(chosen.select("a", "b").join(known, ["a", "b"], "left_anti"), texts, width, percent), "confirmed")
        merged(links)
        tested = chosen.join(links, ["a", "b"], "left_anti").select(*at, "a", "b")
        failed = materialise(tested if failed is None else tested.unionByName(failed), "failed")
        more = emitted.groupBy(*at).agg(F.max("n").alias("n")).join(chosen.groupBy(*at).agg(F.count(F.lit(1)).alias("m")), at, "left").where("n > coalesce(m, 0)")
        active = materialise(active.join(more.select(*at), at, "left_semi"), "blocks")
        if active.isEmpty():
            break
        most *= 4
    for x in (texts, members, spread, reps, *spent):
        remove(x)

    # the smallest node of a component has its smallest doc_id
    names = firsts.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    named = firsts.select(*key, "node", "doc_id").join(labels.join(names, "component").select("node", "component_id"), "node", "left")
    named = named.select(*key, F.coalesce("component_id", "doc_id").alias("component_id"))
    result = rows.join(named, key, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    result = result.withColumn("component_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _cross(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose two documents are in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    return pairs.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, buckets: int = 200, bands: int = 40, **options) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns; rows that repeat a doc_id stay or go together."""
    key = fresh(docs, "near_id_")
    stay = classes(docs, width, percent, buckets, bands, **options).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay[key]), "left_semi")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), width=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(s) AS s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) d LEFT JOIN n USING (doc_id)
"""
