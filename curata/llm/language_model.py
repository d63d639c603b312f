"""Language-model scores: a gated recurrent network in numpy beside an exact unigram base.

Counts of all training words come from one distributed aggregation over whole texts (words are keyed by 64-bit hashes). The base score uses the
count of every word: counts of the `frequent` commonest words are broadcast (a bounded table), those of all other words are joined.

The network reads one of `CLASSES * WIDTH` slots per token (the commonest words, the end, and one slot for all other
words) and predicts the next by a class-factored softmax: first the slot's class, then the slot within it. A word without a slot of its own
has the probability of the other-words slot times its share by count among them, so that probabilities sum to 1. Training is
truncated backpropagation with Adam, on shards of training documents, each from shared parameters, which are then averaged, weighted by
tokens, in a distributed sum. There are `rounds` of this, each with other documents, and every training document gives gradients in one of them.
Documents lie end to end in parallel streams that are walked window by window; a window's last state is the next one's first, and each document starts from
no state, so documents are scored whole. Which documents make a shard follows from their ids and words, so scores do not depend on partitioning.

Defined results: null and empty texts have the end as their one token; texts of any length are scored whole; repeated rows get equal scores; a null doc_id
counts as the text "" for the split; with no training documents all counts are 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import hash_spans, lower_bytes, materialise, table, word_spans

CLASSES, WIDTH, HIDDEN = 32, 32, 16
SLOTS = CLASSES * WIDTH
OTHER, END = 0, np.uint64(0xE0D0E0D0E0D0E0D1)
SHAPES = {"inp": (SLOTS, 3 * HIDDEN), "rec": (HIDDEN, 3 * HIDDEN), "bias": (3 * HIDDEN,), "cw": (HIDDEN, CLASSES), "cb": (CLASSES,), "ww": (CLASSES, HIDDEN, WIDTH), "wb": (CLASSES, WIDTH)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(slot_counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Small random weights, and output biases that give the unigram distribution of the slots."""
    flat = np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32)
    p = unpack(flat)
    share = (slot_counts + 0.5).reshape(CLASSES, WIDTH)
    p["bias"][:], p["cb"][:], p["wb"][:] = 0, np.log(share.sum(1) / share.sum()), np.log(share / share.sum(1, keepdims=True))
    p["rec"][:] *= 3
    p["cw"][:] *= 0.3
    p["ww"][:] *= 0.3
    return flat


def unroll(p: dict, h: np.ndarray, x: np.ndarray, carry: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The gated recurrence over a window. h: (HIDDEN, streams) before it; x: (steps, streams) slots read; carry: (steps, 1, streams), 0 where
    a document starts. Returns the state after the window and (steps, HIDDEN, streams) the states before each step."""
    steps, streams = x.shape
    a = np.ascontiguousarray((p["inp"][x] + p["bias"]).transpose(0, 2, 1))
    before = np.empty((steps, HIDDEN, streams), a.dtype)
    gates = np.empty((steps, 2 * HIDDEN, streams), a.dtype) if keep is not None else None
    news, inner = (np.empty_like(before), np.empty_like(before)) if keep is not None else (None, None)
    rec, half = np.ascontiguousarray(p["rec"].T), a.dtype.type(0.5)
    for t in range(steps):
        h = np.multiply(h, carry[t], out=before[t])
        u = rec @ h
        g, un = u[: 2 * HIDDEN], u[2 * HIDDEN :]
        g += a[t, : 2 * HIDDEN]
        g *= half
        np.tanh(g, out=g)
        g *= half
        g += half
        n = g[HIDDEN:] * un
        n += a[t, 2 * HIDDEN :]
        np.tanh(n, out=n)
        if keep is not None:
            gates[t], news[t], inner[t] = g, n, un
        h = h - n
        h *= g[:HIDDEN]
        h += n
    if keep is not None:
        keep += [before, gates, news, inner]
    return h, before


def _rows(v: np.ndarray) -> np.ndarray:
    """(steps, k, streams) as rows of k."""
    return np.ascontiguousarray(v.transpose(0, 2, 1)).reshape(-1, v.shape[1])


def _soft(logits: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln softmax of the picked column of each row, and the sums; logits become their exponentials."""
    np.minimum(logits, 60, out=logits)
    rows = np.arange(len(pick))
    chosen = logits[rows, pick]
    np.exp(logits, out=logits)
    total = logits.sum(1)
    return chosen - np.log(total), total


def slot_log_probabilities(p: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln P(target | state) of each row by the class-factored softmax, and with `grads` the loss gradients, added there, and that of the states."""
    rows = np.arange(len(targets))
    cls, within = targets // WIDTH, targets % WIDTH
    m = states @ p["cw"] + p["cb"]
    lp, total = _soft(m, cls)
    back = None
    if grads is not None:
        m /= total[:, None]
        m[rows, cls] -= 1
        grads["cw"] += states.T @ m
        grads["cb"] += m.sum(0)
        back = m @ p["cw"].T
    order = np.argsort(cls.astype(np.int16), kind="stable")
    counts = np.bincount(cls, minlength=CLASSES)
    ends = np.cumsum(counts)
    spans = [(c, slice(e - n, e)) for c, (e, n) in enumerate(zip(ends, counts, strict=True)) if n]
    hs, ws = states[order], within[order]
    for c, at in spans:
        np.matmul(hs[at], p["ww"][c], out=m[at])
        m[at] += p["wb"][c]
    inner, total = _soft(m, ws)
    lp[order] += inner
    if grads is not None:
        m /= total[:, None]
        m[rows, ws] -= 1
        further = np.empty_like(hs)
        for c, at in spans:
            grads["ww"][c] += hs[at].T @ m[at]
            grads["wb"][c] += m[at].sum(0)
            np.matmul(m[at], p["ww"][c].T, out=further[at])
        back[order] += further
    return lp, back


def backward(p: dict, kept: list, x: np.ndarray, carry: np.ndarray, dbefore: np.ndarray, grads: dict) -> None:
    """Truncated backpropagation through one window. kept: what `unroll` kept; dbefore: the output's gradient of the states before each step."""
    before, gates, news, inner = kept
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    fz, fn, fr = (before - news) * z * (1 - z), (1 - z) * (1 - news * news), inner * r * (1 - r)
    da, du = np.empty((len(x), 3 * HIDDEN, x.shape[1]), before.dtype), np.empty((len(x), 3 * HIDDEN, x.shape[1]), before.dtype)
    dh = np.zeros_like(before[0])
    for t in range(len(x) - 1, -1, -1):
        dn = dh * fn[t]
        np.multiply(dh, fz[t], out=da[t, :HIDDEN])
        np.multiply(dn, fr[t], out=da[t, HIDDEN : 2 * HIDDEN])
        da[t, 2 * HIDDEN :] = dn
        du[t, : 2 * HIDDEN] = da[t, : 2 * HIDDEN]
        np.multiply(dn, r[t], out=du[t, 2 * HIDDEN :])
        dh = dh * z[t]
        dh += p["rec"] @ du[t]
        dh += dbefore[t]
        dh *= carry[t]
    grads["rec"] += _rows(before).T @ _rows(du)
    d = _rows(da)
    grads["bias"] += d.sum(0)
    slots = x.ravel()
    order = np.argsort(slots.astype(np.int16), kind="stable")
    slots = slots[order]
    heads = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
    grads["inp"][slots[heads]] += np.add.reduceat(d[order], heads, axis=0)


class Streams:
    """Documents laid end to end in parallel streams, whole documents to the least loaded stream, longest first; with a seed each
    stream's documents are shuffled. `windows` walks all streams side by side; the state is carried from window to window and starts anew with each document."""

    def __init__(self, sequences: list[np.ndarray], most: int, seed: int | None = None):
        lengths = np.array([len(s) for s in sequences])
        loads = [(0, k) for k in range(min(most, len(sequences)))]
        dealt: list[list[int]] = [[] for _ in loads]
        for i in np.argsort(-lengths, kind="stable").tolist():
            load, k = loads[0]
            dealt[k].append(i)
            heapq.heapreplace(loads, (load + int(lengths[i]), k))
        rng = np.random.default_rng(seed)
        dealt = [[own[i] for i in rng.permutation(len(own))] for own in dealt] if seed is not None else dealt
        dealt.sort(key=lambda own: -sum(int(lengths[i]) for i in own))
        self.order = np.array([i for own in dealt for i in own])
        self.flat = np.concatenate([sequences[i] for i in self.order]).astype(np.int64)
        self.begins = np.cumsum(lengths[self.order]) - lengths[self.order]
        self.length = np.array([sum(int(lengths[i]) for i in own) for own in dealt])

    def windows(self, steps: int):
        """Per window: places in `flat` and which are tokens, (steps, streams) each, the slots there and the carry."""
        first = np.zeros(len(self.flat), bool)
        first[self.begins] = True
        starts = np.cumsum(self.length) - self.length
        for t in range(0, int(self.length[0]), steps):
            alive = int(np.searchsorted(-self.length, -t, "left"))
            s = np.arange(t, min(t + steps, int(self.length[0])))[:, None]
            real = s < self.length[:alive]
            at = np.where(real, starts[:alive] + s, 0)
            yield at, real, self.flat[at], np.where(first[at], 0, 1).astype(np.float32)[:, None, :]


def score_sequences(p: dict, sequences: list[np.ndarray], streams: int = 1024, steps: int = 16) -> np.ndarray:
    """ln P of each whole sequence."""
    laid = Streams(sequences, streams)
    lp, h = np.empty(len(laid.flat), np.float64), np.zeros((HIDDEN, len(laid.length)), p["inp"].dtype)
    for at, real, x, carry in laid.windows(steps):
        h, before = unroll(p, np.ascontiguousarray(h[:, : x.shape[1]]), x, carry)
        real = real.ravel()
        lp[at.ravel()[real]] = slot_log_probabilities(p, _rows(before)[real], x.ravel()[real])[0]
    out = np.empty(len(sequences))
    out[laid.order] = np.add.reduceat(lp, laid.begins)
    return out


def window_gradient(p: dict, h: np.ndarray, x: np.ndarray, carry: np.ndarray, real: np.ndarray, grads: dict) -> tuple[np.ndarray, float]:
    """Adds the loss gradients of one window to grads. Returns the state after it and the loss."""
    kept: list = []
    h, before = unroll(p, h, x, carry, kept)
    states, real = _rows(before), real.ravel()
    back = np.zeros_like(states)
    lp, back[real] = slot_log_probabilities(p, states[real], x.ravel()[real], grads)
    dbefore = np.ascontiguousarray(back.reshape(*x.shape, HIDDEN).transpose(0, 2, 1))
    backward(p, kept, x, carry, dbefore, grads)
    return h, -float(lp.sum(dtype=np.float64))


def train(flat: np.ndarray, sequences: list[np.ndarray], rate: float = 0.02, steps: int = 24, streams: int = 192) -> tuple[np.ndarray, int]:
    """Adam over windows of truncated backpropagation, the rate falling to a tenth. Returns parameters and tokens. The order of the sequences does
    not matter."""
    flat = flat.copy()
    p, grads_flat = unpack(flat), np.zeros(SIZE, np.float32)
    grads = unpack(grads_flat)
    first, second, updates, tokens, total = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0, 0, sum(map(len, sequences))
    laid = Streams(sorted(sequences, key=lambda s: (len(s), s.tobytes())), streams, seed=1)
    h = np.zeros((HIDDEN, len(laid.length)), np.float32)
    for _, real, x, carry in laid.windows(steps):
        grads_flat[:] = 0
        h, _ = window_gradient(p, np.ascontiguousarray(h[:, : x.shape[1]]), x, carry, real, grads)
        n = int(real.sum())
        tokens += n
        grads_flat /= n
        norm = float(np.sqrt(grads_flat @ grads_flat))
        if norm > 1:
            grads_flat /= norm
        updates += 1
        first += 0.1 * (grads_flat - first)
        second += 0.01 * (grads_flat * grads_flat - second)
        flat -= rate * (1 - 0.9 * tokens / total) * (first / (1 - 0.9**updates)) / (np.sqrt(second / (1 - 0.99**updates)) + 1e-8)
    return flat, tokens


# ---- distributed steps -----------------------------------------------------------------------


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end) and the number of tokens of each text."""
    parts = [lower_bytes(t) for t in texts]
    raw, starts, ends = word_spans(b"\n".join(parts))
    limits = np.cumsum([len(x) + 1 for x in parts])
    upto = np.searchsorted(starts, limits)
    lengths = np.diff(upto, prepend=0) + 1
    out = np.full(len(starts) + len(parts), END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(parts)), lengths - 1)] = hash_spans(raw, starts, ends)
    return out, lengths


def slices(texts: list, most: int = 1 << 18):
    """Consecutive ranges of about `most` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield texts[start : i + 1], start
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:], start


def count_words(training: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """training: text. (h, c): each word's hash and count; the end of a text counts as a word."""

    def run(batches):
        held, size = [], 0

        def sums():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])

        for batch in batches:
            for part, _ in slices(batch.column(0).to_pylist()):
                h, _ = token_hashes(part)
                held.append(h)
                size += len(h)
                if size >= flush:
                    yield sums()
                    held, size = [], 0
        if held:
            yield sums()

    return training.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The commonest words with their counts, and which of them have a slot."""

    BITS = 19

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        rank = np.arange(len(hashes))
        slot = np.where(rank < SLOTS - 1, rank + 1, OTHER)
        order = np.argsort(hashes)
        self.hashes, self.counts, self.slots = (np.append(v[order], 0) for v in (hashes, counts, slot.astype(np.int64)))
        # hashes are evenly spread, so the first bits of one say about where it stands
        self.starts = np.searchsorted(self.hashes[:-1], np.arange((1 << self.BITS) + 1, dtype=np.uint64) << np.uint64(64 - self.BITS), "left") if len(order) else None
        self.deepest = int(np.diff(np.append(self.starts[:-1], len(order))).max()) if len(order) else 0
        own = counts[: SLOTS - 1]
        self.slot_counts = np.zeros(SLOTS)
        self.slot_counts[1 : 1 + len(own)] = own
        self.slot_counts[OTHER] = max(tokens - own.sum(), 0)
        self.tokens, self.distinct = tokens, distinct
        self.other_total = tokens - int(own.sum()) + distinct - len(own) + 1

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each hash: whether it is in the table, its count there, its slot."""
        at = np.full(len(h), len(self.hashes) - 1)
        left = np.arange(len(h))
        first = self.starts[(h >> np.uint64(64 - self.BITS)).astype(np.int64)] if self.deepest else None
        for k in range(self.deepest):
            place = np.minimum(first[left] + k, len(self.hashes) - 2)
            same = self.hashes[place] == h[left]
            at[left[same]] = place[same]
            left = left[~same]
            if not len(left):
                break
        return at < len(self.hashes) - 1, self.counts[at], self.slots[at]


def _average(training: DataFrame, parameters: np.ndarray, shards: int, fan_in: int = 64) -> np.ndarray:
    """One round. training: shard, slots. Every shard trains from `parameters`; the results are averaged by tokens, at most `fan_in` at a time,
    each sum in the order of its shards, so that the same documents give the same numbers however they are partitioned."""
    spark = training.sparkSession
    start = spark.sparkContext.broadcast(parameters)  # SIZE numbers
    schema = "shard int, tokens long, sums binary"

    def run(key, group):
        found, tokens = train(start.value, [np.frombuffer(s, np.int16) for s in group.column("slots").to_pylist()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tokens": pa.array([tokens], pa.int64()), "sums": pa.array([(found.astype(np.float64) * tokens).tobytes()], pa.binary())})

    def add(key, group):
        group = group.sort_by("shard")
        total = np.zeros(SIZE)
        for one in group.column("sums").to_pylist():
            total += np.frombuffer(one)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tokens": pa.array([sum(group.column("tokens").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    sums = training.groupBy("shard").applyInArrow(run, schema)
    while shards > 1:
        shards = -(-shards // fan_in)
        sums = sums.withColumn("into", F.floor(F.col("shard") / fan_in).cast("int")).groupBy("into").applyInArrow(lambda key, group: add(key, group.drop_columns(["into"])), schema)
    got = sums.toArrow()
    start.unpersist()
    if not got.num_rows:
        return parameters
    return (np.frombuffer(got.column("sums")[0].as_py()) / got.column("tokens")[0].as_py()).astype(np.float32)


def score(docs: DataFrame, held_out, frequent: int = 1 << 17, rounds: tuple = (1, 4, 11), shard_tokens: int = 1 << 22) -> DataFrame:
    """docs: doc_id, text. held_out: a column that is true for documents not learned from. Per row: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score (log10). Training documents are dealt to the rounds in these proportions and, within a round, to shards
    of about `shard_tokens` tokens."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    counts = materialise(count_words(rows.where("not held_out")), "word_counts")
    tokens, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens = tokens or 0
    common = counts.orderBy(F.desc("c"), "h").limit(frequent).toArrow()
    vocabulary = Vocabulary(np.asarray(common.column("h")).astype(np.int64).view(np.uint64), np.asarray(common.column("c")).astype(np.int64), int(tokens), int(distinct))
    shared = spark.sparkContext.broadcast(vocabulary)  # at most `frequent` words
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def look_up(batches):
        v = shared.value
        whole = math.log(v.other_total)
        for batch in batches:
            for part, start_at in slices(batch.column("text").to_pylist()):
                h, lengths = token_hashes(part)
                found, c, slot = v.look_up(h)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                logs = np.log(c + 1.0)  # 0 for words outside the table
                known, base = np.add.reduceat((c > 0).astype(np.int64), begins), np.add.reduceat(logs, begins)
                extra = np.add.reduceat(np.where(slot == OTHER, logs - whole, 0), begins)
                owners = np.repeat(np.arange(len(part)), lengths)[~found]
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(len(part) + 1)), pa.int32()), pa.array(h[~found].view(np.int64)))
                small = slot.astype(np.int16)
                held = batch.slice(start_at, len(part))
                columns = [held.column("doc_id"), held.column("held_out"), pa.array(lengths, pa.int64()), pa.array(known), pa.array(base), pa.array(extra), rare, pa.array([small[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "extra", "rare", "slots"])

    known = rows.mapInArrow(look_up, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, extra double, rare array<long>, slots binary")
    known = materialise(known.withColumn("uid", F.monotonically_increasing_id()), "lm_tokens")
    parameters = initial(vocabulary.slot_counts)
    # a document's round and shard follow from its id and words alone
    lot = F.xxhash64(F.col("doc_id").cast("string"), "slots")
    training = known.where("not held_out").select("slots", F.pmod(lot, F.lit(sum(rounds))).alias("turn"), F.shiftright(lot, 20).alias("lot"))
    for k, share in enumerate(rounds):
        shards = max(1, round(tokens * share / sum(rounds) / shard_tokens))
        mine = training.where((F.col("turn") >= sum(rounds[:k])) & (F.col("turn") < sum(rounds[: k + 1])))
        parameters = _average(mine.select(F.pmod("lot", F.lit(shards)).cast("int").alias("shard"), "slots"), parameters, shards)
    model = spark.sparkContext.broadcast(parameters)  # SIZE numbers

    def solve(batches):
        p = unpack(model.value)
        held, size = [], 0

        def scored():
            sums = score_sequences(p, [np.frombuffer(s, np.int16) for b in held for s in b.column("slots").to_pylist()])
            at = 0
            for b in held:
                yield b.drop_columns(["slots"]).append_column("ln_score", pa.array(sums[at : at + b.num_rows]))
                at += b.num_rows

        for batch in batches:
            # whole documents side by side, until there are enough of them or the batch is over
            sizes = np.cumsum(batch.column("n_tokens"))
            cuts = np.unique(np.searchsorted(sizes, np.arange(1, int(sizes[-1]) // 2_000_000 + 1) * 2_000_000).clip(0, batch.num_rows)) if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += int(sizes[b - 1] - (sizes[a - 1] if a else 0))
                    if size >= 4_000_000:
                        yield from scored()
                        held, size = [], 0
        if held:
            yield from scored()

    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "extra"]
    full = known.select(*names, "slots").mapInArrow(solve, f"uid long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, extra double, ln_score double")
    rare = known.select("uid", F.explode("rare").alias("h"))
    joined = rare.join(counts, "h").groupBy("uid").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.ln(F.col("c") + 1)).alias("more"))
    full = full.join(joined, "uid", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    ten, whole = math.log(10), math.log(tokens + distinct + 1)
    return full.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), ((F.col("base") + F.col("more") - F.col("n_tokens") * whole) / ten).alias("base_score"), ((F.col("ln_score") + F.col("extra") + F.col("more")) / ten).alias("score"))


def split_seven(doc_id):
    """Held out: crc32 of the doc_id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), split_seven(F.col("doc_id")))
