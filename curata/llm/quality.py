"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, a kind of bad text, or abstain on each whole text. Expectation-maximisation over the counts of
all vote patterns (a table of at most 3 ** 13 rows, whatever the corpus) estimates each labeller's confusion with the hidden
class (good, or one of the kinds of bad text) and the class shares; the posterior of good labels the documents. A hashed linear scorer is then trained on the posteriors of a bounded sample
(`sample` documents, the ones with the smallest hash of doc_id: a documented parameter) and decides for every document.

Two labellers count words of a lexicon of abuse. It is learnt at run time, where `labels` are given, from a bounded sample of labelled rows
(`labelled` of them, smallest hash of doc_id first): the words, cut to `PREFIX` bytes, that stand in several toxic documents and at a
much higher rate there than elsewhere (`learn_lexicon` states the test). Without labels the lexicon is empty and only general insults count.

Features of the scorer are hashes of words, of their first bytes, of word shapes, and of the votes; `vote_features=False` leaves the votes out.

Defined results: null and empty texts and texts of white space have no words, a score of 0 and are rejected; texts of any length are read
whole; repeated rows are judged alike; an empty table gives an empty result; extra columns are ignored by `judge` and carried through by `kept_rows`;
labels of unknown documents, null ids and null marks teach nothing, and of labels that repeat a doc_id any toxic one counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import fresh, hash_spans, lower_bytes, materialise, table, word_spans

GOOD, SYMBOLS, SHOUT, MENU, REPEAT, TOXIC, ABSTAIN = range(7)
CLASSES = ABSTAIN
#: Frequent function words of English, French, Spanish and German, and general insults.
STOP_WORDS = "the of and to in is that it was for on are as with be by this at from or an a de la le les et un une des du que qui en est dans pour sur par pas au aux ne se el los las y del con para su una lo es al der die das und den von zu mit sich auf für ist im dem nicht ein eine".split()
INSULTS = "idiot moron stupid trash scum loser clown pathetic worthless disgusting".split()
LABELLERS = ("symbols", "symbol_bytes", "shouting", "exclaiming", "menus", "menu_lines", "repetition", "runs", "variety", "function_words", "insults", "abuse", "much_abuse")
BITS, PREFIX = 16, 6


def _hashes(words: list[str]) -> np.ndarray:
    joined = " ".join(words).encode()
    return np.sort(hash_spans(*word_spans(joined)))


_STOP, _BAD = _hashes(STOP_WORDS), _hashes(INSULTS)
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]*$#%&|-")] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"*$#%&|~^=+<>@_{}\\")] = True


def _among(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which words are in a short sorted table."""
    if not len(table):
        return np.zeros(len(words), bool)
    return table[np.minimum(np.searchsorted(table, words), len(table) - 1)] == words


def _trimmed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ends of words without up to four closing marks."""
    cut = ends.copy()
    for _ in range(4):
        cut = cut - ((cut - 1 > starts) & _TRIM[raw[cut - 1]])
    return cut


def prefixes(low: np.ndarray, starts: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Hashes of the words' first PREFIX bytes, lower case."""
    return hash_spans(low, starts, np.minimum(starts + PREFIX, cut))


def look(text: str | None, lexicon: np.ndarray, wanted: bool = True) -> tuple[int, list[int], np.ndarray]:
    """Number of words, the votes, and the feature numbers of a whole text: those of its votes, then distinct ones of words and shapes
    (none unless wanted). lexicon: sorted hashes of prefixes that mark abuse."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw, starts, ends = word_spans(data)
    n = len(starts)
    if not n:
        return 0, [ABSTAIN] * len(LABELLERS), np.zeros(0, np.int64)
    low = np.frombuffer(data.lower(), np.uint8)
    cut = _trimmed(raw, starts, ends)
    words, heads = hash_spans(low, starts, cut), prefixes(low, starts, cut)
    last, before = raw[ends - 1], raw[np.maximum(ends - 2, starts)]
    symbols = ((last == before) & _SYMBOL[last] & (ends - starts > 1)).mean()
    letters_up = int(((raw >= 65) & (raw <= 90)).sum())
    letters = letters_up + int(((raw >= 97) & (raw <= 122)).sum())
    shout = letters_up / max(letters, 1)
    exclaim = ((last == 33) & (before == 33)).mean()
    menu = ((ends - starts == 1) & (raw[starts] == 124)).mean()
    repeat = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
    same = np.concatenate(([False], words[1:] == words[:-1], [False]))
    inner = same[1:-1]
    runs = (inner[1:] & inner[:-1]).mean() if n > 2 else 0.0
    lines = data.count(b"\n") + 1
    bars = data.count(b" | ") / lines
    few = 30 <= n < 400 and len(np.unique(words)) / n < 0.2
    stops = _among(words, _STOP).mean()
    insults, abuse = int(_among(words, _BAD).sum()), int(_among(heads, lexicon).sum())
    grade = lambda x, bad_from, good, kind: kind if x >= bad_from else GOOD if x <= good else ABSTAIN
    votes = [
        grade(symbols, 0.2, 0.05, SYMBOLS),
        grade(_SYMBOL[raw[raw != 124]].sum() / len(raw), 0.08, 0.02, SYMBOLS),
        grade(shout, 0.3, 0.15, SHOUT) if letters >= 20 else ABSTAIN,
        grade(exclaim, 0.2, 0.05, SHOUT),
        grade(menu, 0.1, 0.03, MENU),
        grade(bars, 1.5, 0.2, MENU),
        grade(repeat, 0.25, 0.1, REPEAT) if n >= 8 else ABSTAIN,
        grade(runs, 0.15, 0.03, REPEAT) if n >= 8 else ABSTAIN,
        REPEAT if few else ABSTAIN,
        GOOD if n >= 20 and stops >= 0.1 and symbols < 0.05 else ABSTAIN,
        TOXIC if insults / n >= 0.004 else ABSTAIN,
        TOXIC if abuse >= 2 and abuse / n >= 0.01 else GOOD if not abuse and n >= 20 else ABSTAIN,
        TOXIC if abuse >= 3 and abuse / n >= 0.02 else ABSTAIN,
    ]
    if not wanted:
        return n, votes, np.zeros(0, np.int64)
    shapes = hash_spans(_SHAPE[raw], np.maximum(starts, ends - 4), ends)
    marks = np.array([(k * 8 + v + 1) * 0x9E3779B97F4A7C15 % 2**64 for k, v in enumerate(votes)], np.uint64)
    numbers = lambda x: (x >> np.uint64(64 - BITS)).astype(np.int64)
    return n, votes, np.concatenate((numbers(marks), np.unique(numbers(np.concatenate((words, heads ^ np.uint64(0xAAAA), shapes ^ np.uint64(0x5555)))))))


def _fired(vote: np.ndarray) -> np.ndarray:
    return vote[..., None] == np.arange(CLASSES + 1)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over distinct vote patterns (rows) and their counts. Returns the posterior of each pattern, class shares, and confusion
    [labeller, class, vote]. It starts from the votes: a class that any labeller names beats good."""
    fired = _fired(patterns)[:, :, :CLASSES]  # an abstention says nothing
    ballots = fired.sum(1).astype(float)
    ballots[:, 1:] *= 4 * patterns.shape[1]
    post = (ballots + 0.05) / (ballots + 0.05).sum(1, keepdims=True)
    for _ in range(rounds):
        weight = post * counts[:, None]
        share = (weight.sum(0) + prior) / (weight.sum() + CLASSES * prior)
        confusion = np.einsum("pc,plv->lcv", weight, fired) + prior
        confusion /= confusion.sum(2, keepdims=True)
        log = np.log(share) + np.einsum("plv,lcv->pc", fired, np.log(confusion))
        after = np.exp(log - log.max(1, keepdims=True))
        after /= after.sum(1, keepdims=True)
        moved = np.abs(after - post).max(initial=0)
        post = after
        if moved < 1e-7:
            break
    return post, share, confusion


def _scale(n: int, vote_features: bool) -> np.ndarray:
    """Values of n features: 1 for each vote, or 0 where votes are left out; those of words share a length of 1."""
    out = np.full(n, 1 / np.sqrt(max(n - len(LABELLERS), 1)), np.float32)
    out[: len(LABELLERS)] = vote_features
    return out


def fit_scorer(features: list[np.ndarray], good: np.ndarray, epochs: int = 8, rate: float = 0.5, batch: int = 64, seed: int = 5, vote_features: bool = True) -> np.ndarray:
    """Logistic weights over 2 ** BITS hashed features and a bias; Adagrad on the posterior as a soft label."""
    size = 1 << BITS
    weights, squares = np.zeros(size + 1), np.full(size + 1, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            lengths = np.array([len(features[i]) for i in pick])
            flat = np.concatenate([features[i] for i in pick])
            scale = np.concatenate([_scale(n, vote_features) for n in lengths])
            owner = np.repeat(np.arange(len(pick)), lengths)
            z = np.bincount(owner, weights[flat] * scale, len(pick)) + weights[size]
            slope = 1 / (1 + np.exp(-z)) - good[pick]
            grad = np.bincount(flat, slope[owner] * scale, size + 1)
            grad[size] = slope.sum()
            squares += grad * grad
            weights -= rate * grad / np.sqrt(squares)
    return weights.astype(np.float32)


def score(weights: np.ndarray, features: np.ndarray, vote_features: bool = True) -> float:
    z = float(weights[features] @ _scale(len(features), vote_features)) + float(weights[-1])
    return float(1 / (1 + np.exp(-z)))


def learn_lexicon(docs: DataFrame, labels: DataFrame, labelled: int = 8000, ratio: float = 6.0, documents: int = 4, sure: float = 5.0, most: int = 4096) -> np.ndarray:
    """Sorted hashes of the prefixes that mark abuse, at most `most`, from at most `labelled` labelled documents. A prefix counts if it stands in at least `documents` toxic
    ones, at `ratio` times its rate per word elsewhere (with one occurrence added there) and if the shares of documents that hold it differ by `sure` standard errors."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    bound = known.select(order.alias("h")).orderBy("h").limit(labelled).agg(F.max("h")).first()[0]
    if bound is None:
        return np.zeros(0, np.uint64)
    marks = known.where(order <= bound)  # at most `labelled` rows but for equal hashes

    def count(batches):
        for batch in batches:
            for toxic in (0, 1):
                found, docs_, tokens = [], 0, 0
                for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    if (mark == 1) == bool(toxic):
                        data = lower_bytes(text)
                        raw, starts, ends = word_spans(data)
                        found.append(np.unique(prefixes(raw, starts, _trimmed(raw, starts, ends)), return_counts=True))
                        docs_, tokens = docs_ + 1, tokens + len(starts)
                if found:
                    h, each = (np.concatenate(c) for c in zip(*found, strict=True))
                    keys, place = np.unique(h, return_inverse=True)
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(n, toxic, np.int32)), pa.array(np.bincount(place, each, n).astype(np.int64)), pa.array(np.bincount(place, minlength=n).astype(np.int64))], ["h", "toxic", "tokens", "docs"])
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([toxic], pa.int32()), pa.array([tokens], pa.int64()), pa.array([docs_], pa.int64())], ["h", "toxic", "tokens", "docs"])

    rows = docs.select("doc_id", "text").join(marks, "doc_id").select("text", "toxic").mapInArrow(count, "h long, toxic int, tokens long, docs long")
    of = lambda c, mark: F.sum(F.when(F.col("toxic") == mark, F.col(c)).otherwise(0)).alias(f"{c}{mark}")
    sums = materialise(rows.groupBy("h").agg(*(of(c, k) for c in ("tokens", "docs") for k in (0, 1))), "lexicon")
    whole = sums.where("h is null").first()
    if whole is None or not whole.docs0 or not whole.docs1:
        return np.zeros(0, np.uint64)
    gap = F.col("docs1") / float(whole.docs1) - F.col("docs0") / float(whole.docs0)
    spread = F.sqrt((F.col("docs0") + F.col("docs1") + 1) / float(whole.docs0 + whole.docs1) * (1 / whole.docs0 + 1 / whole.docs1))
    more = (F.col("tokens1") / float(whole.tokens1)) / ((F.col("tokens0") + 1) / float(whole.tokens0 + 1))
    kept = sums.where("h is not null").where((F.col("docs1") >= documents) & (more >= ratio) & (gap / spread >= sure))
    found = kept.orderBy(F.desc(gap / spread), "h").limit(most).select("h").toArrow()
    return np.sort(np.asarray(found.column("h")).astype(np.int64).view(np.uint64))


def _votes(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [look(t, lexicon, wanted=False)[:2] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, v)) if n else None for n, v in found], pa.string())], ["votes"])

    return docs.select("text").mapInArrow(run, "votes string")


class Model:
    """Posteriors by vote pattern, labellers' confusion, class shares, the scorer's weights and the lexicon."""

    def __init__(self, posterior: dict, share, confusion, weights, lexicon, vote_features: bool = True):
        self.posterior, self.share, self.confusion, self.weights, self.lexicon, self.vote_features = posterior, share, confusion, weights, lexicon, vote_features


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = 6000, labelled: int = 8000, vote_features: bool = True) -> Model:
    lexicon = learn_lexicon(docs, labels, labelled) if labels is not None else np.zeros(0, np.uint64)
    counts = _votes(docs, lexicon).where("votes is not null").groupBy("votes").count().toArrow()
    names = counts.column("votes").to_pylist()
    if not names:
        return Model({}, np.ones(CLASSES) / CLASSES, None, np.zeros((1 << BITS) + 1, np.float32), lexicon, vote_features)
    order = np.argsort(names)
    names = [names[i] for i in order]
    patterns = np.array([[int(c) for c in v] for v in names])
    post, share, confusion = fit_labellers(patterns, np.asarray(counts.column("count"), float)[order])
    posterior = {v: float(p[GOOD]) for v, p in zip(names, post, strict=True)}
    # the ids with the smallest hashes, then their rows: whole texts are never sorted; a doc_id that repeats is drawn once
    hashes = F.xxhash64("doc_id")
    bound = docs.select(hashes.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]

    def run(batches):
        for batch in batches:
            found = [(h, *look(t, lexicon)) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            found = [x for x in found if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array(["".join(map(str, x[2])) for x in found], pa.string()), pa.array([x[3].astype(np.int32).tobytes() for x in found], pa.binary())], ["h", "votes", "features"])

    drawn = docs.where(hashes <= bound).select(hashes.alias("h"), "text").mapInArrow(run, "h long, votes string, features binary")
    drawn = drawn.groupBy("h").agg(F.min(F.struct("votes", "features")).alias("x")).select("h", "x.*")
    got = materialise(drawn, "quality_sample").toArrow().sort_by("h")  # at most `sample` rows
    features = [np.frombuffer(f, np.int32).astype(np.int64) for f in got.column("features").to_pylist()]
    good = np.array([posterior.get(v, 0.5) for v in got.column("votes").to_pylist()])
    weights = fit_scorer(features, good, vote_features=vote_features) if features else np.zeros((1 << BITS) + 1, np.float32)
    return Model(posterior, share, confusion, weights, lexicon, vote_features)


def judge(docs: DataFrame, model: Model | None = None, labels: DataFrame | None = None, threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """Per row: doc_id (or all columns), n_words, votes, posterior, score, kept."""
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.posterior, model.weights, model.lexicon, model.vote_features))  # at most 3 ** 13 patterns, 2 ** BITS weights and 4096 prefixes
    base = docs if keep_columns else docs.select("doc_id", "text")
    out_names = [fresh(docs, c) for c in ("n_words", "votes", "posterior", "score", "kept")]
    columns = base.columns if keep_columns else ["doc_id"]
    kinds = ("long", "string", "double", "double", "boolean")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in columns), *(f"`{c}` {k}" for c, k in zip(out_names, kinds, strict=True))])

    def run(batches):
        posterior, weights, lexicon, vote_features = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                n, votes, features = look(text, lexicon)
                name = "".join(map(str, votes))
                value = score(weights, features, vote_features) if n else 0.0
                for k, x in enumerate((n, name, posterior.get(name) if n else None, value, value >= threshold)):
                    out[k].append(x)
            types = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], [*columns, *out_names])

    return base.mapInArrow(run, schema)


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the scorer keeps, with their columns."""
    judged = judge(docs, keep_columns=True, **options)
    return judged.where(F.col(judged.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), labels=table(spark, sf_dir, "labels"))
