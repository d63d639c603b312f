"""Search, conversation tries and decontamination against brute force and their edge cases; further cases of mixing, licences and MinHash."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from curata.llm import conversation_trie, decontamination, licences, minhash, mixing, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _ranked(docs, items):
    """{item: [(doc_id, score)]} by plain loops."""
    terms = [(i, TERM.findall(_lower(t))) for i, t in docs]
    counts = [(i, len(w), collections.Counter(w)) for i, w in terms if w]
    n_docs, total = len(counts), sum(n for _, n, _ in counts)
    df = collections.Counter(t for *_, c in counts for t in c)
    out = {}
    for item in {i for i, _ in items if i is not None}:
        asked = collections.Counter(t for i, text in items if i == item for t in TERM.findall(_lower(text)))
        found = []
        for i, n, c in counts:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                found.append((i, score))
        if found:
            out[item] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:20]
    return out


def test_search_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    groups = [[f"{g}{k}" for k in range(60)] for g in ("ä", "b", "C", "d")]
    docs = [(i, " ".join(rng.choice(groups[i % 4], rng.integers(1, 40)))) for i in range(400)]
    docs += [(1000 + i, "same words here, in many copies") for i in range(60)] + [(5000, None), (5001, ""), (5002, " .,;"), (None, "same words here, in many copies"), (7, "b1 b2 b3"), (6000, "long b1 " * 40000)]
    items = [(1, "B1 b2, b2 C3?"), (2, "same words"), (3, "nothing of that"), (4, None), (5, "d1 d2 ä3"), (5, "d9"), (None, "b1")]
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS shard", "3 AS terms"), spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS score")
    index = search.build(docs_, shard=16, sample=128, levels=3)
    assert index.documents.count() >= 25 and index.documents.selectExpr("sum(size(doc_ids)) AS n").first().n == index.n_docs == 463
    for block in (1024, 1):
        got = collections.defaultdict(list)
        for r in search.search(index, items_, first=1, block=block).orderBy("item_id", "rank").collect():
            got[r.item_id].append((r.doc_id, r.score))
        assert got == _ranked(docs, items)
    assert search.search(search.build(docs_.limit(0)), items_).count() == 0 and search.search(index, items_.limit(0)).count() == 0


def test_bisection_separates_languages():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 2, 300)
    rows = np.repeat(np.arange(300), 12)
    terms = np.where(np.repeat(kind, 12) == 1, 1000, 0) + rng.integers(0, 40, 3600)
    model = search.Bisection(rows, terms, 300, 2, 12)
    cluster, _ = model.assign(np.concatenate((np.arange(20), 1000 + np.arange(20))), np.array([20, 20]))
    assert cluster[0] // 2 != cluster[1] // 2  # the first halving tells them apart
    assert search.Bisection(np.zeros(0, int), np.zeros(0, int), 0, 2, 3).assign(np.arange(3), np.array([2, 1]))[0].tolist() == [0, 0]


def test_search_visits_few_shards_where_bounds_exclude_the_others(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"t{i % 8}x{k}" for k in rng.integers(0, 50, 30))) for i in range(1600)]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string"), shard=32, sample=800, levels=4)
    seen, own = [], search._scored
    acc = spark.sparkContext.accumulator(0)

    def spy(kind, top):
        run = own(kind, top)

        def counted(key, postings, visits):
            acc.add(len(set(visits.column("item_id").to_pylist())))
            return run(key, postings, visits)

        return counted

    monkeypatch.setattr(search, "_scored", spy)
    items = [(g, f"t{g}x1 t{g}x2 t{g}x3") for g in range(8)]
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string"), first=2).collect()
    seen = acc.value
    assert len(got) == 160 and seen < 0.6 * 8 * index.documents.count()


def _nodes(rows):
    """Trie nodes by plain loops. rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - c % 20, [])[:h] + mine[h:]
    members = collections.defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = set()
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(y[:-1] == x and y for y in members)]
        saved = sum((len(members[x]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(full[c]) == len(node)))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


@pytest.mark.parametrize(("most", "levels"), [(20_000, 8), (6, 8), (6, 2), (1, 1)])
def test_trie_against_plain_loops(spark, most, levels):
    rng = np.random.default_rng(2)
    rows = [(c, t, ["user", "assistant", None][t % 3], ["hi there", "a b c", "", None, f"t {c % 3}"][rng.integers(0, 5)]) for c in range(60) for t in range(rng.integers(1, 6))]
    rows += [(60, t, "user", f"deep {t}") for t in range(40)] + [(c, t, "user", f"deep {t}") for c in (61, 62, 63) for t in range(30)]
    rows += [(100, None, "user", "first"), (100, 5, None, None), (100, 5, None, None), (101, 0, "user", "x"), (None, 0, "user", "left out"), (120, 0, "u", "word " * 50000), (121, 0, "u", "word " * 50000)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS d", "2 AS words", "3 AS k1")
    found = [tuple(r) for r in conversation_trie.trie(conversations, most=most, levels=levels).collect()]
    wanted, n = _nodes(rows)
    assert len(found) == n and set(found) == wanted
    assert conversation_trie.trie(conversations.limit(0), most=most).count() == 0


def test_ends_digests_across_pieces(spark):
    members = spark.range(10_000).selectExpr("id % 2 AS k1", "0L AS k2", "id AS conv_id")
    got = {r.k1: r.ends_sha256 for r in conversation_trie.ends_digests(members.repartition(7), chunk=100).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 10_000, 2))).encode()).hexdigest() for k in (0, 1)}


def _hits(text, windows):
    w = TERM.findall(_lower(text))
    hit, met = set(), set()
    for window, items in windows.items():
        for i in range(len(w) - len(window) + 1):
            if tuple(w[i : i + len(window)]) == window:
                hit.update(range(i, i + len(window)))
                met.update(items)
    return w, hit, met


def test_decontamination_against_plain_loops(spark):
    rng = np.random.default_rng(7)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 4000, n))
    items = [(i, word(n)) for i, n in enumerate((30, 12, 10, 25, 40))] + [(10, "Three short words"), (11, "Solo"), (12, ""), (13, None), (None, word(15)), (3, word(11)), (14, items_ := word(10)), (15, items_)]
    docs = [(i, word(50) + ("; " + items[i % len(items)][1].upper() + "! " if i % 2 and items[i % len(items)][1] else " ") + word(20)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "?! ."), (103, "solo"), (103, "solo"), (104, "x " * 60000 + items[0][1]), (None, items[3][1]), (105, items[0][1] + ", " + items[0][1]), (105, "another text")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = TERM.findall(_lower(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].update([] if i is None else [str(i)])
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS hits", "3 AS k"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS window")
    wanted = collections.Counter()
    for i, t in docs:
        w, hit, met = _hits(t, windows)
        wanted[i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)] += 1
    for bound in (32 << 20, 0):
        assert collections.Counter(tuple(r) for r in decontamination.report(docs_, items_, broadcast_bytes=bound).collect()) == wanted
    left = decontamination.decontaminate(docs_, items_)
    assert left.columns == docs_.columns and collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(i for i, t in docs if not _hits(t, windows)[1])
    cut = collections.defaultdict(list)
    for r in decontamination.decontaminate(docs_, items_, "spans").collect():
        cut[r.doc_id].append(r.text)
    for i, t in docs:
        w, hit, _ = _hits(t, windows)
        texts = [TERM.findall(_lower(x)) for x in cut[i]]
        assert [x for k, x in enumerate(w) if k not in hit] in texts and (hit or t in cut[i])
    assert decontamination.report(docs_.limit(0), items_).count() == 0 and decontamination.report(docs_, items_.limit(0)).where("contaminated").count() == 0


def test_spans_leave_the_rest_as_it_was(spark):
    docs = spark.createDataFrame([(1, "  Keep this -- ONE two three! and that."), (2, "one, two three"), (3, "no hit (here)")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two THREE")], "item_id long, text string")
    assert {r.doc_id: r.text for r in decontamination.decontaminate(docs, items, "spans").collect()} == {1: "  Keep this -- ! and that.", 2: "", 3: "no hit (here)"}


def test_mixed_rows_take_each_row_of_its_own_source(spark):
    rows = [(1, "x y", "a"), (1, "p q", "b"), *[(10 + i, "w " * 3, "b") for i in range(40)], *[(60, "same text", "b")] * 7, (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS part", "3 AS copies", "4 AS text_hash")
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r.source] += r.copies
    assert collections.Counter((r.doc_id, r.source) for r in mixing.mixed_rows(docs).collect()) == +plan


def test_ranges_of_a_mix_are_even_for_any_script(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('漢字', 30 + id % 5) AS text", "'one' AS source")
    seen = []
    kept, own = [], mixing.materialise
    try:
        mixing.materialise = lambda df, name: (kept.append(own(df, name)), kept[-1])[1]
        mixing.mix(docs).count()
    finally:
        mixing.materialise = own
    seen = [r["count"] for r in kept[-1].groupBy("part").count().collect()]
    assert len(seen) > 32 and max(seen) < 5 * sum(seen) / len(seen)


def test_licences_read_pieces_whole(spark):
    blanks = " " * 1908
    texts = [f"Released under the MIT License{blanks}is what this file is not", f"Released under{blanks}the MIT License", "the foo bar\n" * 100_000 + "Released under the\n MIT License", "# Licensed\n#under CC BY\n# 4.0"]
    got = {r.doc_id: r.sentence_ids for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: [], 1: ["mit/notice"], 2: ["mit/notice"], 3: ["cc-by-4.0/notice"]}


def test_minhash_estimates_and_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(12)
    for size, tries in ((7, 200), (50, 200), (400, 200), (4000, 40)):
        errors, kept, met = [], 0, 0
        for k in range(tries):
            share = 0.85 + 0.05 * (k % 6) / 6
            union = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            lacking = int(size * (1 - share))
            x, y = union[: size - lacking // 2], union[(lacking + 1) // 2 :]
            true = (size - lacking // 2 - (lacking + 1) // 2) / size
            a, b, oa, ob = minhash.sketch(x, 192), minhash.sketch(y, 192), minhash.odd_sketch(x), minhash.odd_sketch(y)
            errors.append(minhash.estimate(a, b, len(x), len(y)) - true)
            fits, _ = minhash._may_reach(np.array([len(x)]), np.array([len(y)]), a[None], b[None], oa[None], ob[None], 85)
            kept += bool(fits[0])
            met += minhash.first_shared(a, b[None], 32)[0] >= 0
        assert kept == met == tries and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04
    one, other = (rng.integers(0, 2**63, 3000, dtype=np.uint64) for _ in range(2))
    assert abs(minhash.estimate(minhash.sketch(one, 192), minhash.sketch(other, 192), 3000, 3000)) < 0.03
    need = minhash.least_agreeing(192, 85)
    assert need[0] == 0 and 100 < need[192] < 0.85 * 192 and (np.diff(need) >= 0).all()
