"""The operators of the subpackage against brute force, exact round trips and held-out labels, and their edge cases."""

import base64
import collections
import hashlib
import math
import zlib
from html import unescape

import numpy as np
import pytest

import corpus_pipeline
from curata.llm import bpe, components, embedding_dedup, exact_dedup, html_text, language_model, licences, minhash, mixing, quality, queries, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "b", 3), (4, "One two", "en", "a", 7), (4, "One two", "en", "a", 7), (5, "one TWO", "en", "b", 7), (6, "long word " * 30000, "en", "b", 300000), (None, "no id at all here", "en", "a", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    key = lambda v: "null" if v is None or str(v) in ("nan", "<NA>") else f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    rows = lambda df: sorted(tuple(map(key, r)) for r in df[sorted(wanted.columns)].itertuples(index=False))
    assert sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)


def test_exact_dedup_edges_and_persistence(spark, odd):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.report(odd).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (4, 4, 2, True), (5, 5, 1, True)} <= rows
    kept = exact_dedup.distinct_rows(odd.withColumnRenamed("n_chars", "digest_"))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [2, 3, 4, 5, 6] and "digest_" in kept.columns
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.report(odd, index)
    later = spark.createDataFrame([(99, "One two"), (100, "new")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.report(later, index).collect()} == {(99, 4), (100, 100)}
    assert exact_dedup.report(odd.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (None, "u", "z\r\n\r\nq"), (2, None, "<p>é</p>")], "page_id long, url string, html string")
    archive = warc.write_archive(pages, warc.Archive(spark))
    found = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(archive).collect()}
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    p = "<p>é</p>".encode()
    assert found == {(1, len(p), sha(p), "revisit", 2), (2, len(p), sha(p), "response", None), (3, 0, sha(b""), "response", None), (None, 6, sha(b"z\r\n\r\nq"), "response", None)}
    kinds = collections.Counter()
    for r in warc.read_records(archive).collect():
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        kind = head.split(b"\r\n")[1]
        kinds[kind] += 1
        assert head.startswith(b"WARC/1.1\r\n") and rest == (bytes(r.payload) if r.payload is not None else b"") + b"\r\n\r\n"
        assert (r.payload is None) == (kind == b"WARC-Type: revisit")
    assert kinds == {b"WARC-Type: response": 4, b"WARC-Type: revisit": 1}
    assert collections.Counter((r.page_id, bytes(r.payload)) for r in warc.read_pages(archive).collect()) == collections.Counter((i, (h or "").encode()) for i, _, h in pages.collect())
    assert warc.report(warc.write_archive(pages.limit(0), warc.Archive(spark))).count() == 0


def test_mixing_targets_and_bounds(spark, odd):
    rows = mixing.mix(odd).toPandas()
    assert len(rows) == len(ODD) and (rows["taken"] <= 3 * rows["size"]).all()
    again = mixing.mix(odd.repartition(3)).toPandas()
    assert sorted(rows["taken"]) == sorted(again["taken"])
    sizes = [("a", 100), ("b", 10), ("c", 0), (None, 50)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    left, target = {s: w for (s, n), w in zip(sizes, (5, 2, 1, 5), strict=True)}, dict.fromkeys([s for s, _ in sizes], 0.0)
    caps, total = {s: 3 * n for s, n in sizes}, 160.0
    while total > 1e-9 and left:
        share = total / sum(left.values())
        total = 0.0
        for s in list(left):
            target[s] += share * left[s]
            if target[s] >= caps[s]:
                total += target[s] - caps[s]
                target[s] = caps[s]
                del left[s]
    assert all(math.isclose(got[s], target[s], abs_tol=1e-6) for s in got)
    assert mixing.mix(odd.limit(0)).count() == 0


MIT = '''MIT License

Copyright (c) 2024 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
NAMES = '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
APACHE = '''# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0'''
GPL = '''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.'''


def test_licences(spark):
    texts = {1: "x. Released under the MIT License. All rights reserved.", 2: None, 3: "This program is free software; This work is licensed under the GNU General Public License, version 3.", 4: MIT, 5: BSD, 6: BSD + NAMES, 7: APACHE, 8: GPL, 9: "Home | News\nReleased under the MIT License\nMore", 10: "word " * 200000 + "\n" + APACHE, 11: ""}
    docs = spark.createDataFrame([*texts.items(), (9, texts[9])], "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS sentence_ids", "2 AS hits")
    found = licences.scan(docs).collect()
    got = {r.doc_id: (r.licences, r.rule) for r in found}
    assert len(found) == 12 and got == {1: (["All-Rights-Reserved", "MIT"], "mit-notice"), 2: ([], None), 3: (["GPL-3.0"], "gpl-3.0-full"), 4: (["MIT"], "mit-full"), 5: (["BSD-2-Clause"], "bsd-2-clause"), 6: (["BSD-3-Clause"], "bsd-3-clause"), 7: (["Apache-2.0"], "apache-2.0-full"), 8: (["GPL-3.0-or-later"], "gpl-3.0-or-later-comma"), 9: (["MIT"], "mit-notice"), 10: (["Apache-2.0"], "apache-2.0-full"), 11: ([], None)}
    assert licences.scan(docs.limit(0)).count() == 0


def test_pairs_of_a_group_meet_in_one_band():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 3, 192).astype(np.uint16)
    one[:12] = minhash.EMPTY
    others = np.stack([np.where(rng.random(192) < share, one, rng.integers(0, 3, 192)).astype(np.uint16) for share in (1, 0.95, 0.8, 0)])
    got = minhash.first_shared(one, others, 32)
    for row, first in zip(others, got, strict=True):
        mine, its = minhash.all_band_keys(one, 32), minhash.all_band_keys(row, 32)
        shared = [b for b in range(32) if mine[b] == its[b] and (one.reshape(32, 6)[b] != minhash.EMPTY).any()]
        assert first == (shared[0] if shared else -1)
    assert got[0] == 2 and set(minhash.band_keys(one, 32)) == set(minhash.all_band_keys(one, 32)[2:])


def test_odd_sketches_never_differ_in_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(4)
    for n, only in ((1, 0), (1, 1), (30, 7), (400, 90), (5000, 0), (5000, 3000)):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - only], rng.integers(0, 2**63, only, dtype=np.uint64)])
        differ = int(minhash.odd_differ(minhash.odd_sketch(x), minhash.odd_sketch(y)))
        real = len(np.setxor1d(x, y))
        assert differ <= real and (differ - real) % 2 == 0
        assert real > 20 or differ >= real - 4


def test_quality_on_held_out_labels_and_edges(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judge(docs, labels=labels.where("pmod(xxhash64(doc_id, 9), 2) = 0")).toPandas().merge(labels.where("pmod(xxhash64(doc_id, 9), 2) = 1").toPandas(), on="doc_id")
    clean = judged[(judged.quality == 1) & (judged.toxic == 0)]
    bad = judged[(judged.quality == 0) | (judged.toxic == 1)]
    assert clean.kept.mean() > 0.98 and bad.kept.mean() < 0.15
    rows = quality.judge(odd.withColumnRenamed("n_chars", "score"), keep_columns=True)
    assert rows.count() == len(ODD) and not [r for r in rows.where("doc_id < 4").collect() if r.kept]
    assert quality.kept_rows(odd.limit(0), labels=labels).count() == 0
    marks = spark.createDataFrame([(4, None), (None, 1), (77, 1)], "doc_id long, toxic long")
    assert len(quality.learn_lexicon(odd, marks)) == 0


def test_quality_lexicon_is_learnt(spark):
    rng = np.random.default_rng(2)
    prose = lambda: [f"word{k}" for k in rng.integers(0, 300, 40)]
    docs = [(i, " ".join([*prose(), *(["grolle!", "Grollest"] if i % 4 == 0 else [])])) for i in range(200)]
    found = quality.learn_lexicon(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic long"))
    assert found.tolist() == quality._hashes(["grolle"]).tolist()


def test_quality_em_against_plain_loops():
    rng = np.random.default_rng(8)
    L, C = 4, quality.CLASSES
    patterns, counts = np.unique(rng.choice([0, 1, 5, quality.ABSTAIN], (60, L), p=[0.4, 0.2, 0.1, 0.3]), axis=0, return_counts=True)
    post = []
    for v in patterns:
        ballots = [sum(x == c for x in v) * (1 if c == 0 else 4 * L) + 0.05 for c in range(C)]
        post.append([b / sum(ballots) for b in ballots])
    for _ in range(5):
        weight = [[post[i][c] * counts[i] for c in range(C)] for i in range(len(patterns))]
        total = sum(map(sum, weight))
        share = [(sum(w[c] for w in weight) + 0.02) / (total + C * 0.02) for c in range(C)]
        table = {}
        for k in range(L):
            for c in range(C):
                row = [sum(w[c] for w, v in zip(weight, patterns, strict=True) if v[k] == x) + 0.02 for x in range(C)]
                for x in range(C):
                    table[k, c, x] = row[x] / sum(row)
        post = []
        for v in patterns:
            odds = [share[c] * math.prod(table[k, c, v[k]] for k in range(L) if v[k] != quality.ABSTAIN) for c in range(C)]
            post.append([o / sum(odds) for o in odds])
    got, _, _ = quality.fit_labellers(patterns, counts.astype(float), rounds=5)
    assert np.allclose(got, post, atol=1e-9)


def test_language_model_counts_gradients_and_gain(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_model.op4_language_model(spark, SF).toPandas()
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [b"\0"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows.itertuples():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    assert rows[rows.held_out].score.sum() > rows[rows.held_out].base_score.sum()
    assert language_model.score(odd, language_model.split_seven(odd["doc_id"])).count() == len(ODD)
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.3, language_model.SIZE)
    x = rng.integers(0, language_model.SLOTS, (6, 3))
    carry, real = np.ones((6, 1, 3)), np.ones((6, 3), bool)
    carry[0], carry[3, 0, 1], real[5, 2] = 0, 0, False  # a document starts inside the window, a stream ends before it does

    def loss(f, grads=None):
        return language_model.window_gradient(language_model.unpack(f), np.zeros((language_model.HIDDEN, 3)), x, carry, real, grads or language_model.unpack(np.zeros_like(f)))[1]

    total = np.zeros_like(flat)
    loss(flat, language_model.unpack(total))
    for i in np.argsort(-np.abs(total))[:: len(total) // 40][:20]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - total[i]) < 0.02


def test_language_model_trains_on_every_training_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(200)] + [(None, "no id")], "doc_id long, text string")
    seen, average = collections.Counter(), language_model._average

    def spy(training, *rest):
        seen.update(bytes(r["slots"]) for r in training.collect())
        return average(training, *rest)

    monkeypatch.setattr(language_model, "_average", spy)
    first = {r.doc_id: r.score for r in language_model.score(docs, language_model.split_seven(docs["doc_id"])).collect()}
    wanted = [r.text for r in docs.collect() if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2]
    assert sum(seen.values()) == len(wanted) and len(seen) >= len(wanted) - 1
    again = language_model.score(docs.repartition(7), language_model.split_seven(docs["doc_id"])).collect()
    assert all(math.isclose(first[r.doc_id], r.score, rel_tol=1e-5) for r in again)
    nothing = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    assert language_model.score(nothing.limit(0), language_model.split_seven(nothing["doc_id"])).count() == 0
    alone = language_model.score(nothing.withColumn("slots", nothing["doc_id"]), nothing["doc_id"] == 2).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in alone] == [(3, 0, 0, True)] and math.isfinite(alone[0].score)


def test_language_model_score_against_plain_loops():
    rng = np.random.default_rng(6)
    p = {k: v.astype(np.float64) for k, v in language_model.unpack(rng.normal(0, 0.4, language_model.SIZE)).items()}
    docs = [rng.integers(0, language_model.SLOTS, n).astype(np.int16) for n in (1, 2, 40, 7, 1, 90, 13)]
    got, H = language_model.score_sequences(p, docs, streams=3, steps=5), language_model.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))
    for found, doc in zip(got, docs, strict=True):
        h, total = [0.0] * H, 0.0
        for x in doc.tolist():
            c, w = divmod(x, language_model.WIDTH)
            for logits, pick in ((np.array(h) @ p["cw"] + p["cb"], c), (np.array(h) @ p["ww"][c] + p["wb"][c], w)):
                total += logits[pick] - math.log(sum(math.exp(v) for v in logits))
            a, u = p["inp"][x] + p["bias"], np.array(h) @ p["rec"]
            z, r = [sig(a[k] + u[k]) for k in range(H)], [sig(a[H + k] + u[H + k]) for k in range(H)]
            n = [math.tanh(a[2 * H + k] + r[k] * u[2 * H + k]) for k in range(H)]
            h = [n[k] + z[k] * (h[k] - n[k]) for k in range(H)]
        assert math.isclose(found, total, rel_tol=1e-9)


def test_minhash_against_brute_force(spark, odd):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 500, n)) for n in (8, 20, 60, 200, 900) for _ in range(6)]
    texts = base + [t.replace(" ", "\n", 1) for t in base[:5]]
    for t in base:
        w = t.split()
        for cut in (0.02, 0.05, 0.08):
            u = list(w)
            for k in rng.integers(0, len(u), max(1, int(cut * len(u) / 2))):
                u[k] = "x"
            texts.append(" ".join(u))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [minhash.shingle_set(t, 3) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in minhash.classes(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 3, None)} <= {(a, min(b, 3) if a is None else b, c) for a, b, c in rows}
    a, b = minhash.sketch(sets[24], 192), minhash.sketch(sets[25], 192)
    assert abs(minhash.estimate(a, a, len(sets[24]), len(sets[24])) - 1) < 1e-9 and abs(minhash.estimate(a, b, len(sets[24]), len(sets[25]))) < 0.1


def _reach(ids: list, linked: np.ndarray) -> dict:
    """The smallest id that each can reach over a matrix of links."""
    low = np.array(ids)
    while True:
        after = np.minimum(low, np.where(linked, low[None, :], max(ids) + 1).min(1))
        if (after == low).all():
            return dict(zip(ids, low.tolist(), strict=True))
        low = after


def _linked(texts: list, width: int, percent: int) -> np.ndarray:
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    out = np.zeros((len(texts), len(texts)), bool)
    holders = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for g in x:
            holders[g].append(i)
    for i, x in enumerate(sets):
        for j, both in collections.Counter(j for g in x for j in holders[g]).items():
            out[i, j] = 100 * both >= percent * (len(x) + len(sets[j]) - both)
    return out


def test_minhash_links_of_a_borderline_group_stay_linear(spark, monkeypatch):
    rng, n, links = np.random.default_rng(5), 300, []
    base, texts = rng.integers(0, 5000, 120), []
    for _ in range(n):
        words = base.copy()
        words[rng.integers(0, 120, rng.integers(1, 4))] = rng.integers(0, 5000)
        texts.append(" ".join(f"w{k}" for k in words))
    confirmed = minhash._confirmed

    def spy(*args):
        found = confirmed(*args)
        links.append(found.count())
        return found

    monkeypatch.setattr(minhash, "_confirmed", spy)
    docs = spark.createDataFrame([((7 * i) % n, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.classes(docs, 5, 80, 200, 40, block=64, hub_rounds=1).collect()}
    linked = _linked(texts, 5, 80)
    assert got == _reach([(7 * i) % n for i in range(n)], linked) and linked.sum() > 20 * n and sum(links) < 4 * n


def test_minhash_takes_rows_of_one_id_as_documents(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta " + " ".join(f"{x}{k}" for k in range(60)) for x in "pqr")
    docs = spark.createDataFrame([(5, a), (5, b), (3, b + " end"), (4, a), (9, c), (5, b)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in minhash.classes(docs).collect())
    assert got == {(5, 4): 1, (5, 3): 2, (3, 3): 1, (4, 4): 1, (9, 9): 1}
    assert minhash.classes(docs.limit(0)).count() == 0


def test_bpe_equals_tiktoken_and_round_trips(spark, odd):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    texts = ["", "  a  b\n c", "héllo 漢字 🙂🙂 x\x85y\x1cz", "don't  stop", *("".join(rng.choice(list("ab é漢\n\t 1'!")) for _ in range(80)) for _ in range(300))]
    codec = bpe.codec(path, P.PATTERN)
    assert codec.encode(texts) == [own.encode_ordinary(t) for t in texts]
    assert all(codec.decode(codec.encode([t])[0]) == t for t in texts)
    t = "aé漢 🙂x"
    assert [t[i:j] for i, j in codec.offsets(t)][0] == "a" and codec.offsets(t)[-1] == (len(t) - 1, len(t))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    enc = bpe.encode(docs.withColumnRenamed("doc_id", "ids"), path, P.PATTERN, offsets=True)
    back = bpe.decode(enc, path, P.PATTERN, ids="ids_").collect()
    assert all(bytes(r.text_bytes).decode() == (r.text or "") for r in back)


def test_bpe_digests_equal_tiktoken(spark, odd):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs, found in ((spark.read.parquet(f"{SF}/documents.parquet"), bpe.op6_bpe(spark, SF)), (odd, bpe.encoded_with_digests(odd, path, P.PATTERN))):
        wanted = collections.Counter()
        for r in docs.collect():
            ids = own.encode_ordinary(r.text or "")
            wanted[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        names = [c for c in found.columns if c.startswith(("n_tokens", "ids_sha256", "decoded_sha256"))]
        assert collections.Counter((r["doc_id"], *(r[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256"))) for r in found.collect()) == wanted and len(names) == 3
    assert bpe.encoded_with_digests(odd.limit(0), path, P.PATTERN).count() == 0


def test_embeddings_recall_with_many_cells(spark):
    rng, dim = np.random.default_rng(9), 64
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k, cos in zip(range(0, 1600, 2), np.tile(np.linspace(0.905, 0.99, 16), 50), strict=True):
        off = rng.normal(size=dim)
        off -= (off @ x[k]) * x[k]
        x[k + 1] = cos * x[k] + math.sqrt(1 - cos * cos) * off / np.linalg.norm(off)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(docs, cell_size=32).collect()}  # 125 cells, the production probes
    links = (x @ x.T >= 0.9).sum(1) - 1
    assert links.sum() == 1600 and sum(n for n, _ in got.values()) >= 0.95 * 1600 and all(got[i][0] <= links[i] for i in got)


def test_embeddings_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x = np.concatenate((x, x[:200] + rng.normal(size=(200, 16)) * 0.1, x[:5]))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (None, [1.0] * 16), (5005, [1.0, 2.0])]
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), cell_size=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (5000, 5001, 5002, 5003, 5004, 5005))


def test_html_extract_edges(spark):
    article = "<nav>menu</nav><article><p>main &amp; text</p></article>"
    rows = [(1, None, None), (2, "http://a/", ""), (3, None, article), (3, None, article), (None, "u", article), (4, "http://a/x", "<p>" + "long word " * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS blocks")
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    long = ("long word " * 50000).strip()
    assert got == {(1, None, "", 0): 1, (2, "http://a/", "", 0): 1, (3, None, "main & text", 11): 2, (None, "u", "main & text", 11): 1, (4, "http://a/x", long, len(long)): 1}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_blocks_and_boilerplate():
    page = "<html><head><title>t</title></head><body><nav>m</nav><article><h1>A &amp; B</h1><p><b>x <br> y<p>z<script>var a='</p>'</script></p><div class='comments'>c</div></article><footer>f</footer>"
    texts, kinds = html_text.blocks(page)
    assert [t for t, k in zip(texts, kinds, strict=True) if k == html_text.ARTICLE] == ["A & B", "x y", "z"]
    assert html_text.blocks(None) == ([], []) and unescape("&lt;") == "<"
    shared = " ".join(f"s{i}" for i in range(20))
    own = [[f"a{i} b{i} c{i}", shared] for i in range(3)]
    assert html_text.shard_texts([1, 2, 3], own, [[2, 2]] * 3, 16) == [f"a{i} b{i} c{i}" for i in range(3)]
    assert html_text.shard_texts([1, 1], own[:1] * 2, [[2, 2]] * 2, 16) == ["\n\n".join(own[0])] * 2


def test_html_boilerplate_is_found_on_any_two_pages_of_a_host(spark):
    pages = []
    for i in range(700):
        shared = " ".join(f"s{i % 350}x{k}" for k in range(18))
        pages.append((i, f"http://one/{i}", f"<body><p>own{i} a b</p><p>é{shared}</p><p>tail{i}</p></body>"))
    pages += [pages[0], (None, "http://one/n", pages[1][2]), (9000, "http://two/", pages[2][2]), (9001, "http://three/", "<p>" + "z " * 40), (9001, "http://three/", "<p>" + "z " * 40)]
    got = collections.Counter((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    cut, wanted = [html_text.blocks(h) for _, _, h in pages], collections.Counter()
    for host in ("one", "two", "three"):
        rows = [i for i, p in enumerate(pages) if p[1].startswith(f"http://{host}/")]
        texts = html_text.shard_texts([pages[i][0] for i in rows], [cut[i][0] for i in rows], [cut[i][1] for i in rows], 16)
        wanted.update((pages[i][0], t) for i, t in zip(rows, texts, strict=True))
    assert got == wanted and got[(5, "own5\n\ntail5")] == 1 and got[(9001, " ".join("z" * 40))] == 2


def covered_by_loops(rows, depth):
    """rows: page, host, tokens. Per row which tokens lie in a run of `depth` tokens on two pages of the host."""
    on = collections.defaultdict(set)
    for page, host, words in rows:
        for i in range(len(words) - depth + 1):
            on[host, tuple(words[i : i + depth])].add(page)
    out = []
    for _, host, words in rows:
        hit = [False] * len(words)
        for i in range(len(words) - depth + 1):
            if len(on[host, tuple(words[i : i + depth])]) > 1:
                hit[i : i + depth] = [True] * depth
        out.append(hit)
    return out


def random_streams(seed):
    """Streams over few words, so that runs repeat within and across pages, with repeated page ids, a null id and empty pages."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(120):
        words = [f"w{k}" if k else "é" for k in rng.integers(0, 3 + i % 9, rng.integers(0, 60))] + ["z"] * (40 if i % 17 == 0 else 0)
        rows.append((None if i % 40 == 7 else i // 2 if i % 5 == 0 else i, f"h{i % 3}", words))
    return rows


@pytest.mark.parametrize(("depth", "crowded"), [(1, False), (6, False), (6, True), (7, False)])
def test_suffixes_dealt_by_anchors_make_the_whole_suffix_array(depth, crowded):
    rows = random_streams(depth)
    _, _, _, tokens, page = html_text.token_streams([[" ".join(w)] if w else [] for _, _, w in rows])
    flat, starts = [w for _, _, words in rows for w in words], np.searchsorted(page, np.arange(len(rows)))
    assert len(flat) == len(tokens)
    at, key = html_text.anchors(tokens, page, np.array([hash(h) & 0xFFFF for _, h, _ in rows], np.uint64), depth)
    first, end, own = html_text.cut_pieces(tokens, page, at, key.copy(), np.unique(key), np.unique(key) if crowded else key[:0], depth)
    met = collections.defaultdict(dict)  # anchor: piece: rows
    for a, b, k in zip(first.tolist(), end.tolist(), own.tolist(), strict=True):
        assert page[a] == page[b - 1] and b - a >= depth and (b - a == depth or not crowded)
        met[k].setdefault((rows[page[a]][1], " ".join(flat[a:b])), []).append(a)
    got = [[False] * len(w) for _, _, w in rows]
    for found in met.values():  # one array for each anchor: no suffix needs another anchor's
        ids = [[rows[page[a]][0] for a in places] for places in found.values()]
        low, high = ([f((i for i in own if i is not None), default=None) for own in ids] for f in (min, max))
        bits = html_text.sorted_pieces([h for h, _ in found], [p for _, p in found], low, high, [None in own for own in ids], depth)
        for (_, piece), places, covered in zip(found, found.values(), bits, strict=True):
            for a in places:
                for j, hit in enumerate(np.unpackbits(np.frombuffer(covered, np.uint8))[: piece.count(' ') + 1].tolist()):
                    if hit:
                        got[page[a]][a - starts[page[a]] + j] = True
    assert got == covered_by_loops(rows, depth) and any(map(any, got)) and (depth == 1 or not all(map(all, got)))


@pytest.mark.parametrize(("crowd", "few"), [(2, 9), (4096, 0)])
def test_html_suffix_array_equals_plain_loops(spark, crowd, few):
    rows = random_streams(5)
    pages = [(p, f"http://{h}/{i}", f"<article>{' '.join(w)}</article>" if i % 4 == 3 else f"<div>{' '.join(w)}</div>") for i, (p, h, w) in enumerate(rows)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), 6, crowd, 16, few)
    wanted = collections.Counter()
    for (p, url, _), (_, _, words), hit in zip(pages, rows, covered_by_loops(rows, 6), strict=True):
        wanted[p, url, " ".join(words if int(url.split("/")[-1]) % 4 == 3 else [w for w, c in zip(words, hit, strict=True) if not c])] += 1
    assert collections.Counter((r.page_id, r.url, r.text) for r in got.collect()) == wanted


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (7, 7), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40}


def test_exact_dedup_reduces_before_the_shuffle(spark, odd):
    plan = exact_dedup.reduced(odd.selectExpr("doc_id", "sha2(text, 256) AS digest"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_max")  # the tree is printed from the top
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.report(spark.createDataFrame([(1, "t"), (2, "t")], "doc_id long, text string"), index)
    later = exact_dedup.report(spark.createDataFrame([(9, "t"), (9, "t")], "doc_id long, text string"), index).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in later] == [(2, 2, False)] * 2


def test_mixed_rows_edges(spark, odd):
    rows = spark.createDataFrame([(1, "", "b"), (2, None, "b"), (3, "x y z", "b"), (4, "w " * 50, "a"), (4, "w " * 50, "a"), (None, "n", None)], "doc_id long, text string, source string")
    found = collections.Counter(r.doc_id for r in mixing.mixed_rows(rows.withColumnRenamed("source", "source").selectExpr("*", "1 AS copies_", "2 AS times_")).collect())
    assert max(found[1], found[2], found[3]) <= 3 and found[4] <= 6
    assert mixing.mixed_rows(rows.limit(0)).count() == 0


def _mix(rows: list) -> collections.Counter:
    """(doc_id, text, source) of documents to how often the mix takes each, by plain loops."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i, _, z in rows if z == s) for s in names}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 3.0 * total[s] for s in full})
        left -= sum(3.0 * total[s] for s in full)
        open_ -= full
    out = collections.Counter()
    for s in names:
        own, epochs = [], int(target[s] // total[s]) if total[s] else 0
        for i, t, z in rows:
            if z == s:
                mean = len(t or "") / size[i] if size[i] else 0
                quality_ = max(0.1, 1 / (1 + max(4 - mean, mean - 10, 0))) if size[i] else 0.1
                u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                own.append((-math.log(u) / quality_, i))
        upto, rest = 0, target[s] - epochs * total[s]
        for _, i in sorted(own):
            start, upto = upto, upto + size[i]
            out[i] += epochs + (size[i] > 0 and (upto <= rest or start < rest and upto - rest <= rest - start))
    return out


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.classify(spark, docs, SF).toPandas()
    assert list(kept.columns) == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    clean = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    assert set(clean) <= set(kept.doc_id)
    last = {}
    for i, t in zip(kept.doc_id, kept.text, strict=True):
        last[t] = max(i, last.get(t, i))
    ids = sorted(last.values())
    rows = {i: (i, t, s) for i, t, s in zip(kept.doc_id, kept.text, kept.source, strict=True)}
    component = _reach(ids, _linked([rows[i][1] for i in ids], 5, 80))
    copies = _mix([rows[i] for i in ids if component[i] == i])
    found = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in found) == +copies
    assert all(hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest() == r.decoded_sha256 for r in found)


def test_pipeline_stages_take_odd_rows(spark, odd):
    base = odd.selectExpr("doc_id", "text", "lang", "source", "n_chars", "7 AS kept", "8 AS score")
    for rows in (base, base.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            assert name and (rows.columns == base.columns or stage is corpus_pipeline.encode)
        assert rows.count() >= 0
