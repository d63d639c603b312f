"""Pruned near-duplicate joins: the rows of all pairs, by far fewer comparisons."""

import numpy as np
import pytest

from curata.operators import neardup

SCHEMA = "id long, kind string, unit array<double>, bits long"


def _clustered(n, dim, groups, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits = np.packbits(x @ rng.normal(size=(dim, 64)) > 0, axis=1).view(">u8")[:, 0].astype(np.int64)
    return x, bits, rng.integers(0, 3, n)


def _rows(spark, x, bits, kind):
    extra = [(9000, "0", None, 1), (9001, None, [1.0] * x.shape[1], 1), (None, "0", [1.0] * x.shape[1], 1), (9002, "0", [None] * x.shape[1], 1), (9003, "1", [], 1)]
    return spark.createDataFrame([(i, str(k), v.tolist(), int(b)) for i, (v, b, k) in enumerate(zip(x, bits, kind, strict=True))] + extra, SCHEMA)


@pytest.mark.parametrize(("distance", "block"), [(-1, "kind"), (2, "kind"), (2, None), (18, "kind")])
def test_pairs_equal_all_pairs(spark, distance, block):
    x, bits, kind = _clustered(500, 64, 25, 0.2)
    cos, ham = x @ x.T, np.bitwise_count(bits.view(np.uint64)[:, None] ^ bits.view(np.uint64)[None, :])
    near = ((cos >= 0.97) | (ham <= distance)) & (np.arange(500)[:, None] < np.arange(500)[None, :])
    if block:
        near &= kind[:, None] == kind[None, :]
    found = neardup.near_pairs(_rows(spark, x, bits, kind), "id", block, 0.97, distance, size=32).collect()
    got = {(r.a, r.b): r for r in found if r.b < 9000}
    assert len(got) == len([r for r in found if r.b < 9000]) and set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)}
    assert near.sum() > 20 and all(abs(r.cos - cos[a, b]) < 1e-9 and r.ham == ham[a, b] for (a, b), r in got.items())


def test_few_of_all_pairs_are_compared(spark):
    x, bits, kind = _clustered(2000, 32, 60, 0.05)
    rows = _rows(spark, x, bits, kind).where("id < 9000")
    side = neardup._side(rows, "id", None)
    cells = neardup.Cells(side, 256, 25)
    sizes = {r.cell: r["count"] for r in cells.rows.groupBy("cell").count().collect()}
    visits = {r.cell: r["count"] for r in cells.visits(cells.rows, float(np.arccos(0.98)), -1, above_home=True).groupBy("cell").count().collect()}
    compared = sum(n * n for n in sizes.values()) + sum(n * sizes.get(c, 0) for c, n in visits.items())
    assert compared < 0.1 * 2000 * 2000
    cos = x @ x.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(cos >= 0.98), strict=True) if i < j}
    assert {(r.a, r.b) for r in neardup.near_pairs(rows, "id", None, 0.98, -1, size=25).collect()} == want and want


def test_nearest_and_unleaked_equal_all_pairs(spark):
    x, bits, kind = _clustered(400, 16, 12, 0.1)
    rows = _rows(spark, x, bits, kind)
    test = np.arange(400) % 5 == 0
    cos = x @ x.T
    got = {r.id: r.near_cos for r in neardup.nearest(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"), "id", "kind", size=20).collect()}
    for i in np.flatnonzero(test):
        of = np.flatnonzero(~test & (kind == kind[i]))
        assert abs(got[i] - cos[i, of].max()) < 1e-9
    alone = spark.createDataFrame([(1, "nowhere", [1.0] + [0.0] * 15, 3)], SCHEMA)
    assert [tuple(r) for r in neardup.nearest(alone, rows, "id", "kind", size=20).collect()] == [(1, 0.0)]
    for size in (20, 2048):
        left = {r.id for r in neardup.unleaked(rows.where("id % 5 <> 0 and id < 9000"), rows.where("id % 5 = 0"), "id", 0.98, 1, size=size).collect()}
        ham = np.bitwise_count(bits.view(np.uint64)[:, None] ^ bits.view(np.uint64)[None, :])
        assert left == {int(i) for i in np.flatnonzero(~test) if not ((cos[i, test] >= 0.98) | (ham[i, test] <= 1)).any()}
    none = rows.limit(0)
    assert neardup.near_pairs(none, "id", "kind", 0.9, 3).count() == 0 and neardup.nearest(none, none, "id", "kind").count() == 0 and neardup.unleaked(rows, none, "id", 0.9, 3).count() == rows.count()


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_copies_of_a_row_do_not_grow_with_the_rows(spark, spread):
    x, bits, kind = _clustered(2000, 32, 60, spread)
    rows = _rows(spark, x, bits, kind).where("id < 9000")
    for n in (1000, 2000):
        cells = neardup.Cells(neardup._side(rows.where(f"id < {n}"), "id", None), 256, 10)
        for angle in (0.2, 3.0):
            copies = neardup._copies(cells.dealt()[0].withColumn("reach", neardup.F.lit(angle)), cells.meets(-1))
            most = copies.groupBy("k").count().agg({"count": "max"}).first()[0]
            assert most <= neardup.CHUNKS + 1 and copies.where("chunk = own").count() == n
            assert spread > 1 or angle > 1 or copies.count() < 4 * n
    cos = x @ x.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(cos >= 0.5), strict=True) if i < j}
    assert {(r.a, r.b) for r in neardup.near_pairs(rows, "id", None, 0.5, -1, size=10).collect()} == want and want


def test_hamming_pairs_of_large_distances_without_copies_of_bands(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 64)
    x, bits, kind = _clustered(600, 64, 40, 0.3)
    rows = _rows(spark, x, bits, kind).where("id < 9000").union(_rows(spark, x[:1], bits[:1], kind[:1]).where("id < 9000").selectExpr("id + 1000", "kind", "unit", "bits"))
    assert neardup._bands(601, 15, 64)[1] > neardup.MOST_COPIES
    ids, bits = [*range(600), 1000], np.append(bits, bits[0]).view(np.uint64)
    ham = np.bitwise_count(bits[:, None] ^ bits[None, :])
    found = neardup.banded_pairs(rows.select("id", "bits"), "id", 15)
    assert "Generate" not in found._jdf.queryExecution().toString()
    want = {(ids[i], ids[j]): ham[i, j] for i, j in zip(*np.nonzero(ham <= 15), strict=True) if i < j}
    got = found.collect()
    assert {(r.a, r.b): r.ham for r in got} == want and len(got) == len(want) > 600
