"""Near-duplicate joins over unit vectors (`unit`) and 64-bit fingerprints (`bits`), exact and pruned by the triangle inequality.

Pivots are fitted on a bounded sample; every row goes to the cell of its nearest pivot, and a cell's radius is the largest angle (and Hamming distance) of its rows to the
pivot. A row within the angle t of some row of a cell is within t + radius of the cell's pivot, so it meets only the cells for which that holds, or for which the
same holds of Hamming distances. Small Hamming distances are joined by bands instead.

Rows are shuffled by chunks, not by cells: a block's rows, cell after cell, are cut into at most CHUNKS chunks of equal size, and a row is copied once for each chunk with a cell
that it meets. So a row is copied at most about CHUNKS times however many rows there are, until chunks reach WIDEST bytes of vectors; a hot cell is spread over
several chunks. Each pair of chunks is a group of its own that is compared tile by tile, only with the rows that meet a tile's cells, and hands on its
finds tile by tile. Nothing is broadcast but the pivots.

Defined results: rows with a null key, unit or bits have no pairs; a null block equals no block; empty tables give empty results. Bounds leave 1e-6 to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import vectors as vx
from curata.operators.scratch import stored

SLACK = 1e-6
#: Band copies of a row up to which Hamming pairs are joined by bands rather than by cells.
MOST_COPIES = 128
#: Chunks of a block at most, as long as a chunk's vectors take at most so many bytes; rows of a tile.
CHUNKS, WIDEST, TILE = 16, 64 << 20, 2048
#: Span of a cell that a block does not have: its first chunk is after its last.
ABSENT = 1 << 32


def _side(rows: DataFrame, key: str, block: str | None) -> DataFrame:
    named = rows.select((F.col(block) if block else F.lit(0)).alias("block"), F.col(key).cast("long").alias("k"), F.col("unit").alias("unit"), F.col("bits").alias("bits"))
    return named.where("block is not null and k is not null and unit is not null and bits is not null and size(unit) > 0 and not exists(unit, x -> x is null)")


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = table.column("unit")
    units = units.combine_chunks() if isinstance(units, pa.ChunkedArray) else units
    return np.asarray(table.column("k")), np.asarray(units.flatten(), np.float64).reshape(table.num_rows, -1), np.asarray(table.column("bits")).astype(np.int64).view(np.uint64)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _distances(bits: np.ndarray, pivot_bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[:, None] ^ pivot_bits[None, :]).astype(np.int64)


class Cells:
    """Pivots fitted on a sample, one for about each `size` rows and at most `most` (0: none); the rows in their cells, and the radius of each cell. Rows that fit one cell are left as they are."""

    def __init__(self, side: DataFrame, most: int, size: int, rounds: int = 4):
        n = side.count()
        self.rows, self.empty, self.one, self.size, self.wide, self.cells = side.withColumn("cell", F.lit(0)), not n, n <= size or not most, size, WIDEST, 1
        if self.one:
            return
        _, units, bits = _arrays(side.select("k", "unit", "bits").orderBy(F.xxhash64("k"), "k").limit(8 * most).toArrow())
        pivots = units[: max(1, min(most, -(-n // size), len(units)))].copy()
        for _ in range(rounds):  # spherical k-means on the sample; the bounds hold for any pivots
            near = (units @ pivots.T).argmax(1)
            for c in range(len(pivots)):
                mean = units[near == c].sum(0)
                if (length := np.linalg.norm(mean)) > 0:
                    pivots[c] = mean / length
        near = (units @ pivots.T).argmax(1)
        self.pivots, self.cells, self.wide = pivots, len(pivots), max(1, WIDEST // (8 * units.shape[1]))
        self.bits = np.array([bits[near == c][0] if (near == c).any() else 0 for c in range(len(pivots))], np.uint64)
        home, own_bits = self.pivots, self.bits

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    _, u, b = _arrays(batch)
                    angle = _angles(u, home)
                    cell = angle.argmin(1)
                    at = np.arange(len(cell))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[at, cell]), pa.array(_distances(b, own_bits)[at, cell])], [*batch.schema.names, "cell", "angle", "far"])

        kind = side.schema["block"].dataType.simpleString()
        self.rows = stored(side.mapInArrow(assign, f"block {kind}, k long, unit array<double>, bits long, cell int, angle double, far long"))
        self.radius, self.far = np.full(len(pivots), -np.inf), np.full(len(pivots), -(1 << 20), np.int64)
        for r in self.rows.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("far").alias("far")).collect():  # a row for each pivot
            self.radius[r.cell], self.far[r.cell] = r.angle, r.far

    def meets(self, distance: int) -> Callable:
        """(units, bits, reach) of some rows -> for each of them which cells may hold a row within the angle `reach` or the Hamming distance (-1: none)."""
        if self.one:
            return lambda units, bits, reach: np.ones((len(bits), 1), bool)
        pivots, pivot_bits, radius, far = self.pivots, self.bits, self.radius, self.far

        def run(units, bits, reach):
            may = _angles(units, pivots) <= reach[:, None] + radius + SLACK
            return may | (_distances(bits, pivot_bits) <= distance + far) if distance >= 0 else may

        return run

    def visits(self, side: DataFrame, angle: float, distance: int, above_home: bool = False) -> DataFrame:
        """The pruning by itself, cell by cell: rows of side (block, k, unit, bits) once for each cell that they meet. above_home: only cells of larger numbers than the row's own `cell`."""
        meets = self.meets(distance)

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    _, u, b = _arrays(part)
                    may = meets(u, b, np.full(len(b), float(angle)))
                    if above_home:
                        may &= np.arange(may.shape[1]) > np.asarray(part.column("cell"))[:, None]
                    row, cell = np.nonzero(may)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("block", "k", "unit", "bits")), pa.array(cell.astype(np.int32))], ["block", "k", "unit", "bits", "visit"])

        kind = side.schema["block"].dataType.simpleString()
        wanted = ["block", "k", "unit", "bits"] + (["cell"] if above_home else [])
        return side.select(*wanted).mapInArrow(run, f"block {kind}, k long, unit array<double>, bits long, visit int").withColumnRenamed("visit", "cell")

    def dealt(self) -> tuple[DataFrame, DataFrame]:
        """The rows with their chunk `own` and the spans `of` their block; and each block's spans: for every cell its first and last chunk there."""
        block = Window.partitionBy("block")
        counts = self.rows.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(block.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        counts = counts.withColumn("wide", F.greatest(F.lit(self.size), F.least(F.ceil(F.sum("n").over(block) / CHUNKS), F.lit(self.wide))))
        chunk = lambda at: F.floor(at / F.col("wide"))
        counts = stored(counts.withColumn("span", F.shiftleft(chunk(F.col("before")), 32).bitwiseOR(chunk(F.col("before") + F.col("n") - 1))))
        spans = counts.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("cell", "span"))).alias("m"))
        spans = stored(spans.select("block", F.transform(F.sequence(F.lit(0), F.lit(self.cells - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(ABSENT))).alias("of")))
        places = counts.join(spans, "block").select("block", "cell", "n", "before", "wide", "of")
        rows = self.rows.join(places, ["block", "cell"]).withColumn("own", chunk(F.col("before") + F.pmod(F.xxhash64("k"), F.col("n"))).cast("int"))
        return rows.select("block", "k", "unit", "bits", "cell", "own", "of"), spans


_SIDE = "k long, unit array<double>, bits long, cell int, reach double"


def _copies(rows: DataFrame, meets: Callable) -> DataFrame:
    """Rows (block, k, unit, bits, cell, reach, own, of) once for each chunk of their block with a cell that they meet: `chunk`."""
    names = ["block", "k", "unit", "bits", "cell", "reach", "own"]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                _, u, b = _arrays(part)
                may = meets(u, b, np.asarray(part.column("reach"), np.float64))
                of = np.asarray(part.column("of").flatten()).reshape(part.num_rows, -1)
                first, last = of >> 32, of & (ABSENT - 1)
                row, chunk = np.nonzero(np.stack([(may & (first <= t) & (last >= t)).any(1) for t in range(int(last.max()) + 1)], 1))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in names), pa.array(chunk.astype(np.int32))], [*names, "chunk"])

    kind = rows.schema["block"].dataType.simpleString()
    return rows.select(*names, "of").mapInArrow(run, f"block {kind}, {_SIDE}, own int, chunk int")


_TYPES = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}


def _solved(rows: DataFrame, meets: Callable, solve: Callable, schema: str) -> DataFrame:
    """rows: block, i, j, one, other and the columns of a side. solve(keys, units, bits of some rows with `one`, the same of some with `other`, whether the two
    sides are the same chunk) for each tile of a group (block, i, j); the finds as block and `schema`."""
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        keys, units, bits = _arrays(group)
        one, other = (np.flatnonzero(np.asarray(group.column(c))) for c in ("one", "other"))
        if not len(one) or not len(other):
            return
        block, cell, reach = group.column("block")[0].as_py(), np.asarray(group.column("cell")), np.asarray(group.column("reach"))
        kind, same = group.schema.field("block").type, len(one) == len(other) == len(keys)
        may = np.concatenate([meets(units[at], bits[at], reach[at]) for at in np.split(one, range(TILE, len(one), TILE))])
        other = other[np.argsort(cell[other], kind="stable")]
        for at in np.split(other, range(TILE, len(other), TILE)):
            met = one[may[:, np.unique(cell[at])].any(1)]
            for some in np.split(met, range(TILE, len(met), TILE)) if len(met) else []:
                found = solve(keys[some], units[some], bits[some], keys[at], units[at], bits[at], same)
                if len(found[0]):
                    columns = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(found, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(found[0]), kind), *columns], names=["block", *(n for n, _ in fields)])

    kind = rows.schema["block"].dataType.simpleString()
    return rows.groupBy("block", "i", "j").applyInArrow(run, f"block {kind}, {schema}")


def _within(cells: Cells, reach: float, distance: int, solve: Callable, schema: str) -> DataFrame:
    """solve for the rows that meet, pairs of chunks i <= j once; with i = j each pair of rows comes both ways."""
    meets = cells.meets(distance)
    copies = _copies(cells.dealt()[0].withColumn("reach", F.lit(float(reach))), meets)
    low, high = F.least("own", "chunk"), F.greatest("own", "chunk")
    return _solved(copies.select("block", low.alias("i"), high.alias("j"), (F.col("own") == low).alias("one"), (F.col("own") == high).alias("other"), "k", "unit", "bits", "cell", "reach"), meets, solve, schema)


def _compared(visitors: DataFrame, cells: Cells, meets: Callable, solve: Callable, schema: str) -> DataFrame:
    """solve for visitors (block, k, unit, bits, reach) and the rows of the cells that they meet. A block's visitors are dealt to parts as rows are to chunks."""
    rows, spans = cells.dealt()
    counts = visitors.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    wide = F.greatest(F.lit(cells.size), F.least(F.ceil(F.col("m") / CHUNKS), F.lit(cells.wide)))
    parts = stored(counts.select("block", F.ceil(F.col("m") / wide).cast("int").alias("parts")))
    asked = visitors.join(parts.join(spans, "block"), "block").withColumn("own", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).withColumn("cell", F.lit(0))
    columns = [F.col(c) for c in ("k", "unit", "bits", "cell", "reach")]
    left = _copies(asked, meets).select("block", F.col("own").alias("i"), F.col("chunk").alias("j"), F.lit(True).alias("one"), F.lit(False).alias("other"), *columns)
    right = rows.join(parts, "block").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("reach", F.lit(0.0))
    return _solved(left.unionByName(right.select("block", "i", F.col("own").alias("j"), F.lit(False).alias("one"), F.lit(True).alias("other"), *columns)), meets, solve, schema)


def _angle(cosine: float) -> float:
    return math.acos(min(max(cosine, -1.0), 1.0))


def _once(ka, kb, i, j, same: bool) -> np.ndarray:
    return ka[i] < kb[j] if same else ka[i] != kb[j]  # a chunk with itself gives each pair twice


def near_pairs(rows: DataFrame, key: str, block: str | None, cosine: float, distance: int, size: int = 2048, pivots: int = 256) -> DataFrame:
    """Pairs a < b of one block (of all rows without one) with cosine >= `cosine` or Hamming distance <= `distance`: block, a, b, cos, ham."""
    side = _side(rows, key, block)
    cells = Cells(side, pivots, size)
    schema = "a long, b long, cos double, ham int"
    if cells.empty:
        return side.select("block", F.col("k").alias("a"), F.col("k").alias("b"), F.lit(0.0).alias("cos"), F.lit(0).alias("ham")).limit(0)

    def solve(ka, ua, ba, kb, ub, bb, same):
        cos, ham = ua @ ub.T, np.bitwise_count(ba[:, None] ^ bb[None, :])
        i, j = np.nonzero((cos >= cosine) | (ham <= distance))
        once = _once(ka, kb, i, j, same)
        i, j = i[once], j[once]
        return np.minimum(ka[i], kb[j]), np.maximum(ka[i], kb[j]), cos[i, j], ham[i, j].astype(np.int32)

    banded = not cells.one and 0 <= distance and _bands(side.count(), distance, 64)[1] <= MOST_COPIES
    found = _within(cells, _angle(cosine), -1 if banded else distance, solve, schema)
    if not banded:
        return found
    vector = lambda s: cells.rows.select(F.col("k").alias(s), F.col("unit").alias(f"u{s}"))
    more = banded_pairs(side, "k", distance, block="block").join(vector("a"), "a").join(vector("b"), "b")
    return found.unionByName(more.select("block", "a", "b", vx.dot("ua", "ub").alias("cos"), F.col("ham").cast("int").alias("ham"))).dropDuplicates(["a", "b"])


def _bands(n: int, distance: int, bits: int) -> tuple[list[int], int]:
    """Edges of the bands, and how many values of them a row is copied to."""
    m = max(2, min(distance + 1, max(-(-(distance + 1) // 4), round(bits / max(math.log2(max(n, 2)), 1)))))
    edges = [round(k * bits / m) for k in range(m + 1)]
    return edges, sum(math.comb(e - s, r) for s, e in zip(edges, edges[1:], strict=False) for r in range(distance // m + 1))


def banded_pairs(rows: DataFrame, key: str, distance: int, bits: int = 64, block: str | None = None) -> DataFrame:
    """All pairs a < b (of one block) within a Hamming distance, exactly. Of m bands one differs in at most distance // m bits, so one side stands under its
    own band values and the other under all values that near; m grows as bands of about log2(rows) bits fit, with at most 3 bits to flip. Where that takes more than
    MOST_COPIES copies of a row, all pairs of chunks are compared instead, 8 bytes a row."""
    edges, copies = _bands(rows.count(), distance, bits)
    if copies > MOST_COPIES:
        side = rows.select((F.col(block) if block else F.lit(0)).alias("block"), F.col(key).cast("long").alias("k"), F.array(F.lit(0.0)).alias("unit"), F.col("bits").alias("bits"))
        cells = Cells(side.where("block is not null and k is not null and bits is not null"), 0, TILE)

        def solve(ka, ua, ba, kb, ub, bb, same):
            ham = np.bitwise_count(ba[:, None] ^ bb[None, :])
            i, j = np.nonzero(ham <= distance)
            once = _once(ka, kb, i, j, same)
            i, j = i[once], j[once]
            return np.minimum(ka[i], kb[j]), np.maximum(ka[i], kb[j]), ham[i, j].astype(np.int32)

        found = _within(cells, 0.0, distance, solve, "a long, b long, ham int")
        return found.select(*([F.col("block").alias(block)] if block else []), "a", "b", "ham")
    m = len(edges) - 1
    wide = [e - s for s, e in zip(edges, edges[1:], strict=False)]
    value = lambda s, e: F.shiftrightunsigned("bits", bits - e).bitwiseAND(F.lit((1 << (e - s)) - 1))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), value(edges[k], edges[k + 1]).alias("value")) for k in range(m)])
    on = [block] if block else []
    cut = rows.select(*on, F.col(key).alias("id"), "bits", F.explode(bands).alias("x")).select(*on, "id", "bits", "x.band", "x.value")
    flips = {w: [sum(1 << p for p in some) for r in range(distance // m + 1) for some in combinations(range(w), r)] for w in set(wide)}
    masks = F.array(*[F.array(*[F.lit(f).cast("long") for f in flips[w]]) for w in wide])
    near = cut.withColumn("flip", F.explode(F.get(masks, F.col("band")))).withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    left, right = near.withColumnsRenamed({"id": "a", "bits": "ba"}), cut.withColumnsRenamed({"id": "b", "bits": "bb"})
    # neither side is small: the optimiser does not see what explode adds and would broadcast the copies
    pairs = left.join(right.hint("merge"), [*on, "band", "value"]).where("a < b").withColumn("ham", F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))))
    return pairs.where(F.col("ham") <= distance).select(*on, "a", "b", "ham").distinct()


def nearest(queries: DataFrame, base: DataFrame, key: str, block: str, size: int = 2048, pivots: int = 256) -> DataFrame:
    """Per query of `key`: the largest cosine to the base rows of its block, 0 where the block has none. Queries visit the cell that they are nearest to, then only
    cells that may hold a nearer row than the best one found there."""
    solve = lambda ka, ua, ba, kb, ub, bb, same: (ka, (ua @ ub.T).max(1))
    cells = Cells(_side(base, key, block), pivots, size)
    asked = _side(queries, key, block)
    if cells.empty:
        return queries.select(key, F.lit(0.0).alias("near_cos"))
    best = lambda visitors, meets: _compared(visitors, cells, meets, solve, "k long, cos double").groupBy("k").agg(F.max("cos").alias("cos"))
    finish = lambda found: queries.select(key).join(found.select(F.col("k").alias(key), "cos"), key, "left").select(key, F.coalesce("cos", F.lit(0.0)).alias("near_cos"))
    anywhere = asked.withColumn("reach", F.lit(math.pi))
    if cells.one:
        return finish(best(anywhere, cells.meets(-1)))
    home = cells.pivots
    at_home = lambda units, bits, reach: (units @ home.T).argmax(1)[:, None] == np.arange(len(home))
    first = stored(best(anywhere, at_home))
    bound = asked.join(first, "k", "left").withColumn("reach", F.coalesce(F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))), F.lit(math.pi))).drop("cos")
    return finish(best(bound, cells.meets(-1)))


def unleaked(candidates: DataFrame, protected: DataFrame, key: str, cosine: float, distance: int, size: int = 2048, pivots: int = 256) -> DataFrame:
    """Candidates with no protected row near them."""

    def solve(ka, ua, ba, kb, ub, bb, same):
        near = (ua @ ub.T >= cosine) | (np.bitwise_count(ba[:, None] ^ bb[None, :]) <= distance)
        return (ka[near.any(1)],)

    cells = Cells(_side(protected, key, None), pivots, size)
    if cells.empty:
        return candidates
    visitors = _side(candidates, key, None).withColumn("reach", F.lit(_angle(cosine)))
    hit = _compared(visitors, cells, cells.meets(distance), solve, "k long").select(F.col("k").alias(key)).distinct()
    return candidates.join(hit, key, "left_anti")
