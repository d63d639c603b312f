"""Benchmark decontamination by word windows (DataFrame functions only).

Words are runs of letters and digits, a-z and A-Z alike, and of anything beyond ASCII. A benchmark item gives its windows of `width`
consecutive words, an item of fewer words itself as one shorter window. The 64-bit hashes of the distinct windows are broadcast while their size stays
below `broadcast_bytes`, else both sides are joined by hash; the hashes of all windows of the documents are scanned against them, and each hit is
verified on the words of the document before it counts. A document word inside a verified hit is hit.

No step gathers more than the hits of one document, which are at most its words. Hits are shuffled by document, whole texts only where more
documents are hit than a broadcast of their keys may hold.

Defined results: a null or empty text has no words and no hits; a null item_id marks words but is no item of any list; rows that repeat an item_id are one
item; rows with the same doc_id and text get the same result; null doc_ids are reported as such; texts of any length are read whole; an empty table of
documents gives an empty result and an empty benchmark hits nothing; extra columns are ignored by `report` and carried through by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import LOWER, UPPER, fresh, let, materialise, remove, table, text_of

IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def words(text: Column) -> Column:
    """By splitting: collecting the matches of a pattern costs time in the square of a text's length."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """Distinct (item_id, k, window), window as its words joined by blanks."""

    def cut(w: Column) -> Column:
        k = F.least(F.size(w), F.lit(width))
        starts = F.when(k > 0, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(k.alias("k"), F.array_join(F.slice(w, i, k), " ").alias("window")))

    return items.select("item_id", F.explode(let(words(text_of()), cut)).alias("x")).select("item_id", "x.k", "x.window").distinct()


def window_hashes(w: Column, k: int) -> Column:
    """A hash of each window of k words: hashes of 1, 2, 4, ... words are put together pair by pair, so that a window costs about log2(k) hashes of two numbers."""

    def grown(one: Column, power: int, have: Column | None, length: int) -> Column:
        """one: hashes of `power` words from each place; have: those of the `length` words that the lower bits of k ask for."""
        if k & power:
            have, length = (one, power) if have is None else (_pairs(have, one, length), length + power)
        if 2 * power > k:
            return F.slice(have, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))
        return let(_pairs(one, one, power), lambda two: grown(two, 2 * power, have, length))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda one: grown(one, 1, None, 0))


def _pairs(left: Column, right: Column, apart: int) -> Column:
    """At each place the hash of left there and of right `apart` places on; places too near to the end hold values that nothing reads."""
    return F.zip_with(left, F.slice(right, F.lit(apart + 1), F.size(right)), lambda x, y: F.xxhash64(x, y))


def _small(df: DataFrame, rows: int, row_bytes: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= most else df


def verified_hits(docs: DataFrame, windows: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs: doc_id, text; windows: (k, window), distinct. Per (doc_id, text_hash) with hits: hits, an array of (pos, k, window) in text order."""
    lengths = windows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("window")).alias("bytes")).orderBy("k").collect()
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    if not lengths:
        return keyed.limit(0).select("doc_id", "text_hash", F.array().cast("array<struct<pos:int,k:int,window:string>>").alias("hits"))
    rows, row_bytes = sum(r.n for r in lengths), 64 + sum(r.bytes for r in lengths) // max(sum(r.n for r in lengths), 1)
    own_hash = F.coalesce(*[F.when(F.col("k") == r.k, F.get(window_hashes(F.split("window", " "), r.k), F.lit(0))) for r in lengths])
    hashed = _small(windows.select(own_hash.alias("h"), "k", "window"), rows, row_bytes, broadcast_bytes)

    def hashes(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.concat(*[window_hashes(w, r.k) for r in lengths]).alias("h"))

    # the outer form, since the optimiser filters the other one by the size of the array, for which it makes the array twice
    scanned = keyed.select("doc_id", "text_hash", let(words(F.col("text")), hashes).alias("x")).select("doc_id", "text_hash", "x.n", F.posexplode_outer("x.h").alias("at", "h"))
    found = scanned.join(hashed, "h")
    # the windows of one length stand behind those of all shorter ones
    before, start = F.lit(0), None
    for r in lengths:
        start = F.when(F.col("k") == r.k, before) if start is None else start.when(F.col("k") == r.k, before)
        before = before + F.greatest(F.col("n") - (r.k - 1), F.lit(0))
    found = found.select("doc_id", "text_hash", (F.col("at") - start + 1).alias("pos"), "k", "window").where("pos > 0").distinct()
    gathered = materialise(found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "window"))).alias("hits")), "hits")
    n = gathered.count()
    own = gathered.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    texts = keyed.join(_small(own, n, 64, broadcast_bytes), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), words(F.col("text")).alias("w"))
    true = F.filter("hits", lambda x: F.array_join(F.slice(F.col("w"), x["pos"], x["k"]), " ") == x["window"])
    return gathered.join(texts, same).select("doc_id", "text_hash", true.alias("hits")).where(F.size("hits") > 0)


def _covered(hits: Column) -> Column:
    """The numbers, from 1, of the words inside hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["k"] - 1))))


def report(docs: DataFrame, items: DataFrame, width: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    of_items = materialise(item_windows(items, width), "item_windows")
    hits = materialise(verified_hits(docs, of_items.select("k", "window").distinct(), broadcast_bytes), "verified")
    met = hits.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("hits", lambda x: x["window"]))).alias("window"))
    named = of_items.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item"))
    items_met = met.join(named, "window").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_text = hits.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), F.size(_covered(F.col("hits"))).alias("n_hit"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))
    found = per_text.join(items_met, same, "left").select("id_", "hash_", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    sized = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), F.size(F.array_remove(F.split(text_of(), BETWEEN), "")).cast("long").alias("n_words"))
    rows = sized.join(found, same, "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def without_spans(text: Column, hits: Column) -> Column:
    """The text without the words inside hits and what stands between two of them; the rest as it was."""

    def cut(x: Column) -> Column:
        pieces, covered = x["pieces"], x["covered"]
        shift = F.when(F.rlike(F.get(pieces, F.lit(0)), F.lit("^" + IN_WORD)), 1).otherwise(0)
        place = lambda word: word * 2 - shift
        starts = F.filter(covered, lambda c, i: (i == 0) | (F.get(covered, i - 1) != c - 1))
        ends = F.filter(covered, lambda c, i: (i == F.size(covered) - 1) | (F.get(covered, i + 1) != c + 1))
        return let(F.struct(starts.alias("starts"), ends.alias("ends")), lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.size(r["starts"])), lambda i: let(
            F.when(i == 0, 1).otherwise(place(F.get(r["ends"], i - 1)) + 1),
            lambda a: F.array_join(F.slice(pieces, a, F.greatest(F.coalesce(place(F.get(r["starts"], i)), F.size(pieces) + 1) - a, F.lit(0))), ""))), ""))

    pieces = F.regexp_extract_all(text, F.lit(f"{IN_WORD}|{BETWEEN}"), F.lit(0))
    return let(F.struct(pieces.alias("pieces"), F.array_sort(_covered(hits)).alias("covered")), cut)


def decontaminate(docs: DataFrame, items: DataFrame, remove_: str = "documents", width: int = 10, **options) -> DataFrame:
    """The rows of docs with all their columns: without contaminated rows, or, for remove_ = "spans", with the hit spans cut out of their texts."""
    if remove_ not in ("documents", "spans"):
        raise ValueError(f"remove_ is documents or spans, not {remove_}")
    of_items = materialise(item_windows(items, width), "item_windows")
    hits = materialise(verified_hits(docs, of_items.select("k", "window").distinct(), **options), "verified")
    remove(of_items)
    key, hash_, spans = fresh(docs, "doc_id_"), fresh(docs, "hash_"), fresh(docs, "hits_")
    hits = hits.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hash_), F.col("hits").alias(spans))
    same = docs["doc_id"].eqNullSafe(hits[key]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hits[hash_])
    if remove_ == "documents":
        return docs.join(hits, same, "left_anti")
    cut = F.when(F.col(spans).isNull(), docs["text"]).otherwise(without_spans(docs["text"], F.col(spans)))
    return docs.join(hits, same, "left").select(*[cut.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
h AS (SELECT p.doc_id, item_id, i, p.k FROM p JOIN v ON p.s = v.s),
c AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS word FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
