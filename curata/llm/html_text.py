"""Main text of web pages: page structure first, then a suffix array over each host's pages.

A page is cut into blocks at block-level tags. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are set aside; blocks inside the page's article are its text as they stand. For blocks that
the structure does not decide (pages without an article element), runs of at least `depth` tokens that occur on two or more
distinct pages of the host are removed as boilerplate, and the unique runs stay.

The suffix array of a host is never in one place. Each suffix is dealt by its anchor, the least hash of a few tokens in a row among its first
`depth`, so suffixes that agree in `depth` tokens meet whatever the size of the host. Neighbouring suffixes mostly share an anchor and travel as one
piece of text; pages first send their anchors only, and pieces only of those that stand on two rows, one of them undecided. Equal pieces are reduced to one
before they meet, and each task sorts the suffixes of some anchors by prefix doubling (`repeated`). Suffixes of an anchor on more
than `crowd` rows are dealt by all their `depth` tokens. A join brings the covered tokens back to the undecided pages. `shard_texts` does the same for
pages in memory; tests compare both, and both with plain loops.

Defined results: a null or empty html gives an empty text and 0; null urls share the host ""; whole pages of any length are read;
repeated rows give repeated results (the same page_id is not a distinct page); an empty table gives an empty result; extra columns
are ignored. An unclosed set-aside element ends where an article or main element starts; unclosed comments and scripts run to the end.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import hash_spans, materialise, mix, table, word_spans

#: Element names of HTML by what they do here.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object noembed noframes xmp".split())
ASIDE = frozenset("nav footer aside form menu dialog button select fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
#: Words of class, id or role that mark a set-aside element.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|menu|modal|nav|navbar|navigation|newsletter|notice|alert|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|contentinfo|complementary|search)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}

SET_ASIDE, ARTICLE, OPEN = 0, 1, 2


def blocks(html: str | None) -> tuple[list[str], list[int]]:
    """The page's blocks in order and what the structure says of each."""
    html = html or ""
    texts: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, set aside, article
    aside = inside = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                texts.append(text)
                kinds.append(SET_ASIDE if aside else ARTICLE if inside else OPEN)

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            parts.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush()
                    for _, a, c in stack[i:]:
                        aside -= a
                        inside -= c
                    del stack[i:]
                    break
            continue
        if name in RAW:
            closing = _CLOSE[name].search(html, at)
            at = end if closing is None else html.find(">", closing.start()) + 1 or end
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        is_content = name in CONTENT
        named = " ".join(x for g in _NAMED.findall(m[3]) for x in g if x) if m[3] else ""
        marked = bool(named and MARKED.search(named))
        if is_content and not marked and not inside and aside:
            stack, aside = [(n, False, c) for n, a, c in stack], 0
        is_aside = marked or name in ASIDE or name == "header" and not inside
        if is_aside or is_content or name in BLOCK:
            if is_aside:
                flush()
            stack.append((name, is_aside, is_content))
            aside += is_aside
            inside += is_content
    flush()
    if ARTICLE in kinds:
        kinds = [SET_ASIDE if k == OPEN else k for k in kinds]
    return texts, kinds


def repeated(tokens: np.ndarray, low: np.ndarray, depth: int, high: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a run of `depth` tokens that occurs on two or more pages. tokens: ids of the concatenated streams, with a
    unique negative id after each; low, high: for each token the least and greatest page that holds its stream (one page where high is
    left out). The suffix array is built by prefix doubling, no further than needed."""
    high = low if high is None else high
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < depth:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        have += step
    order = np.argsort(rank, kind="stable")  # the suffix array, sorted to `depth` tokens
    groups = rank[order]
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    least, most = np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)
    ends = np.concatenate(([0], np.cumsum(tokens < 0)))
    whole = np.zeros(n, bool)  # suffixes with `depth` tokens before their stream ends
    whole[: n - depth + 1] = ends[depth:] == ends[: n - depth + 1]
    common = order[np.repeat(least != most, np.diff(np.concatenate((starts, [n])))) & whole[order]]
    marks = np.zeros(n + depth + 1, np.int64)
    np.add.at(marks, common, 1)
    np.add.at(marks, common + depth, -1)
    covered[:] = np.cumsum(marks)[:n] > 0
    return covered


def page_text(texts: list[str], kinds: list[int], covered: np.ndarray) -> str:
    """The main text of a page. covered: which of its tokens are boilerplate."""
    keep, at = [], 0
    for text, kind in zip(texts, kinds, strict=True):
        words = text.split(" ")
        if kind == ARTICLE:
            keep.append(text)
        elif kind == OPEN:
            unique = " ".join(w for w, c in zip(words, covered[at : at + len(words)], strict=True) if not c)
            if unique:
                keep.append(unique)
        at += len(words)
    return "\n\n".join(keep)


def shard_texts(pages: list, texts: list[list[str]], kinds: list[list[int]], depth: int) -> list[str]:
    """The main text of each of some pages of one host that are held in memory."""
    ids: dict[str, int] = {}
    stream: list[int] = []
    owner: list[int] = []
    number: dict = {}
    starts = []
    for i, (page, own) in enumerate(zip(pages, texts, strict=True)):
        before = len(stream)
        starts.append(before)
        for text in own:
            stream += [ids.setdefault(t, len(ids)) for t in text.split(" ")]
        stream.append(-1 - i)
        owner += [number.setdefault(page, len(number))] * (len(stream) - before)
    covered = repeated(np.array(stream, np.int64), np.array(owner, np.int64), depth)
    return [page_text(own, own_kinds, covered[at:]) for own, own_kinds, at in zip(texts, kinds, starts, strict=True)]


def token_streams(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The token streams of some pages, one after the other: their bytes, and of each token its start, end, hash and page."""
    raw, starts, ends = word_spans("\n".join(" ".join(own) for own in texts).encode("utf-8", "surrogatepass"))
    page = np.repeat(np.arange(len(texts)), [sum(t.count(" ") + 1 for t in own) for own in texts])
    return raw, starts, ends, hash_spans(raw, starts, ends), page


def folded(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` tokens from each position."""
    n = max(len(tokens) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if n else 0):
            out = mix(out + tokens[k : k + n])
    return out


def anchors(tokens: np.ndarray, page: np.ndarray, sites: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes with `depth` tokens of their page ahead, and the anchor of each: the least hash of half as many tokens in a row
    among those, mixed with the page's site. Suffixes of a site that agree in `depth` tokens have the same anchor."""
    n = len(tokens) - depth + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = max(depth // 2, 1)
    grams = folded(tokens, half)
    least = grams[:n].copy()
    for k in range(1, depth - half + 1):
        np.minimum(least, grams[k : k + n], out=least)
    at = np.flatnonzero(page[:n] == page[depth - 1 :])
    with np.errstate(over="ignore"):
        return at, mix(least[at] + sites[page[at]]).view(np.int64)


def cut_pieces(tokens: np.ndarray, page: np.ndarray, at: np.ndarray, key: np.ndarray, wanted: np.ndarray, crowded: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches that hold neighbouring suffixes of one wanted anchor, each to `depth` tokens: first token, end and key. A suffix
    of a crowded anchor is a stretch of its own with a key of all its `depth` tokens."""
    keep = np.isin(key, wanted)
    at, key = at[keep], key[keep]
    alone = np.isin(key, crowded)
    if alone.any():
        with np.errstate(over="ignore"):
            key[alone] = mix(folded(tokens, depth)[at[alone]] + key[alone].view(np.uint64)).view(np.int64)
    cut = np.flatnonzero((np.diff(at) != 1) | (page[at[1:]] != page[at[:-1]]) | (key[1:] != key[:-1]) | alone[1:] | alone[:-1]) + 1
    first, last = np.concatenate(([0], cut))[: len(at)].astype(np.int64), np.concatenate((cut, [len(at)]))[: len(at)].astype(np.int64) - 1
    return at[first], at[last] + depth, key[first]


def sorted_pieces(hosts: list[str], pieces: list[str], low: list, high: list, no_id: list[bool], depth: int) -> list[bytes]:
    """The suffix array over some distinct pieces; low, high, no_id: the page ids that hold each. Per piece its covered tokens as bits, empty if none."""
    number = {p: i for i, p in enumerate(sorted({p for p in (*low, *high) if p is not None}))} | {None: -1}
    site = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
    hashes, counts = [], []
    for a in range(0, len(pieces), 4096):
        _, _, _, own, piece = token_streams([[p] for p in pieces[a : a + 4096]])
        hashes.append(own)
        counts.append(np.bincount(piece, minlength=len(pieces[a : a + 4096])))
    count = np.concatenate(counts)
    with np.errstate(over="ignore"):
        _, ids = np.unique(mix(np.concatenate(hashes) + mix(np.repeat(np.array([site[h] for h in hosts], np.uint64), count))), return_inverse=True)
    ends = np.cumsum(count)
    covered = repeated(
        np.insert(ids.astype(np.int64), ends, -1 - np.arange(len(pieces))),
        np.repeat(np.array([-1 if n else number[p] for p, n in zip(low, no_id, strict=True)], np.int64), count + 1),
        depth,
        np.repeat(np.array([number[p] for p in high], np.int64), count + 1),
    )
    at = np.concatenate(([0], ends + np.arange(1, len(pieces) + 1)))
    return [np.packbits(covered[a : b - 1]).tobytes() if covered[a:b].any() else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def slices(batch: pa.RecordBatch, rows: int = 64, chars: int = 1 << 20):
    """A batch of pages in slices of bounded length, or of one page."""
    sizes = [sum(map(len, own)) for own in batch.column("blocks").to_pylist()]
    a = size = 0
    for b, more in enumerate(sizes):
        if b > a and (b - a >= rows or size + more > chars):
            yield batch.slice(a, b - a)
            a, size = b, 0
        size += more
    if a < batch.num_rows:
        yield batch.slice(a)


def suffix_marks(parsed: DataFrame, depth: int, crowd: int, bucket: int) -> DataFrame:
    """parsed: uid, page_id, host, site, undecided, blocks. Per undecided page with repeated runs: uid, marks (where a piece starts, its covered tokens)."""
    id_type = parsed.schema["page_id"].dataType.simpleString()

    def anchors_of(batches):
        for batch in batches:
            for part in slices(batch):
                _, _, _, tokens, page = token_streams(part.column("blocks").to_pylist())
                at, key = anchors(tokens, page, part.column("site").to_numpy().view(np.uint64), depth)
                of = page[at]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))[: len(at)]
                key, of = key[new], of[new]
                order = np.lexsort((key, of))
                key, of = key[order], of[order]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))[: len(key)]
                row = pa.array(of[new])
                yield pa.RecordBatch.from_arrays([part.column(c).take(row) for c in ("uid", "undecided")] + [pa.array(key[new])], ["uid", "undecided", "k"])

    def pieces_of(batches):
        for batch in batches:
            for part in slices(batch):
                raw, starts, ends, tokens, page = token_streams(part.column("blocks").to_pylist())
                at, key = anchors(tokens, page, part.column("site").to_numpy().view(np.uint64), depth)
                wanted, crowded = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("wanted", "crowded"))
                first, end, key = cut_pieces(tokens, page, at, key, wanted, crowded, depth)
                data, of = raw.tobytes(), page[first]
                before = np.searchsorted(page, np.arange(part.num_rows))
                texts = pa.array([data[a:b] for a, b in zip(starts[first].tolist(), ends[end - 1].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(of)) for c in ("uid", "page_id", "host", "undecided")] + [pa.array(first - before[of]), pa.array(key), texts], ["uid", "page_id", "host", "undecided", "at", "k", "piece"])

    def solve(t: pa.Table) -> pa.Table:
        columns = [t.column(c).to_pylist() for c in ("host", "piece", "low", "high", "no_id")]
        columns[1] = [p.decode("utf-8", "surrogatepass") for p in columns[1]]
        out = pa.table({"k": t.column("k"), "h": t.column("h"), "covered": pa.array(sorted_pieces(*columns, depth), pa.binary())})
        return out.filter(pc.greater(pc.binary_length(out.column("covered")), 0))

    pages_of = [F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.max(F.col("page_id").isNull()).alias("no_id")]
    keys = parsed.mapInArrow(anchors_of, "uid long, undecided boolean, k long")
    found = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("undecided").alias("asked"))
    found = found.where("asked and n > 1").select("k", (F.col("n") > crowd).alias("crowded"))
    wanted = keys.select("uid", "k").join(found, "k").groupBy("uid").agg(F.collect_list("k").alias("wanted"), F.collect_list(F.when(F.col("crowded"), F.col("k"))).alias("crowded"))
    pieces = parsed.join(wanted, "uid").mapInArrow(pieces_of, f"uid long, page_id {id_type}, host string, undecided boolean, at long, k long, piece binary")
    pieces = materialise(pieces.withColumn("h", F.xxhash64("piece")), "page_pieces")
    buckets = pieces.count() // bucket + 1
    distinct = pieces.groupBy("host", "k", "h", "piece").agg(*pages_of).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)))
    arrays = distinct.groupBy("bucket").applyInArrow(solve, "k long, h long, covered binary")
    return pieces.where("undecided").select("uid", "at", "k", "h").join(arrays, ["k", "h"]).groupBy("uid").agg(F.collect_list(F.struct("at", "covered")).alias("marks"))


def extract(pages: DataFrame, depth: int = 16, crowd: int = 4096, bucket: int = 32768, few: int = 10000) -> DataFrame:
    """pages: page_id, url, html. Per row: page_id, url, text, n_chars. crowd: rows that an anchor may stand on before its suffixes are dealt
    apart; bucket: pieces that a task sorts at a time, about; few: hosts with undecided pages up to which the other hosts are left out beforehand."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("host", host).withColumn("site", F.xxhash64("host"))

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                found = [blocks(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("page_id", "url", "host", "site")] + [pa.array([t for t, _ in found], pa.list_(pa.string())), pa.array([bytes(k) for _, k in found], pa.binary()), pa.array([OPEN in k for _, k in found], pa.bool_())], ["page_id", "url", "host", "site", "blocks", "kinds", "undecided"])

    parsed = rows.mapInArrow(cut, f"page_id {id_type}, url string, host string, site long, blocks array<string>, kinds binary, undecided boolean")
    parsed = materialise(parsed.withColumn("uid", F.monotonically_increasing_id()), "page_blocks")

    def solve(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                out = []
                for texts, kinds, marks in zip(*(part.column(c).to_pylist() for c in ("blocks", "kinds", "marks")), strict=True):
                    covered = np.zeros(0, bool)
                    if OPEN in kinds:
                        n = sum(t.count(" ") + 1 for t in texts)
                        covered = np.zeros(n + 8, bool)
                        for mark in marks or []:
                            bits = np.unpackbits(np.frombuffer(mark["covered"], np.uint8)).view(bool)
                            covered[mark["at"] : mark["at"] + len(bits)] |= bits
                        covered = covered[:n]
                    out.append(page_text(texts, list(kinds), covered))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    wanted = ["page_id", "url", "blocks", "kinds", "marks"]
    undecided = parsed.where("undecided")
    ready = parsed.withColumn("marks", F.lit(None).cast("array<struct<at:bigint,covered:binary>>"))
    if not undecided.isEmpty():
        some, hosts = parsed.select("uid", "page_id", "host", "site", "undecided", "blocks"), undecided.select("host").distinct()
        if hosts.limit(few + 1).count() <= few:  # else a join would shuffle all texts to leave out some anchors
            some = some.join(F.broadcast(hosts), "host", "left_semi")
        marks = suffix_marks(some, depth, crowd, bucket)
        ready = ready.where("not undecided").select(*wanted).unionByName(undecided.join(marks, "uid", "left").select(*wanted))
    return ready.select(*wanted).mapInArrow(solve, f"page_id {id_type}, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: For pages with one article of h1, p, b and br, as the tables hold; the tests compare other pages with a brute-force version.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(a, '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS parts FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
