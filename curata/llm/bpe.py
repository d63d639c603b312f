"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a rank file (base64 token, rank). Its merges are every split of a token into two tokens of the file, in
the order of the tokens' ranks; whole pieces that are tokens are taken as they are (`ignore_merges`), which gives the ids
of the byte-pair rule that merges the pair of lowest rank first. Bytes are written as printable characters by a
byte-to-character table; decoding reverses that table and joins bytes before any UTF-8 decoding, so that characters split over
tokens come back whole.

Defined results: a null text counts as empty and has no ids; texts of any length are encoded whole; special tokens do not exist;
repeated rows are encoded each; an empty table gives an empty result; extra columns are carried through by `encode`. Memory
is that of one Arrow batch, which `encode` cuts into slices of at most `slice_chars` characters (or one text).
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from curata.llm.common import fresh, table

_CODECS: dict = {}


def byte_table() -> list[str]:
    """Printable stand-ins for the 256 bytes: printable Latin-1 characters stay, the rest follow from U+0100 on."""
    stay = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in stay else chr(next(rest)) for b in range(256)]


#: Fixed value: the public pattern for which a single space between two other characters always starts a match.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space beside which a single space need not start a match, and rarer white space, which is left to the pattern alone.
_BESIDE = ("  ", *(x for c in "\t\n\v\f\r" for x in (c + " ", " " + c)))
_RARE = tuple(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class _Kept(dict):
    """A bounded table in two generations: entries that are used again move to the young one, the old one is dropped."""

    def __init__(self, make, keep: int, longest: int = 64):
        self.make, self.keep, self.longest, self.old = make, keep, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one rank file; built once per Python process by `codec`.

    A text is cut into its pattern matches; the library's model encodes each distinct match once, and bounded tables
    keep the ids of short ones (`keep` entries; a full one starts anew, which changes the time only). With the pattern
    SPACE_LED, texts whose spaces all stand alone are first cut before each space, and ids are kept for what lies between.
    """

    def __init__(self, path: str, pattern: str, keep: int = 250_000):
        import regex
        from tokenizers.models import BPE

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        table = byte_table()
        name = {token: "".join(map(table.__getitem__, token)) for token in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
        reverse = {c: b for b, c in enumerate(table)}
        by_id = {r: bytes(reverse[c] for c in name[t]) for t, r in ranks.items()}
        self.bytes_of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.matches = regex.compile(pattern).findall
        self.stand_in = dict(enumerate(table))
        self.pieces = _Kept(self.one_match, keep // 2)
        self.words = _Kept(lambda word: self.by_match(" " + word), keep) if pattern == SPACE_LED else None

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.words is not None and not any(x in text for x in _BESIDE) and (text.isascii() or not any(x in text for x in _RARE)) and not any(x in text for x in _RARE[:4]):
            first, *rest = text.split(" ")
            return self.by_match(first) + b"".join(map(self.words.__getitem__, rest))
        return self.by_match(text)

    def one_match(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.stand_in))
        ids = array("I", [t.id for t in tokens])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def by_match(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.matches(text)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(self.packed(t), "<u4").tolist() for t in texts]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Per token, the characters of the text that it covers; tokens within one character share that character."""
        ends = np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(self.packed(text), "<u4")])
        char_of = np.repeat(np.arange(len(text)), [len(c.encode("utf-8", "surrogatepass")) for c in text])
        starts = np.concatenate(([0], ends[:-1])).astype(int) if len(ends) else ends
        return [(int(char_of[a]), int(char_of[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
        gc.freeze()  # the collector need not scan these tables again and again; it goes on with what comes later
    return _CODECS[key]


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most `most` characters, or of one text."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > most:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", slice_chars: int = 1 << 20, offsets: bool = False) -> DataFrame:
    """docs with their columns and ids (array of int); with `offsets` also token_start and token_end in characters."""
    ids_name, start_name, end_name = (fresh(docs, c) for c in ("ids", "token_start", "token_end"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_name, ints), *([T.StructField(start_name, ints), T.StructField(end_name, ints)] if offsets else [])])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in slices(texts, slice_chars):
                part = batch.slice(a, b - a)
                columns = [*part.columns, pa.array(own.encode(texts[a:b]), pa.list_(pa.int32()))]
                names = [*part.schema.names, ids_name]
                if offsets:
                    spans = [own.offsets(t) for t in texts[a:b]]
                    columns += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
                    names += [start_name, end_name]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", slice_rows: int = 256) -> DataFrame:
    """encoded with text_bytes, the exact bytes of the ids; null ids give empty bytes."""
    out = fresh(encoded, "text_bytes")
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, slice_rows):
                part = batch.slice(a, slice_rows)
                data = [own.decode_bytes(x or ()) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, out])

    return encoded.mapInArrow(run, schema)


def encoded_with_digests(docs: DataFrame, path: str, pattern: str, slice_chars: int = 1 << 20, columns: tuple = ("doc_id", "lang", "source"), ids: bool = True) -> DataFrame:
    """Per row the named columns, n_tokens, ids, ids_sha256, decoded_sha256: encoding and decoding in one pass, so that without
    `ids` they do not leave the worker."""
    base = docs.select(*columns, "text")
    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in columns)
    names = [*columns, "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts, slice_chars):
                packed = [own.packed(t) for t in texts[a:b]]
                numbers = [np.frombuffer(p, "<u4") for p in packed]
                ends = np.cumsum([0, *map(len, numbers)])
                out = [pa.array(np.diff(ends), pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(numbers).astype(np.int32))))
                out.append(pa.array([hashlib.sha256(p).hexdigest() for p in packed]))
                out.append(pa.array([hashlib.sha256(own.decode_bytes(n.tolist())).hexdigest() for n in numbers]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *out], names)

    return base.mapInArrow(run, f"{kinds}, n_tokens long, {'ids array<int>, ' if ids else ''}ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoded_with_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, columns=("doc_id",), ids=False)
