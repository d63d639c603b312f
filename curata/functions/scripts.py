"""Transliteration by tables of code point sequences: at each place the longest entry is replaced, what no entry begins is kept.

All is column expressions. Single code points that become one or none go by `translate`. Longer entries are set apart by one pass of a regular expression whose alternatives stand longest first,
then looked up; the passes are linear in the text (collecting the matches of a pattern is not). Tables for the Indic scripts come from a rule: their Unicode blocks keep the same letters at the same places.

Defined results: null stays null, the empty text empty; an empty table changes nothing; texts may hold any code point, the separator too.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\x01"


def transliterate(text: Column, table: dict[str, str]) -> Column:
    if "" in table or any(_MARK in k for k in table):
        raise ValueError("entries are not empty and do not hold U+0001")
    singles = {k: v for k, v in table.items() if len(k) == 1 and len(v) <= 1}
    letters = sorted(singles, key=lambda k: not singles[k])  # `translate` drops those at the end that have no counterpart
    one_by_one = lambda c: F.translate(c, "".join(letters), "".join(singles[k] for k in letters)) if letters else c
    entries = sorted(table.keys() - singles.keys(), key=lambda k: (-len(k), k))
    if not entries:
        return one_by_one(text)
    used = set("".join(table))
    at, itself = [_MARK + chr(n) for n in range(2, len(used) + 4) if chr(n) not in used][:2]  # set an entry apart; stand for the mark in the text. No entry holds them
    # what is no entry here takes one code point, as singles do, so the places of longer entries do not depend on singles
    found = "(" + "|".join("".join(f"\\x{{{ord(c):x}}}" for c in k) for k in entries) + ")"
    apart = F.split(F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(itself)), found, f"{at}$1{at}"), at)
    by_first: dict[str, dict[str, str]] = {}  # a lookup scans a map, so entries are grouped by their first code point
    for k in entries:
        by_first.setdefault(k[0], {})[k] = table[k]
    groups = F.create_map(*[F.lit(x) if isinstance(x, str) else x for c, m in by_first.items() for x in (c, F.create_map(*[F.lit(y) for pair in m.items() for y in pair]))])
    said = F.transform(apart, lambda part, i: F.when(i % 2 == 1, F.element_at(F.element_at(groups, F.substring(part, 1, 1)), part)).otherwise(one_by_one(part)))
    return F.replace(F.array_join(said, ""), F.lit(itself), F.lit(_MARK))


#: The scripts of the spoken languages and where their Unicode blocks begin.
SCRIPTS = {"hi": "DEVANAGARI", "mr": "DEVANAGARI", "bn": "BENGALI", "as": "BENGALI", "te": "TELUGU", "ta": "TAMIL", "gu": "GUJARATI", "kn": "KANNADA", "or": "ORIYA", "ml": "MALAYALAM", "pa": "GURMUKHI"}
BLOCKS = {"DEVANAGARI": 0x0900, "BENGALI": 0x0980, "GURMUKHI": 0x0A00, "GUJARATI": 0x0A80, "ORIYA": 0x0B00, "TAMIL": 0x0B80, "TELUGU": 0x0C00, "KANNADA": 0x0C80, "MALAYALAM": 0x0D00}
#: Letters that a script lacks, by those that stand for them (Tamil writes one letter for the four stops of a series).
STAND_INS = {
    "TAMIL": {"KHA": "KA", "GA": "KA", "GHA": "KA", "CHA": "CA", "JHA": "CA", "TTHA": "TTA", "DDA": "TTA", "DDHA": "TTA", "THA": "TA", "DA": "TA", "DHA": "TA", "PHA": "PA", "BA": "PA", "BHA": "PA"},
    "BENGALI": {"VA": "BA"},
    "GURMUKHI": {"SSA": "SHA"},
}
#: Scripts in which a consonant at a word's end is read with "a" unless a virama stops it.
STOPPED = ("te", "ta", "kn", "ml")
#: The nukta goes, candra o becomes o (as a sign and as a letter).
PLAIN = {"़": "", "ॉ": "ो", "ऑ": "ओ"}


def script_table(script: str) -> dict[str, str]:
    """Devanagari letters, signs and digits and those at the same place of another script's block, or their stand-ins; code points without either are not in the table and stay."""
    table = {}
    for place in (*range(0x01, 0x4E), *range(0x66, 0x70)):
        source, there = chr(BLOCKS["DEVANAGARI"] + place), chr(BLOCKS[script] + place)
        stand_in = STAND_INS.get(script, {}).get(unicodedata.name(source, "").removeprefix("DEVANAGARI LETTER "))
        if unicodedata.name(there, ""):
            table[source] = there
        elif stand_in:
            table[source] = unicodedata.lookup(f"{script} LETTER {stand_in}")
    return table


def spoken(text: Column, lang: str) -> Column:
    """A Devanagari text in the script of a language: plain letters first, final consonants stopped where the script needs it, then letter by letter."""
    script = SCRIPTS[lang]
    if script == "DEVANAGARI":
        return text
    out = transliterate(text, PLAIN)
    if lang in STOPPED:
        out = F.regexp_replace(out, r"([\x{915}-\x{939}])(?=\p{IsWhite_Space}|\z)", "$1्")
    out = transliterate(out, script_table(script))
    return F.replace(out, F.lit("র"), F.lit("ৰ")) if lang == "as" else out


def plain_transliterate(text: str | None, table: dict[str, str]) -> str | None:
    """The same for one Python string, by a loop of another form: for tests and for texts on the driver."""
    if text is None or not table:
        return text
    longest, out, i = max(map(len, table)), [], 0
    while i < len(text):
        size = next((n for n in range(min(longest, len(text) - i), 0, -1) if text[i : i + n] in table), 0)
        out.append(table[text[i : i + size]] if size else text[i])
        i += size or 1
    return "".join(out)
