"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(x: Column) -> Column:
    """Lower case, other runs than letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def norm_tight(x: Column) -> Column:
    """Lower case, nothing but letters and digits."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def slug(x: Column, lower: bool = True) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x) if lower else x, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def split_label(x: Column) -> tuple[Column, Column]:
    """Group and label of "group::label", cut at the first "::"."""
    parts = F.split(x, "::", 2)
    return F.get(parts, 0), F.get(parts, 1)


def display(x: Column) -> Column:
    """Without parentheses; underscores to spaces; first letter upper."""
    clean = F.trim(F.translate(F.regexp_replace(x, r"\s*\(.*?\)", ""), "_", " "))
    return F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 10000))


def stable_bucket(x: Column, n: int) -> Column:
    """The 128-bit md5 as a number, modulo n: its four 32-bit words weighted by powers of 2 ** 32 modulo n."""
    digest = F.md5(x)
    total = F.lit(0).cast("long")
    for k in range(4):
        word = F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
        total = total + (word % n) * pow(2, 32 * (3 - k), n)
    return (total % n).cast("int")


def path_name(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def path_parent(x: Column) -> Column:
    return F.try_element_at(F.split(x, "/"), F.lit(-2))


def stem(x: Column) -> Column:
    return F.regexp_replace(path_name(x), r"\.[^.]*$", "")


def fill(template: Column, params: Column) -> Column:
    """{name} replaced from the map params; unknown names stay."""
    return F.aggregate(F.map_entries(params), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def first_rule(x: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """Name of the first rule one of whose words x contains, in lower case."""
    out, low = F.lit(None).cast("string"), F.lower(x)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def keywords(title: Column, stop: tuple[str, ...]) -> Column:
    words = F.split(F.lower(title), "[^a-z]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop)))


def leaf_key(file: Column) -> Column:
    """A photo's leaf: its name without masks, what follows the last "___", cut at "copy", without a photo ending, in lower case."""
    bare = F.element_at(F.split(F.replace(file, F.lit("_final_masked"), F.lit("")), "___"), -1)
    return F.lower(F.trim(F.regexp_replace(F.get(F.split(bare, "copy"), 0), r"(?i)\.(jpe?g|png)$", "")))


def leaf_choice(label: Column, key: Column, options: Column) -> Column:
    """Of a key's options the only one, or the first that holds the label; without one the label's own "solo" leaf."""
    fits = F.when(F.size(options) == 1, options).otherwise(F.filter(options, lambda o: F.contains(o, label)))
    return F.coalesce(F.get(fits, 0), F.concat(label, F.lit(":::solo_"), key))
