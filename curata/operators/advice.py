"""Advice on results: groups of terms, steps, phrases, candidates, result kinds, weather rules and scores. The rule tables are dimensions: small and fixed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import text as tx

#: A small set of step templates by group: (group, [(step, template)]).
STEPS = [
    (0, [("safety", "wear gloves"), ("prune", "prune in {days} days"), ("spray", "spray {chem}"), ("expert", "ask")]),
    (1, [("water", "water less"), ("safety", "wash"), ("wait", "wait {days} days")]),
]
#: Steps that a voice leaves out when it speaks without being asked, and how many it then says.
UNSPOKEN, SPOKEN_STEPS = ("safety", "expert"), 2


def result_kind(dark: Column, ambiguous: Column, mismatch: Column, best: Column, unsure: float) -> Column:
    return F.when(dark, "dark").when(ambiguous, "ask").when(mismatch, "mismatch").when(best < unsure, "unsure").otherwise("sure")


def groups(terms: DataFrame, own: DataFrame, explicit: DataFrame, healthy: str, rules: list) -> DataFrame:
    """terms (crop, term). Per term its group and the reason for it: the healthy term, one of the crop's own (crop, term, own), an explicit one
    (term, explicit), the first rule with a word in it, else the default."""
    found = terms.join(own, ["crop", "term"], "left").join(explicit, "term", "left")
    rule = tx.first_rule(F.col("term"), rules, "fungal_spot")
    is_healthy = F.col("term") == healthy
    named = F.when(is_healthy, "healthy").otherwise(F.coalesce("own", "explicit", rule))
    by_rule = F.when(rule != "fungal_spot", "rule").otherwise("default")
    reason = F.when(is_healthy, "explicit").when(F.col("own").isNotNull(), "crop-specific").when(F.col("explicit").isNotNull(), "explicit").otherwise(by_rule)
    return found.select("crop", "term", named.alias("grp"), reason.alias("reason"))


def term_maps(grouped: DataFrame) -> DataFrame:
    """k, grp: "crop::term" for the crops' own terms, and each other term, where the last crop's group stands."""
    own = grouped.where("reason = 'crop-specific'").select(F.concat_ws("::", "crop", "term").alias("k"), "grp")
    last = grouped.where("reason <> 'crop-specific'").groupBy("term").agg(F.max(F.struct("crop", "grp")).alias("x"))
    return own.unionByName(last.select(F.col("term").alias("k"), F.col("x.grp").alias("grp")))


def steps(results: DataFrame, plans: DataFrame, group: str, spoken: str, params: dict) -> DataFrame:
    """results with one row for each step of their group, filled from params: place from 0, step, text."""
    chosen = F.when(F.col(spoken), F.slice(F.filter("steps", lambda s: ~s["step"].isin(*UNSPOKEN)), 1, SPOKEN_STEPS)).otherwise(F.col("steps"))
    filled = F.create_map(*[F.lit(x) for pair in params.items() for x in pair])
    rows = results.join(plans, group).withColumn("chosen", chosen)
    rows = rows.select(*results.columns, F.posexplode("chosen").alias("place", "_step"))
    return rows.select(*results.columns, "place", F.col("_step.step").alias("step"), tx.fill(F.col("_step.template"), filled).alias("text"))


def candidates(searches: DataFrame, items: DataFrame, sick: str, most: int) -> DataFrame:
    """searches (subject, turn, word), items (at, title): of each subject's searches the first that finds anything; equal titles count once, at their first
    place. subject, title, place. The searches are a small list; each item is matched against it where it stands."""
    hits = items.where(~F.rlike("title", F.lit(sick))).join(searches, F.contains(F.lower("title"), F.col("word")))
    hits = hits.groupBy("subject", "turn", "title").agg(F.min("at").alias("at"))
    first = hits.groupBy("subject").agg(F.min("turn").alias("turn"))
    w = Window.partitionBy("subject").orderBy("at")
    return hits.join(first, ["subject", "turn"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("subject", "title", "place")


def problems(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """problem, n: how many rows each check found."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n") for name, rows in found])


def inventory(kinds: dict[str, DataFrame], languages: list[str]) -> DataFrame:
    """kinds: rows of id and one column per language. lang, k ("kind:id"), text, in English where the language has none."""
    said = [rows.select(F.lit(lang).alias("lang"), F.concat(F.lit(f"{kind}:"), "id").alias("k"), F.coalesce(lang, "en").alias("text")) for kind, rows in kinds.items() for lang in languages]
    return reduce(DataFrame.unionByName, said)


def weather(rain: Column, heat: Column, wind: Column, fungal: Column) -> Column:
    """Advice by rain probability, temperature and wind, and an alert where a fungal disease was found."""
    wet = rain >= 60
    said = (F.when(wet, "delay irrigation"), F.when((heat >= 35) & ~wet, "heat stress"), F.when(wind >= 20, "avoid spraying"), F.when(fungal & wet, "raise the alert"))
    return F.concat_ws("; ", *said)


def score(need: Column, applied: Column, inputs: Column, health: Column) -> Column:
    """0.4 of water efficiency, 0.3 of input use, 0.3 of crop health, each from 0 to 100."""
    return 0.4 * (100 * F.least(F.lit(1.0), need / applied)) + 0.3 * inputs + 0.3 * health


def band(value: Column) -> Column:
    return F.when(value >= 80, "good").when(value >= 60, "fair").otherwise("needs action")
