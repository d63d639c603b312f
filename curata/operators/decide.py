"""Decisions on class probabilities in long form (photo, crop, label, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SURE_CROP, SURE_LEAD, MISMATCH, UNSURE = 0.50, 0.35, 0.15, 0.28


def crop_shares(probs: DataFrame) -> DataFrame:
    """photo, crop, share, place (by share, then name)."""
    sums = probs.groupBy("photo", "crop").agg(F.sum("p").alias("share"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("photo").orderBy(F.desc("share"), "crop")))


def decide(probs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (photo, crop or null, unknown crops count as null). Per photo: detected, lead, ambiguous, mismatch, label, p, kind. The classes are narrowed to the
    chosen crop, else to the detected one unless ambiguous, and renormalised; the first class wins ties."""
    shares = crop_shares(probs)
    top = shares.groupBy("photo").agg(F.max(F.when(F.col("place") == 1, F.col("crop"))).alias("detected"), F.max(F.when(F.col("place") == 1, F.col("share"))).alias("top"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("share"))), F.lit(0.0)).alias("second"), F.count(F.lit(1)).alias("crops"))
    known = chosen.join(shares.select("photo", "crop", "share"), ["photo", "crop"], "left_semi").select("photo", F.col("crop").alias("chosen"))
    facts = top.join(known, "photo", "left")
    share = shares.select("photo", F.col("crop").alias("chosen"), F.col("share").alias("chosen_share"))
    facts = facts.join(share, ["photo", "chosen"], "left")
    ambiguous = F.col("chosen").isNull() & (F.col("crops") > 1) & ((F.col("top") < SURE_CROP) | (F.col("top") - F.col("second") < SURE_LEAD))
    mismatch = F.col("chosen").isNotNull() & (F.col("chosen") != F.col("detected")) & (F.col("chosen_share") < MISMATCH)
    facts = facts.withColumn("ambiguous", ambiguous).withColumn("mismatch", F.coalesce(mismatch, F.lit(False)))
    within = F.coalesce("chosen", F.when(~F.col("ambiguous"), F.col("detected")))
    rows = probs.join(facts.withColumn("within", within), "photo").where("within is null or crop = within")
    mass = Window.partitionBy("photo")
    rows = rows.withColumn("q", F.when(F.sum("p").over(mass) > 0, F.col("p") / F.sum("p").over(mass)).otherwise(F.col("p")))
    best = rows.withColumn("place", F.row_number().over(mass.orderBy(F.desc("q"), "label"))).where("place = 1")
    kind = F.when(F.col("ambiguous"), "ask").when(F.col("mismatch"), "mismatch").when(F.col("q") < UNSURE, "unsure").otherwise("sure")
    return best.select("photo", "detected", (F.col("top") - F.col("second")).alias("lead"), "ambiguous", "mismatch", "label", F.col("q").alias("p"), kind.alias("kind"))
