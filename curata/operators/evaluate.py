"""Confusion matrices and scores of (truth, predicted) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, predicted: str, domain: DataFrame) -> DataFrame:
    """Long form over a full label domain (label), zero-filled: truth, predicted, n, share of the truth's row (0 for an empty one)."""
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    # the domain is the label list, not data: every cell of the matrix is a row of the result
    grid = domain.select(F.col("label").alias("truth")).join(domain.select(F.col("label").alias("predicted")), how="cross")
    full = grid.join(counts, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("truth")), F.lit(1)))


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support of every label that occurs on either side; a division by zero is 0. One pass over the rows."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    scored = sums.withColumn("precision", zero(F.try_divide("hit", "predicted"))).withColumn("recall", zero(F.try_divide("hit", "support")))
    return scored.withColumn("f1", zero(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("predicted")))).select("label", "precision", "recall", "f1", "support")


def summary(rows: DataFrame, truth: str, predicted: str, slices: list[str]) -> DataFrame:
    """Per slice: n, accuracy and macro-F1 over the labels present in truth. slices: boolean columns; each row counts in every slice it is in."""
    named = F.filter(F.array(*[F.when(F.col(s), F.lit(s)) for s in slices]), lambda s: s.isNotNull())
    spread = rows.withColumn("slice", F.explode(named))
    keyed = spread.select("slice", F.col(truth).alias("t"), F.col(predicted).alias("p"))
    sides = keyed.select("slice", F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("s"), (F.col("t") == F.col("p")).cast("int").alias("hit"), F.lit(0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0).alias("s"), F.lit(0).alias("hit"), F.lit(1).alias("q")))).alias("x")).select("slice", "x.*")
    each = sides.groupBy("slice", "label").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("hit").alias("hit"))
    f1 = F.when(F.col("s") > 0, 2 * F.col("hit") / (F.col("s") + F.col("q")))
    return each.groupBy("slice").agg(F.sum("s").alias("n"), (F.sum("hit") / F.sum("s")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def full_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """`class_report` with rows for the macro and weighted averages and the accuracy (which stands in all three score columns)."""
    each = class_report(rows, truth, predicted).select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    scores = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    macro = each.agg(*(F.avg(c).alias(c) for c in scores), total).select(F.lit("macro avg").alias("label"), *scores, "support")
    weighted = each.agg(*((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores), total).select(F.lit("weighted avg").alias("label"), *scores, "support")
    right = rows.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("a"), F.count(F.lit(1)).alias("support"))
    accuracy = right.select(F.lit("accuracy").alias("label"), *(F.col("a").alias(c) for c in scores), "support")
    return each.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def first_by(rows: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that leaves no ties."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def free_and_given(probs: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """probs (key, label, crop, p), truth (key, truth, crop). Per key: truth, free (the best label) and given (the best of the truth's crop)."""
    best = [F.desc("p"), "label"]
    free = first_by(probs, [key], best).select(key, F.col("label").alias("free"))
    given = first_by(probs.join(truth.select(key, "crop"), [key, "crop"]), [key], best).select(key, F.col("label").alias("given"))
    return truth.select(key, "truth").join(free, key).join(given, key)


def domain_scores(rows: DataFrame, crop: str, truth: str, predicted: str, domain: list) -> DataFrame:
    """Per crop: accuracy, and macro-F1 over the whole class domain, absent classes counting 0. One pass over the rows."""
    d = F.array(*map(F.lit, domain))
    sums = [x for c in domain for x in (F.count_if(F.col(truth) == c).alias(f"s{c}"), F.count_if(F.col(predicted) == c).alias(f"q{c}"), F.count_if((F.col(truth) == c) & (F.col(predicted) == c)).alias(f"h{c}"))]
    f1 = F.array(*[F.when(F.col(f"s{c}") + F.col(f"q{c}") > 0, 2 * F.col(f"h{c}") / (F.col(f"s{c}") + F.col(f"q{c}"))).otherwise(F.lit(0.0)) for c in domain])
    found = rows.groupBy(crop).agg(*sums, F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    return found.select(crop, "accuracy", (F.aggregate(f1, F.lit(0.0), lambda s, x: s + x) / F.size(d)).alias("macro_f1"))


def mixups(rows: DataFrame, truth: str, predicted: str, crop, most: int) -> DataFrame:
    """The most frequent wrong predictions: truth, predicted, n, share of the truth's rows, whether both are of one crop."""
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("truth"))
    shares = counts.withColumn("share", F.round(F.col("n") / total, 3)).where("truth <> predicted")
    return shares.withColumn("same_crop", crop(F.col("truth")) == crop(F.col("predicted"))).orderBy(F.desc("n"), "truth", "predicted").limit(most)


def split_checks(rows: DataFrame, group: str, label: str, split: str, protected) -> DataFrame:
    """Counts that must be 0: groups in several splits, protected rows in train, labels that test lacks."""
    shared = rows.groupBy(group).agg(F.countDistinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_groups"))
    leaked = rows.agg(F.count_if(protected & (F.col(split) == "train")).alias("protected_in_train"))
    missing = rows.groupBy(label).agg(F.max(F.col(split) == "test").alias("has")).agg(F.count_if(~F.col("has")).alias("missing_classes"))
    return shared.join(leaked, how="cross").join(missing, how="cross")  # one row each
