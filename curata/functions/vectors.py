"""Vector functions over array columns, and the formulas of scores and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a) -> Column:
    """L2-normalised, as doubles; a zero vector gives nulls."""
    size = F.sqrt(dot(a, a))
    # bound once a row: inside the lambda over components it would be computed for each of them
    return F.get(F.transform(F.array(size), lambda s: F.transform(a, lambda x: x.cast("double") / F.nullif(s, F.lit(0.0)))), F.lit(0))


def sign_bits(a, n: int = 64) -> Column:
    """The signs of the first n components as a long."""
    return F.aggregate(F.slice(a, 1, n), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def hamming(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def softmax(logits) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v)
    return F.transform(shifted, lambda x: x / total)


def mean_views(a, b) -> Column:
    """The mean of two views' probabilities."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def confidence(p: Column) -> Column:
    return F.when(p >= 0.80, "high").when(p >= 0.55, "medium").otherwise("low")


def cosine_schedule(step: Column, total: int, warmup: int) -> Column:
    """Share of the learning rate: linear warm-up, then half a cosine."""
    progress = (step - warmup) / F.lit(float(max(total - warmup, 1)))
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), progress))))


def luma_stats(grey, width: int) -> dict[str, Column]:
    """Mean, spread and Laplacian variance of a grey image held row by row."""
    n = F.size(grey)
    mean = F.aggregate(grey, F.lit(0.0), lambda s, v: s + v) / n
    spread = F.sqrt(F.aggregate(grey, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    inner = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i % width > 0) & (i % width < width - 1) & (i >= width) & (i < n - width))
    at = lambda i: F.get(grey, i)
    lap = F.transform(inner, lambda i: 4 * at(i) - at(i - 1) - at(i + 1) - at(i - width) - at(i + width))
    m = F.aggregate(lap, F.lit(0.0), lambda s, v: s + v) / F.size(lap)
    return {"mean": mean, "spread": spread, "sharpness": F.aggregate(lap, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(lap)}


def fit_within(width: Column, height: Column, side: int) -> tuple[Column, Column]:
    """Size scaled down so that the longer side is at most `side`, aspect kept."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    at_least_one = lambda x: F.greatest(F.lit(1), F.round(x * scale).cast("int"))
    return at_least_one(width), at_least_one(height)


def centre_crop(width: Column, height: Column, side: int) -> dict[str, Column]:
    """The size whose shorter side is floor(side / 0.9), aspect kept, and the corner of the centred square of `side`."""
    short = math.floor(side / 0.9)
    grown = lambda x: F.greatest(F.lit(short), F.floor(x * short / F.least(width, height)).cast("int"))
    w, h = grown(width), grown(height)
    return {"rw": w, "rh": h, "x": F.floor((w - side) / 2).cast("int"), "y": F.floor((h - side) / 2).cast("int")}


def mock_weights(digest: Column, classes: int) -> Column:
    """Weights from 1 to 97 for each class from four hex digits of a digest."""
    return F.array(*[1 + F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("long") % 97 for i in range(classes)])
