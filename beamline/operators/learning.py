"""Rates, intervals, splits, fused scores and pattern statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prior weights of the modalities, and how strongly a confidence moves them.
PRIORS = {"text": 0.32, "geometry": 0.30, "graph": 0.17}
SHARPNESS = 0.75
Z = 1.96


def wilson(hits: Column, n: Column, sign: int) -> Column:
    """A bound of the Wilson interval, within [0, 1]; null without rows."""
    p = hits / n
    centre, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (centre + sign * half) / (1 + Z * Z / n))), 4))


def split_of(key: Column) -> Column:
    """train, validation or test by the first 32 bits of the key's SHA-256."""
    u = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)
    return F.when(u < 0.8, "train").when(u < 0.8 + 0.1, "validation").otherwise("test")


def attention(confidence: dict[str, Column]) -> dict[str, Column]:
    """The weight of each modality: softmax of log prior plus a share of the log confidence, over those at hand."""
    raw = {m: F.when(c.isNotNull(), PRIORS[m] * F.pow(F.least(F.greatest(c, F.lit(0.05)), F.lit(1.0)), F.lit(SHARPNESS))).otherwise(F.lit(0.0)) for m, c in confidence.items()}
    total = sum(raw.values(), F.lit(0.0))
    return {m: F.when(total > 0, x / total).otherwise(F.lit(1.0 if m == "text" else 0.0)) for m, x in raw.items()}


def signature(token: Column) -> Column:
    """Runs of letters as A, of digits as 9; other characters as they are."""
    return F.regexp_replace(F.regexp_replace(token, "[A-Za-z]+", "A"), "[0-9]+", "9")


#: Weights of frequency, support and readability, the greatest confidence, the length that reads easily, and the support that is enough.
FREQUENCY, SUPPORT, READABLE, MOST, EASY_LENGTH, ENOUGH = 0.45, 0.35, 0.20, 0.97, 24, 5.0


def pattern_confidence(support: Column, share: Column, length: Column) -> Column:
    """How far a pattern is to be trusted: by frequency, support and readability; 0.97 at most."""
    readable = F.greatest(F.lit(0.05), 1 - F.greatest(F.lit(0.0), F.least(F.lit(0.55), (length - EASY_LENGTH) / 100.0)))
    return F.round(F.least(F.lit(MOST), FREQUENCY * share + SUPPORT * F.least(F.lit(1.0), support / ENOUGH) + READABLE * readable), 4)


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, pos, c): the mean vector of each label."""
    return vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("c"))


def nearest_centroid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, nearest, score): the label of the greatest inner product with its mean vector.

    All means are one array of the row at hand, one entry a label, so that vectors are neither taken apart nor shuffled.
    """
    means = centroids(vectors).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("mean"))
    table = means.agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("nearest"), "mean"))).alias("means"))
    inner = lambda mean: F.aggregate(F.zip_with("embedding", mean, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    scored = vectors.join(F.broadcast(table)).withColumn("best", F.array_max(F.transform("means", lambda m: F.struct(inner(m["mean"]).alias("score"), m["nearest"].alias("nearest")))))
    return scored.select("vec_id", "label", "best.nearest", F.round("best.score", 5).alias("score"))
