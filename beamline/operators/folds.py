"""Decisions that depend on those before them, folded over the ordered rows of small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cut_apart(spans: DataFrame, by: list[str], lo: str, hi: str, id_col: str) -> DataFrame:
    """Adds the island of each span (lo, hi included): nothing overlaps across islands, so a group can be folded in pieces."""
    w = W.partitionBy(*by).orderBy(lo, hi, id_col)
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("new", F.coalesce((F.col(lo) > reach).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))


def longest_matches(spans: DataFrame, by: list[str], lo: str, hi: str, id_col: str) -> DataFrame:
    """Of spans (lo, hi included) that overlap within a group the longest stay; the earlier one of equal length."""
    cut = cut_apart(spans, by, lo, hi, id_col)
    ranked = F.sort_array(F.collect_list(F.struct((F.col(lo) - F.col(hi)).alias("turn"), F.col(lo).alias("lo"), F.col(id_col).alias("id"), F.col(hi).alias("hi"))))

    def keep(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k["lo"] <= x["hi"]) & (x["lo"] <= k["hi"])), kept).otherwise(F.concat(kept, F.array(x)))

    folded = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", 1, 1), keep)
    grouped = cut.groupBy(*by, "island").agg(ranked.alias("all"))
    return grouped.select(*by, F.explode(folded).alias("k")).select(*by, F.col("k.id").alias(id_col), F.col("k.lo").alias(lo), F.col("k.hi").alias(hi))


def merge_ids(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """One row per id, the most confident one, then the first in order; merged counts the rows behind it. Rows without id stay as they are.

    A confidence that is null is least. Rows are merged as they are shuffled, so an id may have any number of them.
    """
    names = [c for c in rows.columns if c != id_col]
    row = F.struct((-F.coalesce("confidence", F.lit(float("-inf")))).alias("turn"), *[F.col(c).alias(f"at_{i}") for i, c in enumerate(order)], F.struct(*names).alias("row"))
    named = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(row).alias("best"), F.count(F.lit(1)).alias("merged"))
    kept = named.select(id_col, "best.row.*", "merged").select(*rows.columns, "merged")
    return kept.unionByName(rows.filter(F.col(id_col).isNull()).withColumn("merged", F.lit(1).cast("long")))


def merge_duplicates(boxes: DataFrame, by: list[str], order: list[str], percent: int = 60) -> DataFrame:
    """Rows of a group whose boxes overlap the current survivor's by percent of their union are merged, in order.

    A strictly higher confidence takes the survivor's place; merged counts the rows behind each survivor.
    Needs x0, y0, x1, y1, confidence and id; a column merged says how many rows each row stands for already. Boxes apart are folded apart.
    """
    before = F.col("merged") if "merged" in boxes.columns else F.lit(1).cast("long")
    row = F.struct(*order, "x0", "y0", "x1", "y1", "confidence", "id", before.alias("merged"))
    side = lambda a, b, k: F.greatest(F.lit(0).cast("long"), F.least(a[f"{k}1"], b[f"{k}1"]) - F.greatest(a[f"{k}0"], b[f"{k}0"]))
    area = lambda a: (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])

    def same(a: Column, b: Column) -> Column:
        common = side(a, b, "x") * side(a, b, "y")
        return (common > 0) & (100 * common >= percent * (area(a) + area(b) - common))

    def put(kept: Column, x: Column) -> Column:
        # The first survivor that x repeats takes it up.
        place = F.array_min(F.filter(F.transform(kept, lambda k, i: F.when(same(k, x), i)), lambda i: i.isNotNull()))
        one = lambda k: F.when(x["confidence"] > k["confidence"], x.withField("merged", k["merged"] + x["merged"])).otherwise(k.withField("merged", k["merged"] + x["merged"]))
        return F.when(place.isNull(), F.concat(kept, F.array(x))).otherwise(F.transform(kept, lambda k, i: F.when(i == place, one(k)).otherwise(k)))

    folded = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", 1, 1), put)
    return cut_apart(boxes, by, "x0", "x1", "id").groupBy(*by, "island").agg(F.sort_array(F.collect_list(row)).alias("all")).select(*by, F.explode(folded).alias("k")).select(*by, "k.id", "k.confidence", "k.merged")
