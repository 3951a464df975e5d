"""First-wins, best-wins and latest-wins selection, and decision tables over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; a rank filter lets Spark drop most rows before the shuffle."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def latest(rows: DataFrame, superseded: DataFrame, id_col: str, group: str, order: list[str]) -> DataFrame:
    """Of each group the greatest row by order, without superseded ids."""
    left = rows.join(superseded.distinct(), id_col, "left_anti")
    best = F.max_by(F.struct(*left.columns), F.struct(*order))
    return left.groupBy(group).agg(best.alias("best")).select("best.*")


#: From where a confidence is high, and from where it is medium.
HIGH, MEDIUM = 0.80, 0.55


def review_status() -> Column:
    """What becomes of a prediction; the first condition that holds decides.

    A row without a section abstains, unknown eligibility is a conflict, a schedule row is one that the
    catalog has not verified, and the pattern of all families but one matches.
    """
    conflict, matches = F.col("eligible").isNull(), F.col("family") != "HP"
    return (
        F.when(F.col("section").isNull(), "pending_review")
        .when((F.col("confidence") >= HIGH) & ~conflict & matches, "auto_accepted")
        .when((F.col("source") == "CORRECTION") | conflict | (F.col("confidence") < MEDIUM), "pending_review")
        .when(F.col("is_schedule"), F.when(matches, "accepted_unverified").otherwise("correction_suggested"))
        .otherwise("auto_accepted")
    )


def tags() -> Column:
    """All tags that a prediction carries."""
    return F.array_compact(
        F.array(
            F.when((F.col("source") == "GEOMETRY") & (F.col("confidence") < 0.8), F.lit("low_confidence")),
            F.when(F.col("section").isNull(), F.lit("no_section")),
            F.when(F.col("eligible").isNull(), F.lit("scope_unknown")),
            F.when(F.col("is_schedule"), F.lit("schedule")),
        )
    )
