"""Conservative counting of predicted members, and its evaluation against expected quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import numbered

#: Sources whose rows are labelled, and the multipliers that a note may give.
LABELED_SOURCES = ("FUSION", "CORRECTION", "ANNOTATION", "SCHEDULE MARK MAP")
LEAST_TYPICAL, MOST_TYPICAL = 2, 20


def with_buckets(predictions: DataFrame) -> DataFrame:
    """Adds bucket and counted: the first rule that fits decides what a row is worth.

    Eligibility that is exactly false removes a row; unknown eligibility leaves it, unlabelled.
    """
    rows = predictions.filter(~F.coalesce(F.col("eligible") == F.lit(False), F.lit(False)))
    inferred = F.col("source") == "GEOMETRY"
    labeled = F.coalesce(F.col("eligible"), F.lit(False)) & F.col("source").isin(*LABELED_SOURCES) & ~inferred & F.col("section").isNotNull()
    rows = rows.withColumn("labeled", labeled).withColumn("inferred", inferred)
    # Sums per key are made before they meet the rows, so that a frequent section is one row of the smaller side.
    keys = rows.filter("labeled").select(F.col("page").alias("k_page"), F.col("section").alias("k_section")).distinct().withColumn("labeled_here", F.lit(True))
    called = rows.filter("labeled and not is_schedule").select(F.col("section").alias("c_section")).distinct().withColumn("called_out", F.lit(True))
    rows = rows.join(keys, (F.col("page") == F.col("k_page")) & (F.col("section") == F.col("k_section")), "left").join(called, F.col("section") == F.col("c_section"), "left")
    bucket = (
        F.when(F.col("section").isNull(), "invalid_or_missing_section")
        .when(F.col("inferred") & F.col("labeled_here").isNotNull(), "excluded_geometry_duplicates")
        .when(F.col("inferred"), "geometry_inference")
        .when(~F.col("labeled"), "unlabeled_source")
        .when(F.col("is_schedule") & F.col("called_out").isNotNull(), "excluded_schedule_duplicates")
        .when(F.col("is_schedule"), "excluded_schedule_only")
        .otherwise("counted")
    )
    typical = F.when(F.col("typ_count").between(LEAST_TYPICAL, MOST_TYPICAL), F.col("typ_count")).otherwise(F.lit(1).cast("long"))
    rows = rows.withColumn("bucket", bucket)
    return rows.withColumn("counted", F.when(F.col("bucket") == "counted", typical).otherwise(F.lit(0).cast("long"))).drop("k_page", "k_section", "c_section", "labeled_here", "called_out")


def quantities(predictions: DataFrame) -> DataFrame:
    """One row a section: quantity, mean confidence of its counted rows, method, excluded rows; blank for invalid rows."""
    hit = F.col("bucket") == "counted"
    out = with_buckets(predictions).groupBy(F.coalesce("section", F.lit("")).alias("section")).agg(
        F.sum("counted").alias("quantity"),
        F.sum(F.when(hit, F.round(F.col("confidence") * 100).cast("long")).otherwise(0)).alias("hundredths"),
        F.count(F.when(hit, 1)).alias("rows_counted"),
        F.count(F.when(~hit, 1)).alias("rows_excluded"),
    )
    # The mean to four places, halves up, in whole numbers: no binary fraction decides a tie.
    mean = F.expr("(200 * hundredths + greatest(rows_counted, 1)) div (2 * greatest(rows_counted, 1))") / F.lit(10000.0)
    out = out.select("section", "quantity", mean.alias("confidence"), "rows_counted", "rows_excluded")
    return out.withColumn("method", F.when(F.col("rows_counted") > 0, "labeled_callout").otherwise("insufficient"))


def compare(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Full outer comparison by section of (section, predicted) with (section, expected)."""
    p, g = F.coalesce("predicted", F.lit(0)).cast("long"), F.coalesce("expected", F.lit(0)).cast("long")
    both = found.join(expected, "section", "full").select("section", p.alias("predicted"), g.alias("expected"))
    p, g = F.col("predicted"), F.col("expected")
    status = F.when((p == 0) & (g > 0), "missing").when((g == 0) & (p > 0), "extra").when(p > g, "over").when(p < g, "under").otherwise("match")
    return both.select("section", "predicted", "expected", F.least(p, g).alias("caught"), (p - g).alias("delta"), F.greatest(p - g, F.lit(0).cast("long")).alias("excess"), F.when(g > 0, F.round(100.0 * F.least(p, g) / g, 1)).alias("success_pct"), status.alias("status"))


def totals(compared: DataFrame) -> DataFrame:
    """Precision, recall and F1 in percent, mean errors and counts of statuses."""
    sums = compared.agg(F.sum("caught").alias("c"), F.sum("expected").alias("g"), F.sum("predicted").alias("p"), F.sum(F.abs("delta")).alias("e"), F.sum("delta").alias("d"), F.count(F.lit(1)).alias("sections"), F.count(F.when(F.col("delta") == 0, 1)).alias("exact"))
    recall = F.when(F.col("g") > 0, F.round(100.0 * F.col("c") / F.col("g"), 2)).otherwise(0.0)
    precision = F.when(F.col("p") > 0, F.round(100.0 * F.col("c") / F.col("p"), 2)).otherwise(0.0)
    f1 = F.when(F.col("g") + F.col("p") > 0, F.round(200.0 * F.col("c") / (F.col("g") + F.col("p")), 2)).otherwise(0.0)
    least = F.greatest("sections", F.lit(1))
    return sums.select(recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), F.round(F.col("e") / least, 4).alias("mae"), F.round(F.col("d") / least, 4).alias("bias"), "sections", "exact")


def issues(compared: DataFrame) -> DataFrame:
    """One validation issue a section, two where something expected was not found at all."""
    p, g = F.col("predicted"), F.col("expected")
    raised = (
        F.when((g > 0) & (p == 0), F.array(F.lit("FAIL:not_found"), F.lit("FAIL:quantity")))
        .when((g == 0) & (p > 0), F.array(F.lit("WARNING:unexpected")))
        .when(F.col("delta") == 0, F.array(F.lit("PASS:quantity")))
        .when(F.abs("delta") == 1, F.array(F.lit("WARNING:quantity")))
        .otherwise(F.array(F.lit("FAIL:quantity")))
    )
    issue = F.split("issue", ":")
    return compared.withColumn("issue", F.explode(raised)).select("section", "predicted", "expected", issue[0].alias("level"), issue[1].alias("code"))


def export_rows(counted: DataFrame) -> DataFrame:
    """Sections with a quantity, numbered by falling quantity, then by name."""
    return numbered(counted.filter("quantity > 0").select("section", "quantity", "confidence"), [F.desc("quantity"), F.col("section")], "line")
