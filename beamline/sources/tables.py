"""The tables of a data folder, and the columns that stand in for drawings.

A part's designation is a section label; line items are predictions of sections on pages; the sections of
finished orders are the ground truth; boxes are made of line item measures. Each mapping exists twice, as
columns and as SQL for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILY_OF_TYPE = {"ECONOMY": "W", "STANDARD": "WT", "MEDIUM": "M", "LARGE": "HP", "PROMO": "C", "SMALL": "MC"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def family_column() -> Column:
    return F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in FAMILY_OF_TYPE.items()])


def labelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, family, depth, weight, label, printed: the label as a damaged print shows it."""
    base = table(spark, sf_dir, "part").select("p_partkey", "p_brand", family_column().alias("family"), F.col("p_size").cast("long").alias("depth"), (F.col("p_partkey") % 100).alias("weight"))
    named = base.withColumn("label", F.concat("family", F.col("depth").cast("string"), F.lit("X"), F.col("weight").cast("string")))
    kind, label = F.col("p_partkey") % 7, F.col("label")
    n = F.length(label)
    printed = (
        F.when(kind == 0, F.substring(label, F.lit(1), n - 1))
        .when(kind == 1, F.translate(label, "0", "O"))
        .when(kind == 2, F.concat(F.substring(label, F.lit(1), n - 1), F.lit("*")))
        .when(kind == 3, F.lower(label))
        .when(kind == 4, F.concat(F.substring(label, 1, 1), F.lit(" "), F.substring(label, F.lit(2), n - 1)))
        .when(kind == 5, F.concat(F.lit("Q"), label))
        .otherwise(label)
    )
    return named.withColumn("printed", printed)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct labels: label, family, depth, weight, with the least part key."""
    return labelled_parts(spark, sf_dir).groupBy("label", "family", "depth", "weight").agg(F.min("p_partkey").alias("part"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions."""
    items = table(spark, sf_dir, "lineitem")
    parts = labelled_parts(spark, sf_dir).select("p_partkey", "label", "family")
    source = F.when(F.col("l_returnflag") == "A", "FUSION").when(F.col("l_returnflag") == "R", "CORRECTION").otherwise("GEOMETRY")
    eligible = F.when(F.col("l_linenumber") == 7, F.lit(False)).when((F.col("l_linenumber") == 6) & (F.col("l_linestatus") == "F"), F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "family",
        F.when((F.col("l_partkey") % 50) != 0, F.col("label")).alias("section"),
        F.col("l_suppkey").cast("long").alias("page"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        source.alias("source"),
        eligible.alias("eligible"),
        ((F.col("l_quantity") % 11) == 0).alias("is_schedule"),
        F.when(F.col("l_linenumber") == 3, F.col("l_quantity").cast("long")).alias("typ_count"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected quantity of each section: one for each line item of a finished order."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    parts = labelled_parts(spark, sf_dir).select("p_partkey", "label")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).join(parts, items["l_partkey"] == parts["p_partkey"]).groupBy(F.col("label").alias("section")).agg(F.count(F.lit(1)).alias("expected"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on pages: id columns, page, x0, y0, x1, y1, cx, cy."""
    x0, y0 = F.pmod(F.floor("l_extendedprice"), F.lit(1000)).cast("long"), (F.col("l_quantity") * 20).cast("long")
    w, h = (F.round(F.col("l_discount") * 100) + 5).cast("long"), (F.round(F.col("l_tax") * 100) + 5).cast("long")
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_suppkey") * 7 + F.col("l_linenumber")).cast("long").alias("page"), x0.alias("x0"), y0.alias("y0"), w.alias("w"), h.alias("h"))
    return base.select("l_orderkey", "l_partkey", "page", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


FAMILY_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY_OF_TYPE.items()) + " END"

PARTS_SQL = f"""parts AS (SELECT p_partkey, p_brand, {FAMILY_SQL} AS family, CAST(p_size AS BIGINT) AS depth, p_partkey % 100 AS weight,
  {FAMILY_SQL} || p_size || 'X' || (p_partkey % 100) AS label FROM part),
printed AS (SELECT *, CASE p_partkey % 7 WHEN 0 THEN substr(label, 1, length(label) - 1) WHEN 1 THEN replace(label, '0', 'O')
  WHEN 2 THEN substr(label, 1, length(label) - 1) || '*' WHEN 3 THEN lower(label) WHEN 4 THEN substr(label, 1, 1) || ' ' || substr(label, 2)
  WHEN 5 THEN 'Q' || label ELSE label END AS printed FROM parts),
catalog AS (SELECT label, family, depth, weight, min(p_partkey) AS part FROM parts GROUP BY ALL)"""

PREDICTIONS_SQL = f"""{PARTS_SQL},
predictions AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, family, CASE WHEN l_partkey % 50 <> 0 THEN label END AS section,
  CAST(l_suppkey AS BIGINT) AS page, round(l_discount * 10, 2) AS confidence,
  CASE l_returnflag WHEN 'A' THEN 'FUSION' WHEN 'R' THEN 'CORRECTION' ELSE 'GEOMETRY' END AS source,
  CASE WHEN l_linenumber = 7 THEN FALSE WHEN l_linenumber = 6 AND l_linestatus = 'F' THEN NULL ELSE TRUE END AS eligible,
  l_quantity % 11 = 0 AS is_schedule, CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS BIGINT) END AS typ_count, CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem JOIN parts ON l_partkey = p_partkey)"""

TRUTH_SQL = """truth AS (SELECT label AS section, count(*) AS expected FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey
  WHERE o_orderstatus = 'F' GROUP BY label)"""

BOXES_SQL = """boxes AS (SELECT l_orderkey, l_partkey, CAST(l_suppkey * 7 + l_linenumber AS BIGINT) AS page, CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS x0, CAST(l_quantity * 20 AS BIGINT) AS y0,
  CAST(floor(l_extendedprice) AS BIGINT) % 1000 + CAST(round(l_discount * 100) AS BIGINT) + 5 AS x1, CAST(l_quantity * 20 AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT) + 5 AS y1 FROM lineitem)"""
