"""Ordered decision tables, counters, and collapses of repeated rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import records as r
from ..registry import query
from ..sources.tables import PARTS_SQL, PREDICTIONS_SQL, labelled_parts, predictions, table
from .layout import _BOXES, _boxes
from .takeoff import _COMPARED_SQL, _compared


def _n():
    return F.count(F.lit(1)).alias("n")


@query(
    "run_signature",
    f"WITH {PARTS_SQL} SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(printed, '[A-Za-z]+', '<A>', 'g'), '[0-9]+', '<N>', 'g'), '[*]', '<S>', 'g') AS signature, length(regexp_replace(printed, '[A-Za-z0-9 ]', '', 'g')) AS others FROM printed",
)
def run_signature(spark, sf_dir):
    """Runs of letters, of digits, and wildcards as signs."""
    p = F.col("printed")
    signs = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[A-Za-z]+", "<A>"), "[0-9]+", "<N>"), "[*]", "<S>")
    return labelled_parts(spark, sf_dir).select("p_partkey", signs.alias("signature"), F.length(F.regexp_replace(p, "[A-Za-z0-9 ]", "")).cast("long").alias("others"))


_REASON = "CASE WHEN section IS NULL THEN 'no_section' WHEN eligible IS NULL THEN 'scope_unknown' WHEN NOT eligible THEN 'out_of_scope' WHEN source = 'GEOMETRY' AND confidence < 0.2 THEN 'weak_geometry' WHEN confidence = 0 THEN 'no_confidence' END"


def _reason():
    return (
        F.when(F.col("section").isNull(), "no_section")
        .when(F.col("eligible").isNull(), "scope_unknown")
        .when(~F.col("eligible"), "out_of_scope")
        .when((F.col("source") == "GEOMETRY") & (F.col("confidence") < 0.2), "weak_geometry")
        .when(F.col("confidence") == 0, "no_confidence")
    )


@query("discard_counters", f"WITH {PREDICTIONS_SQL} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM predictions GROUP BY 1")
def discard_counters(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy(F.coalesce(_reason(), F.lit("kept")).alias("reason")).agg(_n())


@query("abstention_codes", f"WITH {PREDICTIONS_SQL} SELECT page, {_REASON} AS code, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM predictions WHERE {_REASON} IS NOT NULL GROUP BY 1, 2")
def abstention_codes(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("code", _reason()).filter("code is not null")
    return rows.groupBy("page", "code").agg(_n(), F.sum("quantity").alias("quantity"))


@query(
    "ambiguity_buckets",
    f"""WITH {PREDICTIONS_SQL}, k AS (SELECT page, family, count(DISTINCT section) AS options FROM predictions GROUP BY page, family), b AS (SELECT CASE WHEN options = 0 THEN '0' WHEN options = 1 THEN '1' WHEN options <= 5 THEN '2-5' ELSE '>5' END AS bucket FROM k)
SELECT bucket, count(*) AS n FROM b GROUP BY bucket""",
)
def ambiguity_buckets(spark, sf_dir):
    options = predictions(spark, sf_dir).groupBy("page", "family").agg(F.countDistinct("section").alias("options"))
    bucket = F.when(F.col("options") == 0, "0").when(F.col("options") == 1, "1").when(F.col("options") <= 5, "2-5").otherwise(">5")
    return options.groupBy(bucket.alias("bucket")).agg(_n())


@query("confidence_bands", f"WITH {PREDICTIONS_SQL} SELECT source, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'none' END AS band, count(*) AS n FROM predictions GROUP BY 1, 2")
def confidence_bands(spark, sf_dir):
    c = F.col("confidence")
    band = F.when(c >= 0.8, "high").when(c >= 0.55, "medium").when(c > 0, "low").otherwise("none")
    return predictions(spark, sf_dir).groupBy("source", band.alias("band")).agg(_n())


@query("validation_summary", f"WITH {_COMPARED_SQL}, l AS (SELECT CASE WHEN delta = 0 THEN 'PASS' WHEN abs(delta) = 1 OR expected = 0 THEN 'WARNING' ELSE 'FAIL' END AS level FROM compared) SELECT level, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share FROM l GROUP BY level")
def validation_summary(spark, sf_dir):
    level = F.when(F.col("delta") == 0, "PASS").when((F.abs("delta") == 1) | (F.col("expected") == 0), "WARNING").otherwise("FAIL")
    levels = _compared(spark, sf_dir).groupBy(level.alias("level")).agg(_n())
    return levels.join(levels.agg(F.sum("n").alias("all"))).select("level", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("share"))


@query("repeat_counts", f"WITH {PREDICTIONS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, section, count(*) OVER (PARTITION BY page, section) AS repeats FROM predictions WHERE section IS NOT NULL")
def repeat_counts(spark, sf_dir):
    """The number of rows with the same page and section, written back to each."""
    rows = predictions(spark, sf_dir).filter("section is not null")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "section", F.count(F.lit(1)).over(W.partitionBy("page", "section")).alias("repeats"))


@query("family_summary", f"WITH {PREDICTIONS_SQL} SELECT family, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity, min(quantity) AS least, max(quantity) AS most, count(DISTINCT page) AS pages FROM predictions GROUP BY family")
def family_summary(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("family").agg(_n(), F.sum("quantity").alias("quantity"), F.min("quantity").alias("least"), F.max("quantity").alias("most"), F.countDistinct("page").alias("pages"))


@query(
    "baseline_rows",
    f"""WITH {_BOXES}, s AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY page ORDER BY cy, box) > 10 THEN 1 ELSE 0 END AS brk FROM b), i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY page ORDER BY cy, box ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s)
SELECT page, island, count(*) AS n, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0 FROM i GROUP BY page, island""",
)
def baseline_rows(spark, sf_dir):
    """Boxes whose centres follow each other closely downwards are a row."""
    from ..operators.layout import islands

    w = W.partitionBy("page").orderBy("cy", "box")
    rows = islands(_boxes(spark, sf_dir), ["page"], [F.col("cy"), F.col("box")], F.col("cy") - F.lag("cy").over(w) > 10)
    return rows.groupBy("page", "island").agg(_n(), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"))


@query("spacing", f"WITH {_BOXES} SELECT page, box, x0 - lag(x1) OVER (PARTITION BY page ORDER BY x0, box) AS gap FROM b")
def spacing(spark, sf_dir):
    return _boxes(spark, sf_dir).select("page", "box", (F.col("x0") - F.lag("x1").over(W.partitionBy("page").orderBy("x0", "box"))).alias("gap"))


@query("latest_by_time", "SELECT event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def latest_by_time(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("occurrence_counters", f"WITH {PREDICTIONS_SQL} SELECT section, l_orderkey, l_partkey, l_suppkey, l_linenumber, section || '#' || row_number() OVER (PARTITION BY section ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS component FROM predictions WHERE section IS NOT NULL")
def occurrence_counters(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("section").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"))
    return predictions(spark, sf_dir).filter("section is not null").select("section", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat("section", F.lit("#"), nth.cast("string")).alias("component"))


@query(
    "semantic_collapse",
    f"""WITH {PREDICTIONS_SQL} SELECT page, section, max(confidence) AS confidence, count(*) AS n, list_sort(list_distinct(list(source))) AS sources FROM predictions WHERE section IS NOT NULL GROUP BY page, section""",
)
def semantic_collapse(spark, sf_dir):
    """One row a page and section: the best confidence, how many it stands for, and their sources."""
    rows = predictions(spark, sf_dir).filter("section is not null")
    return rows.groupBy("page", "section").agg(F.max("confidence").alias("confidence"), _n(), F.array_sort(F.collect_set("source")).alias("sources"))


@query("provenance_dedup", "SELECT source, lang, sha256(text) AS content, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY source, lang, sha256(text)")
def provenance_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang", F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("first"), _n())


@query("unique_tokens", f"WITH {PARTS_SQL} SELECT family, depth, list_sort(list_distinct(list(printed))) AS tokens FROM printed GROUP BY family, depth")
def unique_tokens(spark, sf_dir):
    return labelled_parts(spark, sf_dir).groupBy("family", "depth").agg(F.array_sort(F.collect_set("printed")).alias("tokens"))


@query("newest_retained", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def newest_retained(spark, sf_dir):
    """The five newest events of each user."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("place", place).filter("place <= 5").select("user_id", "event_id", "event_type")


@query("correction_counts", f"WITH {PREDICTIONS_SQL} SELECT page, count(*) FILTER (source = 'CORRECTION') AS corrected, count(*) FILTER (source = 'FUSION') AS fused, count(*) AS n FROM predictions GROUP BY page")
def correction_counts(spark, sf_dir):
    of = lambda s: F.count(F.when(F.col("source") == s, 1))
    return predictions(spark, sf_dir).groupBy("page").agg(of("CORRECTION").alias("corrected"), of("FUSION").alias("fused"), _n())


@query("representative_rows", f"WITH {PREDICTIONS_SQL} SELECT section, page, confidence, quantity FROM predictions WHERE section IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section ORDER BY confidence DESC, quantity DESC, page, l_orderkey, l_linenumber, l_partkey) = 1")
def representative_rows(spark, sf_dir):
    order = [F.desc("confidence"), F.desc("quantity"), *map(F.col, ("page", "l_orderkey", "l_linenumber", "l_partkey"))]
    return r.first_wins(predictions(spark, sf_dir).filter("section is not null"), ["section"], order).select("section", "page", "confidence", "quantity")
