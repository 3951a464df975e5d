"""Counting, its evaluation, and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quantity as q
from ..registry import query
from ..sources.tables import PREDICTIONS_SQL, TRUTH_SQL, predictions, truth

_COUNTED_SQL = f"""{PREDICTIONS_SQL},
rows AS (SELECT *, source = 'GEOMETRY' AS inferred, coalesce(eligible, FALSE) AND source IN ('FUSION', 'CORRECTION', 'ANNOTATION', 'SCHEDULE MARK MAP') AND section IS NOT NULL AS labeled
  FROM predictions WHERE eligible IS NULL OR eligible),
buckets AS (SELECT *, CASE WHEN section IS NULL THEN 'invalid_or_missing_section'
  WHEN inferred AND (page, section) IN (SELECT (page, section) FROM rows WHERE labeled) THEN 'excluded_geometry_duplicates'
  WHEN inferred THEN 'geometry_inference' WHEN NOT labeled THEN 'unlabeled_source'
  WHEN is_schedule AND section IN (SELECT section FROM rows WHERE labeled AND NOT is_schedule) THEN 'excluded_schedule_duplicates'
  WHEN is_schedule THEN 'excluded_schedule_only' ELSE 'counted' END AS bucket FROM rows),
counted AS (SELECT *, CASE WHEN bucket <> 'counted' THEN 0 WHEN typ_count BETWEEN 2 AND 20 THEN typ_count ELSE 1 END AS counted FROM buckets),
quantities AS (SELECT coalesce(section, '') AS section, CAST(sum(counted) AS BIGINT) AS quantity, ((200 * CAST(coalesce(sum(round(confidence * 100)) FILTER (bucket = 'counted'), 0) AS BIGINT) + greatest(count(*) FILTER (bucket = 'counted'), 1)) // (2 * greatest(count(*) FILTER (bucket = 'counted'), 1))) / 10000.0::DOUBLE AS confidence,
  count(*) FILTER (bucket = 'counted') AS rows_counted, count(*) FILTER (bucket <> 'counted') AS rows_excluded,
  CASE WHEN count(*) FILTER (bucket = 'counted') > 0 THEN 'labeled_callout' ELSE 'insufficient' END AS method FROM counted GROUP BY 1)"""

_COMPARED_SQL = f"""{_COUNTED_SQL}, {TRUTH_SQL},
both_sides AS (SELECT coalesce(f.section, t.section) AS section, coalesce(f.quantity, 0) AS predicted, coalesce(t.expected, 0) AS expected
  FROM (SELECT * FROM quantities WHERE quantity > 0) f FULL JOIN truth t ON f.section = t.section),
compared AS (SELECT section, predicted, expected, least(predicted, expected) AS caught, predicted - expected AS delta, greatest(predicted - expected, 0) AS excess,
  CASE WHEN expected > 0 THEN round(100.0::DOUBLE * least(predicted, expected) / expected, 1) END AS success_pct,
  CASE WHEN predicted = 0 AND expected > 0 THEN 'missing' WHEN expected = 0 AND predicted > 0 THEN 'extra' WHEN predicted > expected THEN 'over' WHEN predicted < expected THEN 'under' ELSE 'match' END AS status FROM both_sides)"""


def _compared(spark, sf_dir):
    found = q.quantities(predictions(spark, sf_dir)).filter("quantity > 0").select("section", F.col("quantity").alias("predicted"))
    return q.compare(found, truth(spark, sf_dir))


@query("quantity_engine", f"WITH {_COUNTED_SQL} SELECT * FROM quantities")
def quantity_engine(spark, sf_dir):
    return q.quantities(predictions(spark, sf_dir))


@query("quantity_buckets", f"WITH {_COUNTED_SQL} SELECT bucket, count(*) AS n, CAST(sum(counted) AS BIGINT) AS counted FROM counted GROUP BY bucket")
def quantity_buckets(spark, sf_dir):
    return q.with_buckets(predictions(spark, sf_dir)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("counted").alias("counted"))


@query("takeoff_evaluation", f"WITH {_COMPARED_SQL} SELECT * FROM compared")
def takeoff_evaluation(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(
    "evaluation_totals",
    f"""WITH {_COMPARED_SQL}, s AS (SELECT CAST(sum(caught) AS DOUBLE) AS c, sum(expected) AS g, sum(predicted) AS p, sum(abs(delta)) AS e, sum(delta) AS d, count(*) AS sections, count(*) FILTER (delta = 0) AS exact FROM compared)
SELECT CASE WHEN g > 0 THEN round(100 * c / g, 2) ELSE 0 END AS recall, CASE WHEN p > 0 THEN round(100 * c / p, 2) ELSE 0 END AS precision,
  CASE WHEN g + p > 0 THEN round(200 * c / (g + p), 2) ELSE 0 END AS f1, round(e / greatest(sections, 1), 4) AS mae, round(d / greatest(sections, 1), 4) AS bias, sections, exact FROM s""",
)
def evaluation_totals(spark, sf_dir):
    return q.totals(_compared(spark, sf_dir))


@query(
    "quantity_scoreboard",
    f"""WITH {_COMPARED_SQL} SELECT section, predicted, expected, delta, CASE WHEN predicted > 0 AND expected > 0 THEN CASE WHEN delta = 0 THEN 'match' WHEN delta < 0 THEN 'undercount' ELSE 'overcount' END
  WHEN expected > 0 THEN 'missing' ELSE 'extra' END AS bias FROM compared""",
)
def quantity_scoreboard(spark, sf_dir):
    both = (F.col("predicted") > 0) & (F.col("expected") > 0)
    bias = F.when(both & (F.col("delta") == 0), "match").when(both & (F.col("delta") < 0), "undercount").when(both, "overcount").when(F.col("expected") > 0, "missing").otherwise("extra")
    return _compared(spark, sf_dir).select("section", "predicted", "expected", "delta", bias.alias("bias"))


@query(
    "quantity_issues",
    f"""WITH {_COMPARED_SQL}, i AS (SELECT section, predicted, expected, unnest(CASE WHEN expected > 0 AND predicted = 0 THEN ['FAIL:not_found', 'FAIL:quantity'] WHEN expected = 0 AND predicted > 0 THEN ['WARNING:unexpected']
  WHEN delta = 0 THEN ['PASS:quantity'] WHEN abs(delta) = 1 THEN ['WARNING:quantity'] ELSE ['FAIL:quantity'] END) AS issue FROM compared)
SELECT section, predicted, expected, split_part(issue, ':', 1) AS level, split_part(issue, ':', 2) AS code FROM i""",
)
def quantity_issues(spark, sf_dir):
    return q.issues(_compared(spark, sf_dir))


@query("takeoff_export", f"WITH {_COUNTED_SQL} SELECT section, quantity, confidence, CAST(row_number() OVER (ORDER BY quantity DESC, section) AS INTEGER) AS line FROM quantities WHERE quantity > 0")
def takeoff_export(spark, sf_dir):
    return q.export_rows(q.quantities(predictions(spark, sf_dir)))


@query(
    "scope_rollup",
    f"""WITH {_COUNTED_SQL} SELECT family, source, CAST(grouping(family) * 2 + grouping(source) AS BIGINT) AS level, count(*) AS n, CAST(sum(counted) AS BIGINT) AS counted FROM counted GROUP BY ROLLUP (family, source)""",
)
def scope_rollup(spark, sf_dir):
    return q.with_buckets(predictions(spark, sf_dir)).rollup("family", "source").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("counted").alias("counted"))
