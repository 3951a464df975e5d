"""Deduplication, latest states, unions and reports over record tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import records as r
from ..registry import query
from ..sources.tables import PARTS_SQL, PREDICTIONS_SQL, predictions, table


@query("dedup_first", "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
def dedup_first(spark, sf_dir):
    return r.first_wins(table(spark, sf_dir, "documents").withColumn("key", F.sha2(F.lower("text"), 256)), ["key"], [F.col("doc_id")]).select("doc_id", "source", "n_chars")


@query(
    "dedup_best",
    f"WITH {PREDICTIONS_SQL} SELECT section, page, confidence, l_orderkey, l_linenumber, l_suppkey FROM predictions WHERE section IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section, page ORDER BY confidence DESC, l_orderkey, l_linenumber, l_partkey) = 1",
)
def dedup_best(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("section is not null")
    return r.first_wins(rows, ["section", "page"], [F.desc("confidence"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]).select("section", "page", "confidence", "l_orderkey", "l_linenumber", "l_suppkey")


_EVENTS = "e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query(
    "latest_outcome",
    f"""WITH {_EVENTS}, s AS (SELECT event_id - k AS gone FROM e WHERE k % 5 = 0) SELECT user_id, event_id, event_type, value FROM e WHERE k % 10 <> 9 AND event_id NOT IN (SELECT gone FROM s)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_outcome(spark, sf_dir):
    """An event whose k is a multiple of 5 supersedes the one k before it; those whose k ends in 9 are rejected."""
    e = _events(spark, sf_dir)
    gone = e.filter("k % 5 = 0").select((F.col("event_id") - F.col("k")).alias("event_id"))
    return r.latest(e.filter("k % 10 <> 9"), gone, "event_id", "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("queue_upsert", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) AS updates FROM events GROUP BY user_id, event_type")
def queue_upsert(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"), F.count(F.lit(1)).alias("updates"))


@query(
    "source_union",
    """WITH u AS (SELECT 'document' AS kind, lang AS name, length(text) AS n FROM documents UNION ALL SELECT 'turn', role, length(text) FROM conversations UNION ALL SELECT 'page', regexp_extract(url, '^[a-z]+'), length(html) FROM pages)
SELECT kind, name, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM u GROUP BY kind, name""",
)
def source_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("lang").alias("name"), F.length("text").alias("n"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("role").alias("name"), F.length("text").alias("n"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.regexp_extract("url", "^[a-z]+", 0).alias("name"), F.length("html").alias("n"))
    return docs.unionByName(turns).unionByName(pages).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))


@query("set_difference", f"WITH {PARTS_SQL} SELECT p_partkey, label FROM parts WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)")
def set_difference(spark, sf_dir):
    from ..sources.tables import labelled_parts

    ordered = table(spark, sf_dir, "lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return labelled_parts(spark, sf_dir).join(ordered, "p_partkey", "left_anti").select("p_partkey", "label")


@query("json_props", f"WITH {_EVENTS} SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum, min(k) AS k_min, max(k) AS k_max, round(avg(value), 4) AS value_avg FROM e GROUP BY event_type")
def json_props(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"), F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.round(F.avg("value"), 4).alias("value_avg"))


@query("html_scan", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def html_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"))


@query(
    "dashboard",
    "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
)
def dashboard(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value"))


@query(
    "results_page",
    f"WITH {PREDICTIONS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, section, confidence FROM predictions WHERE source = 'FUSION' AND confidence >= 0.5 ORDER BY confidence DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20 OFFSET 40",
)
def results_page(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return predictions(spark, sf_dir).filter("source = 'FUSION' and confidence >= 0.5").orderBy(F.desc("confidence"), *keys).offset(40).limit(20).select(*keys, "section", "confidence")


@query("threshold_trigger", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error') SELECT user_id, event_id, CAST(k // 10 AS BIGINT) AS trigger FROM n WHERE k % 10 = 0")
def threshold_trigger(spark, sf_dir):
    """Every tenth error of a user."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("k", k).filter("k % 10 = 0").select("user_id", "event_id", F.floor(F.col("k") / 10).alias("trigger"))


_STATUS = """CASE WHEN section IS NULL THEN 'pending_review' WHEN confidence >= 0.8 AND eligible IS NOT NULL AND family <> 'HP' THEN 'auto_accepted' WHEN source = 'CORRECTION' OR eligible IS NULL OR confidence < 0.55 THEN 'pending_review'
  WHEN is_schedule AND family <> 'HP' THEN 'accepted_unverified' WHEN is_schedule THEN 'correction_suggested' ELSE 'auto_accepted' END"""


@query("review_policy", f"WITH {PREDICTIONS_SQL}, s AS (SELECT *, {_STATUS} AS status FROM predictions) SELECT source, status, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM s GROUP BY source, status")
def review_policy(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("status", r.review_status()).groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query(
    "status_tags",
    f"""WITH {PREDICTIONS_SQL}, t AS (SELECT unnest(list_filter([CASE WHEN source = 'GEOMETRY' AND confidence < 0.8 THEN 'low_confidence' END, CASE WHEN section IS NULL THEN 'no_section' END, CASE WHEN eligible IS NULL THEN 'scope_unknown' END,
  CASE WHEN is_schedule THEN 'schedule' END], lambda x: x IS NOT NULL)) AS tag FROM predictions) SELECT tag, count(*) AS n FROM t GROUP BY tag""",
)
def status_tags(spark, sf_dir):
    return predictions(spark, sf_dir).select(F.explode(r.tags()).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("scope_partition", f"WITH {PREDICTIONS_SQL} SELECT CASE WHEN eligible IS NULL THEN 'unknown' WHEN eligible THEN 'primary' ELSE 'ignored' END AS scope, count(*) AS n, count(DISTINCT page) AS pages FROM predictions GROUP BY 1")
def scope_partition(spark, sf_dir):
    scope = F.when(F.col("eligible").isNull(), "unknown").when(F.col("eligible"), "primary").otherwise("ignored")
    return predictions(spark, sf_dir).groupBy(scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("pages"))
