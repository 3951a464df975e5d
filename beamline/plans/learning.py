"""Evaluation of labels, splits, patterns and fused scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import normalised
from ..operators import candidates
from ..operators import learning as m
from ..registry import query
from ..sources.tables import PARTS_SQL, PREDICTIONS_SQL, catalog, labelled_parts, predictions, table

#: The rule that stands for a model: a document of at least so many characters is good.
GOOD_CHARS = 1000
_JUDGED = f"j AS (SELECT l.doc_id, l.quality AS actual, CAST(d.n_chars >= {GOOD_CHARS} AS INTEGER) AS predicted, CAST(d.lang = 'en' AS INTEGER) AS other, d.n_chars, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("actual"), (F.col("n_chars") >= GOOD_CHARS).cast("int").alias("predicted"), (F.col("lang") == "en").cast("int").alias("other"), "n_chars", "source")


@query("confusion_entities", f"WITH {_JUDGED} SELECT actual, predicted, count(*) AS n FROM j GROUP BY actual, predicted")
def confusion_entities(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_rates",
    f"""WITH {_JUDGED}, c AS (SELECT k, count(*) FILTER (actual = k AND predicted = k) AS hits, count(*) FILTER (predicted = k) AS said, count(*) FILTER (actual = k) AS had FROM j, (VALUES (0), (1)) AS t(k) GROUP BY k)
SELECT k AS class, round(hits / nullif(said, 0), 6) AS precision, round(hits / nullif(had, 0), 6) AS recall FROM c""",
)
def class_rates(spark, sf_dir):
    k = _judged(spark, sf_dir).withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
    hit = F.count(F.when((F.col("actual") == F.col("class")) & (F.col("predicted") == F.col("class")), 1))
    said, had = F.count(F.when(F.col("predicted") == F.col("class"), 1)), F.count(F.when(F.col("actual") == F.col("class"), 1))
    return k.groupBy("class").agg(F.round(F.try_divide(hit, said), 6).alias("precision"), F.round(F.try_divide(hit, had), 6).alias("recall"))


@query(
    "mcnemar",
    f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (predicted = actual AND other <> actual) AS b, count(*) FILTER (predicted <> actual AND other = actual) AS c FROM j)
SELECT b, c, CASE WHEN b + c > 0 THEN round(greatest(abs(b - c) - 1, 0) * greatest(abs(b - c) - 1, 0) / CAST(b + c AS DOUBLE), 6) ELSE 0 END AS chi2 FROM c""",
)
def mcnemar(spark, sf_dir):
    """Two rules on the same documents: where only one is right, with the corrected chi-square."""
    right, other = F.col("predicted") == F.col("actual"), F.col("other") == F.col("actual")
    counts = _judged(spark, sf_dir).agg(F.count(F.when(right & ~other, 1)).alias("b"), F.count(F.when(~right & other, 1)).alias("c"))
    gap = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    return counts.select("b", "c", F.when(F.col("b") + F.col("c") > 0, F.round(gap * gap / (F.col("b") + F.col("c")), 6)).otherwise(0.0).alias("chi2"))


@query(
    "wilson",
    f"""WITH {_JUDGED}, c AS (SELECT source, CAST(count(*) FILTER (actual = predicted) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY source), p AS (SELECT *, hits / n AS p, 1.96 * 1.96 AS zz FROM c)
SELECT source, CAST(n AS BIGINT) AS n, round(greatest(0, least(1, (p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n))), 4) AS low,
  round(greatest(0, least(1, (p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n))), 4) AS high FROM p""",
)
def wilson(spark, sf_dir):
    c = _judged(spark, sf_dir).groupBy("source").agg(F.count(F.when(F.col("actual") == F.col("predicted"), 1)).cast("double").alias("hits"), F.count(F.lit(1)).cast("double").alias("n"))
    return c.select("source", F.col("n").cast("long").alias("n"), m.wilson(F.col("hits"), F.col("n"), -1).alias("low"), m.wilson(F.col("hits"), F.col("n"), 1).alias("high"))


@query(
    "calibration_bins",
    f"""WITH {_JUDGED}, s AS (SELECT actual, CAST(least(n_chars // 400, 9) AS BIGINT) AS bin, least(n_chars, 4000) AS score FROM j) SELECT bin, count(*) AS n, CAST(sum(score) AS BIGINT) AS score_sum, CAST(sum(actual) AS BIGINT) AS good, round(sum(actual) / count(*), 6) AS rate FROM s GROUP BY bin""",
)
def calibration_bins(spark, sf_dir):
    s = _judged(spark, sf_dir).select("actual", F.least(F.floor(F.col("n_chars") / 400), F.lit(9).cast("long")).alias("bin"), F.least("n_chars", F.lit(4000).cast("long")).alias("score"))
    return s.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"), F.sum("actual").alias("good"), F.round(F.sum("actual") / F.count(F.lit(1)), 6).alias("rate"))


@query(
    "hash_split",
    """WITH u AS (SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM u""",
)
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", m.split_of(F.col("doc_id").cast("string")).alias("split"))


@query("group_folds", "WITH f AS (SELECT source, doc_id, CAST('0x' || substr(sha256(source), 1, 4) AS BIGINT) % 5 AS fold FROM documents) SELECT fold, count(*) AS docs, count(DISTINCT source) AS sources FROM f GROUP BY fold")
def group_folds(spark, sf_dir):
    """All documents of a source are in one fold."""
    fold = F.conv(F.substring(F.sha2("source", 256), 1, 4), 16, 10).cast("long") % 5
    return table(spark, sf_dir, "documents").groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("source").alias("sources"))


@query(
    "feature_hash",
    """WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents) SELECT CAST('0x' || substr(md5(w), 1, 2) AS BIGINT) AS bucket, count(*) AS tokens, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1""",
)
def feature_hash(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")).alias("w"))
    per_doc = words.groupBy(F.conv(F.substring(F.md5("w"), 1, 2), 16, 10).cast("long").alias("bucket"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("bucket").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))


@query(
    "data_quality",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS blank, (SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM labels GROUP BY doc_id, quality, toxic HAVING count(*) > 1)) AS duplicates, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM labels)
SELECT n, blank, CAST(duplicates AS BIGINT) AS duplicates, round(greatest(good, bad) / greatest(1, least(good, bad)), 4) AS imbalance, CASE WHEN blank > 0 THEN 'fail' WHEN duplicates > 0 OR greatest(good, bad) >= 25 * greatest(1, least(good, bad)) THEN 'warning' ELSE 'pass' END AS status FROM c""",
)
def data_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy("doc_id", "quality", "toxic").agg(F.count(F.lit(1)).alias("k"))
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    c = rows.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), amount(F.col("quality").isNull()).alias("blank"), amount(F.col("k") > 1).alias("duplicates"), amount(F.col("quality") == 1).alias("good"), amount(F.col("quality") == 0).alias("bad"))
    more, less = F.greatest("good", "bad"), F.greatest(F.lit(1), F.least("good", "bad"))
    status = F.when(F.col("blank") > 0, "fail").when((F.col("duplicates") > 0) | (more >= 25 * less), "warning").otherwise("pass")
    return c.select("n", "blank", "duplicates", F.round(more / less, 4).alias("imbalance"), status.alias("status"))


@query("extraction_checks", "SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty, count(*) FILTER (n_chars < 100) AS short, count(*) FILTER (n_chars <> length(text)) AS miscounted FROM documents GROUP BY source")
def extraction_checks(spark, sf_dir):
    hits = lambda c: F.count(F.when(c, 1))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), hits(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), hits(F.col("n_chars") < 100).alias("short"), hits(F.col("n_chars") != F.length("text")).alias("miscounted"))


@query(
    "promotion_gate",
    f"""WITH {_JUDGED}, a AS (SELECT sum(CAST(predicted = actual AS INTEGER)) AS candidate, sum(CAST(other = actual AS INTEGER)) AS active, count(*) AS n FROM j)
SELECT round(candidate / n, 6) AS candidate, round(active / n, 6) AS active, CASE WHEN n = 0 THEN 'reject' WHEN 100 * candidate + 2 * n < 100 * active THEN 'reject' ELSE 'promote' END AS decision FROM a""",
)
def promotion_gate(spark, sf_dir):
    """The candidate is promoted unless it is more than 0.02 behind."""
    a = _judged(spark, sf_dir).agg(F.count(F.when(F.col("predicted") == F.col("actual"), 1)).alias("c"), F.count(F.when(F.col("other") == F.col("actual"), 1)).alias("a"), F.count(F.lit(1)).alias("n"))
    decision = F.when((F.col("n") == 0) | (100 * F.col("c") + 2 * F.col("n") < 100 * F.col("a")), "reject").otherwise("promote")
    return a.select(F.round(F.try_divide("c", "n"), 6).alias("candidate"), F.round(F.try_divide("a", "n"), 6).alias("active"), decision.alias("decision"))


_SIGNATURE = "regexp_replace(regexp_replace(printed, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g')"


@query("pattern_signatures", f"WITH {PARTS_SQL} SELECT {_SIGNATURE} AS signature, count(*) AS n, count(DISTINCT family) AS families, min(printed) AS example FROM printed GROUP BY 1")
def pattern_signatures(spark, sf_dir):
    return labelled_parts(spark, sf_dir).groupBy(m.signature(F.col("printed")).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("family").alias("families"), F.min("printed").alias("example"))


@query(
    "pattern_coverage",
    f"""WITH {PARTS_SQL}, s AS (SELECT family, {_SIGNATURE} AS signature, count(*) AS n FROM printed GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY family) AS total FROM s)
SELECT family, signature, n, round(least(0.97::DOUBLE, 0.45::DOUBLE * (n / total) + 0.35::DOUBLE * least(1.0::DOUBLE, n / 5.0::DOUBLE) + 0.20::DOUBLE * greatest(0.05::DOUBLE, 1 - greatest(0.0::DOUBLE, least(0.55::DOUBLE, (length(signature) - 24) / 100.0::DOUBLE)))), 4) AS confidence FROM t""",
)
def pattern_coverage(spark, sf_dir):
    s = labelled_parts(spark, sf_dir).groupBy("family", m.signature(F.col("printed")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    totals = s.groupBy("family").agg(F.sum("n").alias("total"))
    return s.join(totals, "family").select("family", "signature", "n", m.pattern_confidence(F.col("n"), F.col("n") / F.col("total"), F.length("signature")).alias("confidence"))


@query(
    "variants",
    f"""WITH {PARTS_SQL}, v AS (SELECT DISTINCT label, unnest([label, lower(label), replace(label, 'X', ' X '), replace(label, 'X', 'x'), family || ' ' || depth || 'X' || weight, family || '-' || depth || 'X' || weight, replace(label, '0', 'O')]) AS variant FROM catalog),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY length(variant), lower(variant), variant) AS INTEGER) AS place FROM v) SELECT label, variant, place, upper(replace(variant, ' ', '')) = label AS original FROM r WHERE place <= 14""",
)
def variants(spark, sf_dir):
    """Ways to write a label, shortest first; original where only case and spaces differ."""
    f, d, w, label = F.col("family"), F.col("depth").cast("string"), F.col("weight").cast("string"), F.col("label")
    ways = F.array(label, F.lower(label), F.replace(label, F.lit("X"), F.lit(" X ")), F.replace(label, F.lit("X"), F.lit("x")), F.concat(f, F.lit(" "), d, F.lit("X"), w), F.concat(f, F.lit("-"), d, F.lit("X"), w), F.replace(label, F.lit("0"), F.lit("O")))
    rows = catalog(spark, sf_dir).select("label", F.explode(F.array_distinct(ways)).alias("variant"))
    cut = candidates.first_of(rows, ["label"], [F.length("variant"), F.lower("variant"), F.col("variant")], 14)
    return cut.select("label", "variant", "place", (normalised(F.col("variant")) == F.col("label")).alias("original"))


@query(
    "hard_negatives",
    f"""WITH {PARTS_SQL}, j AS (SELECT a.label, b.label AS near, 10 * abs(a.depth - b.depth) + abs(a.weight - b.weight) AS distance FROM catalog a JOIN catalog b ON a.family = b.family AND abs(a.depth - b.depth) <= 1 AND a.label <> b.label)
SELECT label, near, distance FROM j WHERE distance <= 3""",
)
def hard_negatives(spark, sf_dir):
    return candidates.near_fields(catalog(spark, sf_dir), within=3)


@query(
    "attention_fusion",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT source, 0.32::DOUBLE * pow(least(greatest(confidence, 0.05::DOUBLE), 1.0::DOUBLE), 0.75::DOUBLE) AS t, CASE WHEN source <> 'FUSION' THEN 0.30::DOUBLE * pow(least(greatest(quantity / 50.0::DOUBLE, 0.05::DOUBLE), 1.0::DOUBLE), 0.75::DOUBLE) ELSE 0.0 END AS g,
  CASE WHEN eligible THEN 0.17::DOUBLE ELSE 0.0 END AS n FROM predictions)
SELECT source, round(avg(t / (t + g + n)), 6) AS text, round(avg(g / (t + g + n)), 6) AS geometry, round(avg(n / (t + g + n)), 6) AS graph FROM r GROUP BY source""",
)
def attention_fusion(spark, sf_dir):
    w = m.attention({"text": F.col("confidence"), "geometry": F.when(F.col("source") != "FUSION", F.col("quantity") / 50.0), "graph": F.when(F.col("eligible"), F.lit(1.0))})
    return predictions(spark, sf_dir).select("source", *[v.alias(k) for k, v in w.items()]).groupBy("source").agg(*[F.round(F.avg(k), 6).alias(k) for k in w])


@query(
    "embedding_centroids",
    """WITH f AS (SELECT vec_id, label, CAST(i AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS u(i)), c AS (SELECT label AS nearest, pos, avg(x) AS c FROM f GROUP BY label, pos),
s AS (SELECT vec_id, label, nearest, sum(x * c) AS score FROM f JOIN c ON f.pos = c.pos GROUP BY ALL) SELECT vec_id, label, nearest, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id, label ORDER BY score DESC, nearest DESC) = 1""",
)
def embedding_centroids(spark, sf_dir):
    return m.nearest_centroid(table(spark, sf_dir, "embeddings"))
