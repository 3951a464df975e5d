"""Exact forms of windows, ranks, rates and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.labels import family_of, normalised, repaired
from ..operators import candidates as c
from ..operators import graph
from ..registry import query
from ..sources import files
from ..sources.scratch import scratch_path
from ..sources.tables import PARTS_SQL, PREDICTIONS_SQL, catalog, labelled_parts, predictions, table
from .catalog import _NORM, _UNION, _union
from .layout import _BOXES, _boxes, _pairs
from .learning import _JUDGED, _judged


def _n():
    return F.count(F.lit(1)).alias("n")


@query(
    "windows_to_six",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
t AS (SELECT doc_id, pos, length(word) AS n, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM u)
SELECT a.doc_id, CAST(s.size AS INTEGER) AS size, count(*) AS windows, count(*) FILTER (b.c - a.c + a.n <= 24) AS short FROM t a CROSS JOIN (SELECT unnest(range(1, 7)) AS size) s JOIN t b ON b.doc_id = a.doc_id AND b.pos = a.pos + s.size - 1 GROUP BY 1, 2""",
)
def windows_to_six(spark, sf_dir):
    """Windows of one to six neighbouring words of each text, and those that a label may fill."""
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws")).withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(6)))).filter(F.size("ws") >= F.col("size"))
    g = F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1), lambda i: F.array_join(F.slice("ws", i, F.col("size")), " "))
    return rows.select("doc_id", "size", g.alias("g")).select("doc_id", "size", F.size("g").cast("long").alias("windows"), F.size(F.filter("g", lambda x: F.length(x) <= 24)).cast("long").alias("short"))


@query(
    "line_context",
    """WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, length(string_split(text, chr(10))[i]) AS n FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i))
SELECT doc_id, pos, lag(n, 2) OVER w AS before2, lag(n) OVER w AS before1, lead(n) OVER w AS after1, lead(n, 2) OVER w AS after2 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
)
def line_context(spark, sf_dir):
    """The two lines before and after each, by length."""
    w = W.partitionBy("doc_id").orderBy("pos")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("n", F.length("line").cast("long"))
    return lines.select("doc_id", "pos", F.lag("n", 2).over(w).alias("before2"), F.lag("n").over(w).alias("before1"), F.lead("n").over(w).alias("after1"), F.lead("n", 2).over(w).alias("after2"))


@query("greedy_assignment")
def greedy_assignment(spark, sf_dir):
    """Boxes paired one to one, nearest first; ties abstain."""
    return graph.greedy_assignment(_pairs(spark, sf_dir).filter(F.col("box") < F.col("box_b")).select("page", "box", "box_b", "d2"), 8)


@query(
    "rank_slices",
    f"""WITH {PARTS_SQL}, {_UNION}, h AS (SELECT p.p_partkey % 7 AS damage, min(u.place) AS place FROM parts p LEFT JOIN united u ON u.p_partkey = p.p_partkey AND u.label = p.label AND u.place <= 25 GROUP BY p.p_partkey)
SELECT damage, count(*) AS n, round(avg(CASE WHEN place <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall1, round(avg(CASE WHEN place <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall5, round(avg(CASE WHEN place IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_any, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr FROM h GROUP BY damage""",
)
def rank_slices(spark, sf_dir):
    """Recall at 1, 5 and any place and mean reciprocal rank by kind of damage."""
    truth = labelled_parts(spark, sf_dir).select("p_partkey", "label", (F.col("p_partkey") % 7).alias("damage"))
    hit = truth.join(_union(spark, sf_dir), ["p_partkey", "label"], "left").groupBy("p_partkey", "damage").agg(F.min("place").alias("place"))
    rate = lambda x: F.round(F.avg(F.coalesce(x, F.lit(False)).cast("double")), 6)
    place = F.col("place")
    return hit.groupBy("damage").agg(_n(), rate(place <= 1).alias("recall1"), rate(place <= 5).alias("recall5"), rate(place.isNotNull()).alias("recall_any"), F.round(F.avg(F.coalesce(1.0 / place, F.lit(0.0))), 6).alias("mrr"))


@query("ordered_tokens", f"WITH {PARTS_SQL}, f AS (SELECT family, depth, printed, min(p_partkey) AS first FROM printed GROUP BY ALL) SELECT family, depth, list(printed ORDER BY first) AS tokens FROM f GROUP BY family, depth")
def ordered_tokens(spark, sf_dir):
    """The distinct prints of each size in the order in which they first come."""
    once = labelled_parts(spark, sf_dir).groupBy("family", "depth", "printed").agg(F.min("p_partkey").alias("first"))
    return once.groupBy("family", "depth").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "printed"))), lambda x: x["printed"]).alias("tokens"))


_MASK = f"CASE p_partkey % 3 WHEN 0 THEN '*' || substr({_NORM}, 2) WHEN 1 THEN substr({_NORM}, 1, length({_NORM}) - 1) || '?' ELSE substr({_NORM}, 1, 2) || '*' || substr({_NORM}, 4) END"


@query(
    "mask_reasons",
    f"""WITH {PARTS_SQL}, m AS (SELECT p_partkey, {_MASK} AS mask FROM printed), j AS (SELECT m.p_partkey, m.mask, c.label, CAST(row_number() OVER (PARTITION BY m.p_partkey ORDER BY c.label) AS INTEGER) AS place
  FROM m JOIN catalog c ON regexp_extract(m.mask, '^(WT|HP|MC|W|M|C)', 1) = c.family AND length(c.label) = length(m.mask) AND c.label LIKE replace(replace(m.mask, '*', '_'), '?', '_'))
SELECT p_partkey, mask, label, place, 'exact length ' || length(mask) || ', ' || (length(mask) - length(replace(replace(mask, '*', ''), '?', ''))) || ' open' AS reason FROM j WHERE place <= 8""",
)
def mask_reasons(spark, sf_dir):
    """Labels that a mask of * and ? fits, one character each, with the reason in words."""
    printed = labelled_parts(spark, sf_dir).select("p_partkey", "printed")
    masks = printed.select("p_partkey", F.expr(_MASK).alias("mask")).withColumn("family", family_of(F.col("mask"))).withColumn("n", F.length("mask"))
    asked = masks.select("p_partkey", "family", "n", F.col("mask").alias("asked"), F.translate("mask", "*?", "__").alias("mask"))
    labels = catalog(spark, sf_dir).select("label", "family", F.length("label").alias("n"), F.col("label").alias("text"))
    best = c.first_of(c.fitting(asked, labels, ["family", "n"]), ["family", "mask"], [F.col("label")], 8).select("family", "mask", "label", "place")
    found = c.first_of_asked(asked, best, ["family", "mask"], 8).drop("mask").withColumnRenamed("asked", "mask")
    open_ = F.length("mask") - F.length(F.translate("mask", "*?", ""))
    reason = F.concat(F.lit("exact length "), F.col("n").cast("string"), F.lit(", "), open_.cast("string"), F.lit(" open"))
    return found.select("p_partkey", "mask", "label", "place", reason.alias("reason"))


@query(
    "micro_rates",
    f"""WITH {_JUDGED}, k AS (SELECT source, count(*) FILTER (actual = 1 AND predicted = 1) AS tp, count(*) FILTER (actual = 0 AND predicted = 1) AS fp, count(*) FILTER (actual = 1 AND predicted = 0) AS fn, count(*) FILTER (actual = predicted) AS hits, count(*) AS n FROM j GROUP BY source),
s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(hits) AS hits, sum(n) AS n FROM k)
SELECT round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(hits / n, 6) AS accuracy FROM s""",
)
def micro_rates(spark, sf_dir):
    """Precision, recall, F1 and accuracy over all sources' counts together."""
    hit = lambda a, p: F.count(F.when((F.col("actual") == a) & (F.col("predicted") == p), 1))
    s = _judged(spark, sf_dir).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), F.count(F.when(F.col("actual") == F.col("predicted"), 1)).alias("hits"), _n())
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("hits"), F.col("n")).alias("accuracy"))


@query("dedup_place", f"WITH {_BOXES}, r AS (SELECT page, split_part(box, '-', 2) AS text, x0 // 10 AS gx, y0 // 10 AS gy, box FROM b) SELECT page, text, gx, gy, min(box) AS first, count(*) AS n FROM r GROUP BY ALL")
def dedup_place(spark, sf_dir):
    """The first of the boxes that share page, text and rounded place."""
    cell = lambda x: F.floor(F.col(x) / 10)
    text = F.split("box", "-")[1]
    return _boxes(spark, sf_dir).groupBy("page", text.alias("text"), cell("x0").alias("gx"), cell("y0").alias("gy")).agg(F.min("box").alias("first"), _n())


@query(
    "catalog_csv_check",
    """WITH r AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 50 = 0 THEN p_brand ELSE p_name END AS label, CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE p_type END AS kind FROM part),
e AS (SELECT label, count(*) AS n, count(DISTINCT kind) AS kinds, count(*) FILTER (coalesce(trim(kind), '') = '') AS blank FROM r GROUP BY label), o AS (SELECT coalesce(trim(label), '') = '' AS none, * FROM e)
SELECT unnest(['blank_label', 'blank_type', 'no_digit', 'repeated', 'conflicting']) AS fault, unnest([CAST(coalesce(sum(n) FILTER (none), 0) AS BIGINT), CAST(coalesce(sum(blank), 0) AS BIGINT), CAST(coalesce(sum(n) FILTER (NOT none AND NOT regexp_matches(label, '[0-9]')), 0) AS BIGINT),
  CAST(coalesce(sum(n - 1) FILTER (NOT none AND n > 1), 0) AS BIGINT), CAST(count(*) FILTER (NOT none AND kinds > 1) AS BIGINT)]) AS n FROM o""",
)
def catalog_csv_check(spark, sf_dir):
    """A catalog written as CSV, read back as text, and its structural faults counted."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = part.select(F.when(key % 97 == 0, None).when(key % 50 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("label"), F.when(key % 89 != 0, F.col("p_type")).alias("kind"))
    path = scratch_path(spark, "catalog-csv")
    rows.write.option("header", True).csv(path)
    return files.catalog_faults(files.read_csv_text(spark, path, ["label", "kind"]), "label", "kind")


@query(
    "stratified_folds",
    """WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) SELECT doc_id, lang, CAST(place % 5 AS BIGINT) AS fold FROM d""",
)
def stratified_folds(spark, sf_dir):
    """Five folds with the same share of each language.

    Rows are ranked by hash within 256 salted parts of a language, and the sizes of the parts before give the rank in the whole.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h")).withColumn("part", F.substring("h", 1, 2))
    sizes = d.groupBy("lang", "part").agg(_n())
    before = sizes.select(F.col("lang").alias("l"), F.col("part").alias("p"), (F.sum("n").over(W.partitionBy("lang").orderBy("part")) - F.col("n")).alias("before"))  # 256 rows a language
    within = F.row_number().over(W.partitionBy("lang", "part").orderBy("h", "doc_id"))
    placed = d.withColumn("within", within).join(F.broadcast(before), F.col("lang").eqNullSafe(F.col("l")) & (F.col("part") == F.col("p")))
    return placed.select("doc_id", "lang", ((F.col("before") + F.col("within")) % 5).cast("long").alias("fold"))


@query(
    "section_worst",
    f"""WITH {PREDICTIONS_SQL}, l AS (SELECT page, CASE WHEN section IS NULL THEN 2 WHEN confidence < 0.55 OR eligible IS NULL THEN 1 ELSE 0 END AS level FROM predictions)
SELECT page, CASE max(level) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS worst, count(*) FILTER (level = 0) AS passed, count(*) AS n FROM l GROUP BY page""",
)
def section_worst(spark, sf_dir):
    """The worst status of each page, and how many rows pass."""
    level = F.when(F.col("section").isNull(), 2).when((F.col("confidence") < 0.55) | F.col("eligible").isNull(), 1).otherwise(0)
    worst = F.max("level")
    rows = predictions(spark, sf_dir).select("page", level.alias("level"))
    return rows.groupBy("page").agg(F.when(worst == 2, "FAIL").when(worst == 1, "WARNING").otherwise("PASS").alias("worst"), F.count(F.when(F.col("level") == 0, 1)).alias("passed"), _n())


@query("repaired_prints")
def repaired_prints(spark, sf_dir):
    """Prints as a scanner reads them, repaired where the neighbours leave no doubt."""
    read = F.translate(F.concat_ws(" x ", normalised(F.col("printed")), F.col("weight").cast("string")), "1", "I")
    rows = labelled_parts(spark, sf_dir).select("p_partkey", read.alias("read"))
    return rows.select("p_partkey", "read", repaired(F.col("read")).alias("value"), (repaired(F.col("read")) != F.trim("read")).alias("changed"))
