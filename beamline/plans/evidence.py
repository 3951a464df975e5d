"""Schedules, reviews, overlaps, calibration and measures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import folds
from ..operators.neighbours import nearest_of_label
from ..registry import query
from ..sources.tables import PARTS_SQL, PREDICTIONS_SQL, boxes, labelled_parts, predictions, table
from .layout import _BOXES, _PAIRS, _boxes, _each, _paged, _pairs
from .learning import _JUDGED, _judged


def _n():
    return F.count(F.lit(1)).alias("n")


_SCHEDULE = f"""{PREDICTIONS_SQL}, marks AS (SELECT page, l_partkey % 40 AS mark, min(section) AS size, count(DISTINCT section) AS sizes FROM predictions WHERE is_schedule AND section IS NOT NULL GROUP BY 1, 2)"""


def _marks(spark, sf_dir):
    """The sizes that the schedules of a page give a mark."""
    rows = predictions(spark, sf_dir).withColumn("mark", F.col("l_partkey") % 40)
    return rows, rows.filter("is_schedule and section is not null").groupBy("page", "mark").agg(F.min("section").alias("size"), F.countDistinct("section").alias("sizes"))


@query(
    "mark_sizes",
    f"""WITH {_SCHEDULE}, t AS (SELECT page, l_partkey % 40 AS mark, count(*) AS n FROM predictions WHERE NOT is_schedule GROUP BY 1, 2)
SELECT t.page, t.mark, t.n, CASE WHEN m.sizes = 1 THEN m.size END AS size, CASE WHEN m.sizes IS NULL THEN 'absent' WHEN m.sizes = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM t LEFT JOIN marks m ON m.page = t.page AND m.mark = t.mark""",
)
def mark_sizes(spark, sf_dir):
    """Marks on a page by its schedules: a size only where all its rows agree, else an abstention."""
    rows, marks = _marks(spark, sf_dir)
    tokens = rows.filter("not is_schedule").groupBy("page", "mark").agg(_n())
    status = F.when(F.col("sizes").isNull(), "absent").when(F.col("sizes") == 1, "resolved").otherwise("ambiguous")
    return tokens.join(marks, ["page", "mark"], "left").select("page", "mark", "n", F.when(F.col("sizes") == 1, F.col("size")).alias("size"), status.alias("status"))


@query(
    "mark_cross_check",
    f"""WITH {_SCHEDULE}, t AS (SELECT DISTINCT page, l_partkey % 40 AS mark FROM predictions WHERE NOT is_schedule)
SELECT coalesce(t.page, m.page) AS page, count(*) FILTER (m.page IS NULL) AS unlisted, count(*) FILTER (t.page IS NULL) AS unused, count(*) FILTER (m.page IS NOT NULL AND t.page IS NOT NULL) AS both FROM t FULL JOIN marks m ON m.page = t.page AND m.mark = t.mark GROUP BY 1""",
)
def mark_cross_check(spark, sf_dir):
    """Of each page the marks that only words, only schedules, or both hold."""
    rows, marks = _marks(spark, sf_dir)
    words = rows.filter("not is_schedule").select("page", "mark").distinct().withColumn("word", F.lit(True))
    both = words.join(marks.select("page", "mark", F.lit(True).alias("listed")), ["page", "mark"], "full")
    hits = lambda c: F.count(F.when(c, 1))
    return both.groupBy("page").agg(hits(F.col("listed").isNull()).alias("unlisted"), hits(F.col("word").isNull()).alias("unused"), hits(F.col("word") & F.col("listed")).alias("both"))


@query(
    "unpivot_measures",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS field, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem""",
)
def unpivot_measures(spark, sf_dir):
    """One row for each cell of a row of measures."""
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    wide = table(spark, sf_dir, "lineitem").select(*ids, F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return wide.unpivot(ids, ["quantity", "discount", "tax"], "field", "value")


@query(
    "review_overlay",
    f"""WITH {PREDICTIONS_SQL}, h AS (SELECT user_id, arg_max('H' || CAST(floor(value) AS BIGINT), (ts, event_id)) AS section FROM events WHERE event_type = 'purchase' GROUP BY user_id),
o AS (SELECT p.page, p.section, h.section AS human, CASE WHEN p.section IS NULL AND p.eligible AND p.page % 3 = 0 THEN 'R' || p.family END AS rule FROM predictions p LEFT JOIN h ON h.user_id = p.l_orderkey)
SELECT page, CASE WHEN human IS NOT NULL THEN 'human' WHEN rule IS NOT NULL THEN 'rule' WHEN section IS NOT NULL THEN 'prediction' ELSE 'none' END AS decided_by, count(*) AS n, count(DISTINCT coalesce(human, rule, section)) AS sections FROM o GROUP BY 1, 2""",
)
def review_overlay(spark, sf_dir):
    """The latest human choice of an object goes before a page's rule, and that before the prediction."""
    chosen = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max_by(F.concat(F.lit("H"), F.floor("value").cast("string")), F.struct("ts", "event_id")).alias("human"))
    rows = predictions(spark, sf_dir)
    rule = F.when(F.col("section").isNull() & F.col("eligible") & (F.col("page") % 3 == 0), F.concat(F.lit("R"), F.col("family")))
    over = rows.join(chosen, rows["l_orderkey"] == chosen["user_id"], "left").withColumn("rule", rule)
    by = F.when(F.col("human").isNotNull(), "human").when(F.col("rule").isNotNull(), "rule").when(F.col("section").isNotNull(), "prediction").otherwise("none")
    return over.groupBy("page", by.alias("decided_by")).agg(_n(), F.countDistinct(F.coalesce("human", "rule", "section")).alias("sections"))


@query(
    "import_codes",
    """WITH e AS (SELECT event_id, event_type, value, user_id, count(*) OVER (PARTITION BY user_id, ts) > 1 AS twice FROM events),
c AS (SELECT unnest(list_filter([CASE WHEN user_id IS NULL OR user_id % 17 = 0 THEN 'missing_reviewer_id' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'invalid_review_label' END,
  CASE WHEN twice THEN 'duplicate_outcome_id' END, CASE WHEN value IS NULL OR value > 100 THEN 'target_outside_candidate_set' END, 'read'], lambda x: x IS NOT NULL)) AS code FROM e) SELECT code, count(*) AS n FROM c GROUP BY code""",
)
def import_codes(spark, sf_dir):
    """How often each validation code is raised; a row may raise several."""
    events = table(spark, sf_dir, "events")
    many = events.groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("k"))
    rows = events.groupBy("user_id", "ts", "event_type", "value").agg(F.count(F.lit(1)).alias("here")).join(many.select(F.col("user_id").alias("u"), F.col("ts").alias("t"), "k"), F.col("user_id").eqNullSafe(F.col("u")) & F.col("ts").eqNullSafe(F.col("t")))
    when = lambda c, code: F.when(c, F.lit(code))
    codes = F.array_compact(F.array(
        when(F.col("user_id").isNull() | (F.col("user_id") % 17 == 0), "missing_reviewer_id"), when(~F.col("event_type").isin("click", "view", "purchase"), "invalid_review_label"),
        when(F.col("k") > 1, "duplicate_outcome_id"), when(F.col("value").isNull() | (F.col("value") > 100), "target_outside_candidate_set"), F.lit("read"),
    ))
    return rows.select(F.explode(codes).alias("code"), "here").groupBy("code").agg(F.sum("here").alias("n"))


@query("longest_match")
def longest_match(spark, sf_dir):
    """Boxes of one line of a page as matches: of those that overlap the longest stay."""
    return folds.longest_matches(_boxes(spark, sf_dir).select("page", "y0", "box", "x0", "x1"), ["page", "y0"], "x0", "x1", "box")


@query("duplicate_merge")
def duplicate_merge(spark, sf_dir):
    """Boxes of one id are one, and so are those of one page and label that overlap the survivor by 60 % of the union."""
    parts = labelled_parts(spark, sf_dir).select("p_partkey", "label")
    b = boxes(spark, sf_dir).withColumn("confidence", (F.col("x1") - F.col("x0")).cast("double"))
    b = b.withColumn("id", F.concat_ws("-", "l_orderkey", "l_partkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    once = folds.merge_ids(b, "id", ["page", "x0", "y0", "x1", "y1"])
    return folds.merge_duplicates(once, ["page", "label"], ["l_orderkey", "l_partkey"])


_BINS = f"{_JUDGED}, bins AS (SELECT CAST(least(n_chars // 400, 9) AS BIGINT) AS bin, count(*) AS n, CAST(sum(actual) AS BIGINT) AS good FROM j GROUP BY 1)"


@query(
    "calibration_isotonic",
    f"""WITH {_BINS}, s AS (SELECT a.bin AS lo, b.bin AS hi, (SELECT sum(good) / sum(n) FROM bins c WHERE c.bin BETWEEN a.bin AND b.bin) AS mean FROM bins a JOIN bins b ON a.bin <= b.bin),
m AS (SELECT i.bin, s.lo, min(s.mean) AS low FROM bins i JOIN s ON s.lo <= i.bin AND s.hi >= i.bin GROUP BY 1, 2)
SELECT b.bin, b.n, b.good, round(max(m.low), 6) AS rate FROM bins b JOIN m ON m.bin = b.bin GROUP BY 1, 2, 3""",
)
def calibration_isotonic(spark, sf_dir):
    """The isotonic fit of the rate of good documents over ten bins of length: the greatest of the least mean rates."""
    bins = _judged(spark, sf_dir).groupBy(F.least(F.floor(F.col("n_chars") / 400), F.lit(9).cast("long")).alias("bin")).agg(_n(), F.sum("actual").alias("good"))
    table_ = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "n", "good"))).alias("t"))  # ten entries at most
    total = lambda rows, c: F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x[c])
    mean = lambda lo, hi: total(F.slice("t", lo, hi - lo + 1), "good") / total(F.slice("t", lo, hi - lo + 1), "n")
    upto = F.sequence(F.lit(1), F.col("i"))
    onward = F.sequence(F.col("i"), F.size("t"))
    rate = F.array_max(F.transform(upto, lambda lo: F.array_min(F.transform(onward, lambda hi: mean(lo, hi)))))
    at = table_.select("t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i"))
    return at.select(F.col("t")[F.col("i") - 1]["bin"].alias("bin"), F.col("t")[F.col("i") - 1]["n"].alias("n"), F.col("t")[F.col("i") - 1]["good"].alias("good"), F.round(rate, 6).alias("rate"))


@query(
    "mcnemar_exact",
    f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (predicted = actual AND other <> actual) AS b, count(*) FILTER (predicted <> actual AND other = actual) AS c FROM j),
t AS (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS i FROM c)
SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) END, 6) AS p FROM t GROUP BY b, c""",
)
def mcnemar_exact(spark, sf_dir):
    """The exact two-sided binomial p of two rules on the same documents."""
    right, other = F.col("predicted") == F.col("actual"), F.col("other") == F.col("actual")
    counts = _judged(spark, sf_dir).agg(F.count(F.when(right & ~other, 1)).alias("b"), F.count(F.when(~right & other, 1)).alias("c"))
    n, less = F.col("b") + F.col("c"), F.least("b", "c")
    # Each term's logarithm comes from the one before it.
    zero = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    tail = F.when(less > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(less, F.lit(1).cast("long"))), zero, add)["sum"]).otherwise(zero["sum"])
    return counts.select("b", "c", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 6).alias("p"))


@query("top_misclassified", f"WITH {_JUDGED} SELECT source, actual, predicted, count(*) AS n FROM j WHERE actual <> predicted GROUP BY ALL ORDER BY n DESC, source, actual LIMIT 5")
def top_misclassified(spark, sf_dir):
    """The five cells off the diagonal that hold most."""
    return _judged(spark, sf_dir).filter("actual <> predicted").groupBy("source", "actual", "predicted").agg(_n()).orderBy(F.desc("n"), "source", "actual").limit(5)


@query(
    "feature_hash_signed",
    """WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents),
b AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 2) AS BIGINT) % 128 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(w), 3, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2),
s AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS norm FROM b)
SELECT doc_id, bucket, round(v / norm, 6) AS x FROM s WHERE v <> 0""",
)
def feature_hash_signed(spark, sf_dir):
    """Words hashed to 128 signed dimensions of unit length, by their non-zero entries."""
    digest = lambda a: F.conv(F.substring(F.md5("w"), a, 2), 16, 10).cast("long")
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")).alias("w"))
    sums = words.groupBy("doc_id", (digest(1) % 128).alias("bucket")).agg(F.sum(F.when(digest(3) % 2 == 0, 1).otherwise(-1)).alias("v"))
    all_ = sums.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "v")).alias("e"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))  # 128 entries at most
    return all_.select("doc_id", "norm", F.explode("e").alias("x")).filter("x.v <> 0").select("doc_id", "x.bucket", F.round(F.col("x.v") / F.col("norm"), 6).alias("x"))


@query(
    "embedding_knn",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.e, c.e) / (q.norm * c.norm), 4) AS cosine FROM u q JOIN u c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND q.norm > 0 AND c.norm > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS place FROM s) SELECT * FROM r WHERE place <= 5""",
)
def embedding_knn(spark, sf_dir):
    """The five nearest vectors by cosine among those of the query's label; queries are the ids divisible by 20."""
    return nearest_of_label(table(spark, sf_dir, "embeddings"), 20, 5)


@query(
    "windowed_pairs",
    f"""WITH {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, box) AS place FROM b)
SELECT a.page, a.box, c.box AS box_b FROM o a JOIN o c ON a.page = c.page AND c.place BETWEEN a.place + 1 AND a.place + 11 WHERE a.place <= 60 AND (a.cx - c.cx) * (a.cx - c.cx) + (a.cy - c.cy) * (a.cy - c.cy) <= 4 * 160 * 160""",
)
def windowed_pairs(spark, sf_dir):
    """The first 60 boxes of a page in reading order, each with the next 11 within 160.

    A page's boxes are read once in order, with those that follow at hand, so that no pair is made by a join.
    """
    read = W.partitionBy("page").orderBy("y0", "x0", "box")

    def pairs(rows):
        first = rows.filter("page is not null").withColumn("place", F.row_number().over(read)).filter("place <= 71")
        met = first.withColumn("next", F.collect_list(F.struct("box", "cx", "cy")).over(read.rowsBetween(1, 11))).filter("place <= 60")
        met = met.select("page", "box", "cx", "cy", F.explode("next").alias("n"))
        dx, dy = F.col("cx") - F.col("n.cx"), F.col("cy") - F.col("n.cy")
        return met.filter(dx * dx + dy * dy <= 4 * 160 * 160).select("page", "box", F.col("n.box").alias("box_b"))

    return _each(_paged(spark, sf_dir), pairs)


@query(
    "label_groups",
    f"""WITH {_PAIRS}, r AS (SELECT page, box, box_b, d2, row_number() OVER (PARTITION BY page, box ORDER BY d2, box_b) AS k, count(*) OVER (PARTITION BY page, box) AS near FROM pairs)
SELECT page, box, max(near) AS near, max(box_b) FILTER (k = 1) AS pick, string_agg(box_b, ',' ORDER BY k) FILTER (k <= 3) AS candidates, coalesce(max(d2) FILTER (k = 2) - max(d2) FILTER (k = 1) < 64, FALSE) AS tie FROM r GROUP BY page, box""",
)
def label_groups(spark, sf_dir):
    """Of each box the three nearest candidates, the pick, and whether the second is as good."""
    near = _pairs(spark, sf_dir).select("page", "box", "box_b", "d2")
    ranked = near.withColumn("k", F.row_number().over(W.partitionBy("page", "box").orderBy("d2", "box_b"))).filter("k <= 3")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    three = F.concat_ws(",", *[at("box_b", k) for k in (1, 2, 3)])
    first = ranked.groupBy("page", "box").agg(at("box_b", 1).alias("pick"), three.alias("candidates"), F.coalesce(at("d2", 2) - at("d2", 1) < 64, F.lit(False)).alias("tie"))
    return near.groupBy("page", "box").agg(F.count(F.lit(1)).alias("near")).join(first, ["page", "box"]).select("page", "box", "near", "pick", "candidates", "tie")


@query(
    "association_compare",
    f"""WITH {_PAIRS}, nearest AS (SELECT page, box, box_b FROM pairs QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY d2, box_b) = 1),
along AS (SELECT page, box, box_b FROM pairs WHERE abs(cy - cy_b) <= 20 QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY abs(cx - cx_b), abs(cy - cy_b), box_b) = 1)
SELECT CASE WHEN b.box IS NULL THEN 'only_nearest' WHEN a.box_b = b.box_b THEN 'agree' ELSE 'differ' END AS outcome, count(*) AS n FROM nearest a LEFT JOIN along b ON a.page = b.page AND a.box = b.box GROUP BY 1""",
)
def association_compare(spark, sf_dir):
    """The nearest box against the nearest along its row: how often they agree."""
    pairs = _pairs(spark, sf_dir)
    gap = lambda c: F.abs(F.col(f"c{c}") - F.col(f"c{c}_b"))
    nearest = pairs.groupBy("page", "box").agg(F.min(F.struct("d2", "box_b")).alias("a"))
    along = pairs.filter(gap("y") <= 20).groupBy("page", "box").agg(F.min(F.struct(gap("x").alias("x"), gap("y").alias("y"), "box_b")).alias("b"))
    both = nearest.join(along, ["page", "box"], "left")
    outcome = F.when(F.col("b").isNull(), "only_nearest").when(F.col("a.box_b") == F.col("b.box_b"), "agree").otherwise("differ")
    return both.groupBy(outcome.alias("outcome")).agg(_n())


@query(
    "pattern_fragments",
    f"""WITH {PARTS_SQL}, s AS (SELECT DISTINCT label, regexp_extract(label, '^[A-Z]+') AS head, regexp_replace(regexp_replace(label, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS sig, length(regexp_extract(label, '[0-9]+')) AS n FROM catalog),
p AS (SELECT sig, n, count(*) AS support, count(DISTINCT head) AS heads, string_agg(DISTINCT head, '|' ORDER BY head) AS alternatives FROM s GROUP BY sig, n)
SELECT sig, n, support, CASE WHEN heads = 1 THEN alternatives WHEN heads <= 4 THEN '(?:' || alternatives || ')' ELSE '[A-Z]+' END AS first FROM p""",
)
def pattern_fragments(spark, sf_dir):
    """What stands for the letters of each shape of label: the letters, up to four alternatives, or any."""
    label = F.col("label")
    s = labelled_parts(spark, sf_dir).select("label").distinct().select(F.regexp_extract(label, "^[A-Z]+", 0).alias("head"), F.regexp_replace(F.regexp_replace(label, "[A-Za-z]+", "A"), "[0-9]+", "9").alias("sig"), F.length(F.regexp_extract(label, "[0-9]+", 0)).cast("long").alias("n"))
    heads = s.groupBy("sig", "n").agg(F.count(F.lit(1)).alias("support"), F.array_sort(F.collect_set("head")).alias("heads"))  # families
    joined = F.array_join("heads", "|")
    first = F.when(F.size("heads") == 1, joined).when(F.size("heads") <= 4, F.concat(F.lit("(?:"), joined, F.lit(")"))).otherwise("[A-Z]+")
    return heads.select("sig", "n", "support", first.alias("first"))


_STAGE = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query(
    "document_stages",
    f"""WITH e AS (SELECT user_id, event_id, ts, {_STAGE} AS stage FROM events), s AS (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e)
SELECT user_id, count(*) AS n, count(*) FILTER (before IS NOT NULL AND stage <> 4 AND stage > before + 1) AS illegal, CAST(arg_max(stage, (ts, event_id)) AS INTEGER) AS stage FROM s GROUP BY user_id""",
)
def document_stages(spark, sf_dir):
    """The last stage of each document, and how often a stage was skipped; failure may follow any."""
    rows = table(spark, sf_dir, "events").withColumn("stage", F.expr(_STAGE))
    before = F.lag("stage").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    skipped = (F.col("stage") != 4) & (F.col("stage") > F.col("before") + 1)
    return rows.withColumn("before", before).groupBy("user_id").agg(_n(), F.count(F.when(skipped, 1)).alias("illegal"), F.max_by("stage", F.struct("ts", "event_id")).alias("stage"))


@query(
    "box_distances",
    f"""WITH {_PAIRS} SELECT page, box, box_b, round(sqrt(power(greatest(0, greatest(x0, x0_b) - least(x1, x1_b)), 2) + power(greatest(0, greatest(y0, y0_b) - least(y1, y1_b)), 2)), 6) AS gap,
  round(sqrt(power(greatest(0, greatest(2 * x0_b - cx, cx - 2 * x1_b)), 2) + power(greatest(0, greatest(2 * y0_b - cy, cy - 2 * y1_b)), 2)) / 2, 6) AS from_centre FROM pairs WHERE box < box_b""",
)
def box_distances(spark, sf_dir):
    """The gap between two boxes, and from the centre of one to the other."""
    zero = F.lit(0).cast("long")
    gap = lambda c: F.greatest(zero, F.greatest(f"{c}0", f"{c}0_b") - F.least(f"{c}1", f"{c}1_b"))
    off = lambda c: F.greatest(zero, 2 * F.col(f"{c}0_b") - F.col(f"c{c}"), F.col(f"c{c}") - 2 * F.col(f"{c}1_b"))
    length = lambda a, b: F.sqrt((a * a + b * b).cast("double"))
    return _pairs(spark, sf_dir).filter(F.col("box") < F.col("box_b")).select("page", "box", "box_b", F.round(length(gap("x"), gap("y")), 6).alias("gap"), F.round(length(off("x"), off("y")) / 2, 6).alias("from_centre"))


@query(
    "orientation_bins",
    f"""WITH {_PAIRS}, a AS (SELECT round(degrees(atan2(cy_b - cy, cx_b - cx)), 6) AS d FROM pairs WHERE box < box_b), m AS (SELECT CASE WHEN d < 0 THEN d + 180 WHEN d >= 180 THEN d - 180 ELSE d END AS d FROM a)
SELECT CASE WHEN least(d, 180 - d) <= 10 THEN 'horizontal' WHEN abs(d - 90) <= 10 THEN 'vertical' ELSE 'sloped' END AS orientation, count(*) AS n FROM m GROUP BY 1""",
)
def orientation_bins(spark, sf_dir):
    """Angles between near boxes mod 180: horizontal or vertical within 10 degrees."""
    d = F.round(F.degrees(F.atan2((F.col("cy_b") - F.col("cy")).cast("double"), (F.col("cx_b") - F.col("cx")).cast("double"))), 6)
    m = _pairs(spark, sf_dir).filter(F.col("box") < F.col("box_b")).select(F.when(d < 0, d + 180).when(d >= 180, d - 180).otherwise(d).alias("d"))
    kind = F.when(F.least(F.col("d"), 180 - F.col("d")) <= 10, "horizontal").when(F.abs(F.col("d") - 90) <= 10, "vertical").otherwise("sloped")
    return m.groupBy(kind.alias("orientation")).agg(_n())


_SCALE = """CASE p_partkey % 5 WHEN 0 THEN 'SCALE: 1/' || (1 + depth % 8) || '" = 1' || chr(39) || '-0"' WHEN 1 THEN 'SCALE 1:' || (10 * (1 + weight)) WHEN 2 THEN 'NTS' WHEN 3 THEN (1 + depth % 3) || '" = ' || (1 + weight % 20) || chr(39) || '-6"' ELSE label END"""
_ARCH, _METRIC = "(?:([0-9]+)/)?([0-9]+)\" = ([0-9]+)'-([0-9]+)\"", "1:([0-9]+)"
_ARCH_SQL = _ARCH.replace("'", "''")


@query(
    "scale_radius",
    f"""WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_SCALE} AS raw FROM parts), x AS (SELECT p_partkey, raw, TRY_CAST(regexp_extract(raw, '{_ARCH_SQL}', 1) AS DOUBLE) AS over, TRY_CAST(regexp_extract(raw, '{_ARCH_SQL}', 2) AS DOUBLE) AS down,
  TRY_CAST(regexp_extract(raw, '{_ARCH_SQL}', 3) AS DOUBLE) AS feet, TRY_CAST(regexp_extract(raw, '{_ARCH_SQL}', 4) AS DOUBLE) AS inches, TRY_CAST(regexp_extract(raw, '{_METRIC}', 1) AS DOUBLE) AS ratio FROM s),
p AS (SELECT *, CASE WHEN feet IS NOT NULL THEN 72 * coalesce(over / down, down) / (12 * feet + inches) WHEN ratio > 0 THEN 72 / ratio END AS ppi FROM x)
SELECT p_partkey, raw, round(ppi, 6) AS points_per_inch, round(coalesce(least(280, greatest(48, 96 * ppi)), 160), 4) AS radius FROM p""",
)
def scale_radius(spark, sf_dir):
    """Points of paper for each real inch from the printed scale, and the search radius that follows: 96 inches, within 48 and 280 points, 160 by default."""
    raw = F.expr(_SCALE)
    rows = labelled_parts(spark, sf_dir).select("p_partkey", raw.alias("raw"))
    part = lambda pattern, k: F.nullif(F.regexp_extract("raw", pattern, k), F.lit("")).cast("double")
    over, down, feet, inches, ratio = *[part(_ARCH, k) for k in range(1, 5)], part(_METRIC, 1)
    ppi = F.when(feet.isNotNull(), 72 * F.coalesce(over / down, down) / (12 * feet + inches)).when(ratio > 0, 72 / ratio)
    return rows.select("p_partkey", "raw", ppi.alias("ppi")).select("p_partkey", "raw", F.round("ppi", 6).alias("points_per_inch"), F.round(F.coalesce(F.least(F.lit(280.0), F.greatest(F.lit(48.0), 96 * F.col("ppi"))), F.lit(160.0)), 4).alias("radius"))


_LENGTH = """CASE p_partkey % 4 WHEN 0 THEN depth || chr(39) || '-' || (weight % 12) || ' 1/2"' WHEN 1 THEN '-' || depth || chr(39) || '-' || (weight % 12) || '"' WHEN 2 THEN depth || '"' ELSE label END"""
_FEET = "^(-?)(?:([0-9]+)'-?)?(?:([0-9]+)(?: ([0-9]+)/([0-9]+))?\")?$"
_FEET_SQL = _FEET.replace("'", "''")


@query(
    "length_parse",
    f"""WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_LENGTH} AS raw FROM parts), x AS (SELECT p_partkey, raw, regexp_matches(raw, '{_FEET_SQL}') AS fits, regexp_extract(raw, '{_FEET_SQL}', 1) AS sign, TRY_CAST(regexp_extract(raw, '{_FEET_SQL}', 2) AS DOUBLE) AS ft,
  TRY_CAST(regexp_extract(raw, '{_FEET_SQL}', 3) AS DOUBLE) AS inch, TRY_CAST(regexp_extract(raw, '{_FEET_SQL}', 4) AS DOUBLE) AS a, TRY_CAST(regexp_extract(raw, '{_FEET_SQL}', 5) AS DOUBLE) AS b FROM s)
SELECT p_partkey, raw, CASE WHEN fits AND (ft IS NOT NULL OR inch IS NOT NULL) THEN CASE WHEN sign = '-' THEN -1 ELSE 1 END * (12 * coalesce(ft, 0) + coalesce(inch, 0) + coalesce(a / b, 0)) END AS inches,
  CASE WHEN fits AND ft IS NOT NULL THEN 'ft-in' WHEN fits AND inch IS NOT NULL THEN 'in' END AS unit FROM x""",
)
def length_parse(spark, sf_dir):
    """Signed feet and inches, with fractions; what does not fit whole is no length."""
    rows = labelled_parts(spark, sf_dir).select("p_partkey", F.expr(_LENGTH).alias("raw"))
    part = lambda k: F.nullif(F.regexp_extract("raw", _FEET, k), F.lit("")).cast("double")
    ft, inch, zero = part(2), part(3), F.lit(0.0)
    fits = F.col("raw").rlike(_FEET)
    sign = F.when(F.regexp_extract("raw", _FEET, 1) == "-", -1.0).otherwise(1.0)
    size = sign * (12 * F.coalesce(ft, zero) + F.coalesce(inch, zero) + F.coalesce(part(4) / part(5), zero))
    return rows.select("p_partkey", "raw", F.when(fits & (ft.isNotNull() | inch.isNotNull()), size).alias("inches"), F.when(fits & ft.isNotNull(), "ft-in").when(fits & inch.isNotNull(), "in").alias("unit"))


@query(
    "same_tag_edges",
    f"""WITH {PREDICTIONS_SQL}, t AS (SELECT page, section, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS node FROM predictions WHERE section IS NOT NULL),
h AS (SELECT *, min(node) OVER (PARTITION BY page, section) AS hub FROM t) SELECT page, section, hub, node FROM h WHERE node <> hub""",
)
def same_tag_edges(spark, sf_dir):
    """Rows of a page that share a label, as a star around the first: the same components as all pairs, in linear size."""
    node = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = predictions(spark, sf_dir).filter("section is not null").select("page", "section", node.alias("node"))
    hubs = rows.groupBy("page", "section").agg(F.min("node").alias("hub"))
    return rows.join(hubs, ["page", "section"]).filter("node <> hub").select("page", "section", "hub", "node")


@query(
    "member_routing",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT *, CASE WHEN source = 'CORRECTION' THEN 'AUTO' WHEN section IS NOT NULL AND source = 'FUSION' THEN 'AUTO' WHEN is_schedule THEN 'AUTO' WHEN source = 'GEOMETRY' AND confidence >= 0.5 THEN 'REVIEW_SECTION' WHEN source = 'GEOMETRY' THEN 'WEAK_GEOMETRY' ELSE 'REVIEW_SECTION' END AS route FROM predictions)
SELECT route, source, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM r GROUP BY 1, 2""",
)
def member_routing(spark, sf_dir):
    """Whether a member exists, and whether its section is known: the first rule that fits routes it."""
    c = F.col
    route = F.when(c("source") == "CORRECTION", "AUTO").when(c("section").isNotNull() & (c("source") == "FUSION"), "AUTO").when(c("is_schedule"), "AUTO").when((c("source") == "GEOMETRY") & (c("confidence") >= 0.5), "REVIEW_SECTION").when(c("source") == "GEOMETRY", "WEAK_GEOMETRY").otherwise("REVIEW_SECTION")
    return predictions(spark, sf_dir).groupBy(route.alias("route"), "source").agg(_n(), F.sum("quantity").alias("quantity"))


@query(
    "wrapped_lines",
    """WITH l AS (SELECT doc_id, CAST(i AS BIGINT) AS pos, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
s AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z0-9]') THEN 1 ELSE 0 END AS begins FROM l), k AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS item FROM s)
SELECT doc_id, item, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM k GROUP BY doc_id, item""",
)
def wrapped_lines(spark, sf_dir):
    """Lines that begin with neither capital nor digit go on with the line before."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("begins", F.col("line").rlike("^[A-Z0-9]").cast("int"))
    item = F.sum("begins").over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).cast("long")
    return lines.withColumn("item", item).groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))
