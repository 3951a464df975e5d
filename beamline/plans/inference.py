"""What is inferred with its evidence beside it: families, intervals, scales of drawings, and boosts by a document's own sections."""

from __future__ import annotations

from math import exp, factorial, log

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.labels import normalised
from ..operators import classify, fuzzy
from ..registry import query
from ..sources.tables import PREDICTIONS_SQL, catalog, labelled_parts, predictions
from .drawing import _CHAINS, _axes
from .layout import _boxes
from .learning import _JUDGED, _judged


@query("family_classifier")
def family_classifier(spark, sf_dir):
    """The likeliest family of every printed token, learned from four in five labels; all prints of a label are on one side of that split."""
    held = F.conv(F.substring(F.sha2("label", 256), 1, 4), 16, 10).cast("long") % 5 == 0
    rows = labelled_parts(spark, sf_dir).select("p_partkey", "printed", "family", held.alias("held_out"))
    model = classify.family_model(rows.filter("not held_out"), "printed", "family")
    found = classify.predicted(model, rows, "printed")
    return found.select("p_partkey", "printed", "family", "held_out", "predicted", F.round("probability", 4).alias("probability"))


@query("fuzzy_catalog")
def fuzzy_catalog(spark, sf_dir):
    """The ten nearest labels of the whole catalog by matching blocks, of a ratio of 0.55 at least."""
    printed = labelled_parts(spark, sf_dir).select("p_partkey", normalised(F.col("printed")).alias("norm"))
    best = fuzzy.ratio_search(printed, catalog(spark, sf_dir), most=10, least=0.55, bonus=0.0)
    return printed.join(best, "norm").select("p_partkey", "norm", "label", "ratio")


@query("similar_shapes")
def similar_shapes(spark, sf_dir):
    """The five most similar labels, of 0.45 at least, with a bonus where the first three letters are the same."""
    printed = labelled_parts(spark, sf_dir).select("p_partkey", normalised(F.col("printed")).alias("norm"))
    best = fuzzy.ratio_search(printed, catalog(spark, sf_dir), most=5, least=0.45, letters=True)
    return printed.join(best, "norm").select("p_partkey", "norm", "label", "ratio")


REPLICATES, DRAWS = 200, 9
#: Shares of Poisson(1) up to 0, 1, 2, ... draws.
_SHARES = [round(exp(-1) * sum(1 / factorial(i) for i in range(k + 1)), 12) for k in range(DRAWS)]


@query(
    "bootstrap_ci",
    f"""WITH {_JUDGED}, x AS (SELECT r, (predicted = actual)::INT - (other = actual)::INT AS d, CAST('0x' || substr(md5(doc_id || ':' || r), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM j, range({REPLICATES}) AS t(r)),
w AS (SELECT r, d, {" + ".join(f"(u >= {s}::DOUBLE)::INT" for s in _SHARES)} AS w FROM x), m AS (SELECT r, sum(w * d) / nullif(sum(w), 0)::DOUBLE AS m FROM w GROUP BY r)
SELECT count(*) AS replicates, round(avg(m), 6) AS mean_diff, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""",
)
def bootstrap_ci(spark, sf_dir):
    """A 95 % interval of how much more often one rule is right than another, by Poisson bootstrap.

    A document weighs in each replicate what a hash of both draws, so all replicates are sums of one aggregation.
    """
    right = lambda c: (F.col(c) == F.col("actual")).cast("int")
    rows = _judged(spark, sf_dir).select("doc_id", (right("predicted") - right("other")).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("r"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "r")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn = rows.withColumn("u", u).withColumn("w", sum(((F.col("u") >= s).cast("int") for s in _SHARES), F.lit(0)))
    means = drawn.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col("d")).cast("double"), F.sum("w")).alias("m"))
    return means.agg(F.count(F.lit(1)).alias("replicates"), F.round(F.avg("m"), 6).alias("mean_diff"), F.round(F.percentile("m", 0.025), 6).alias("lo"), F.round(F.percentile("m", 0.975), 6).alias("hi"))


#: The least gap of two grid lines, bays that must agree, how far they may differ, and the least printed length.
LEAST_GAP, LEAST_BAYS, AGREE, LEAST_INCHES = 20, 3, 0.01, 12
#: Two grid lines are neighbours, and a length printed between them stands for their distance; a box's sides make the length.
_BAYS = f"""{_CHAINS}, grid AS (SELECT page, orientation, axis, lead(axis) OVER (PARTITION BY page, orientation ORDER BY axis) AS next FROM (SELECT DISTINCT page, orientation, axis FROM axes WHERE pieces >= 2)),
printed_ AS (SELECT page, box, cx / 2.0::DOUBLE AS px, cy / 2.0::DOUBLE AS py, 2 * ((x1 - x0) + (y1 - y0)) AS inches FROM b),
bays AS (SELECT g.page, box, orientation, next - axis AS gap, inches, (next - axis) / inches::DOUBLE AS ratio FROM grid g JOIN printed_ p ON p.page = g.page AND axis < CASE orientation WHEN 'vertical' THEN px ELSE py END AND CASE orientation WHEN 'vertical' THEN px ELSE py END < next
  WHERE next - axis >= {LEAST_GAP} AND inches >= {LEAST_INCHES})"""


@query(
    "grid_calibration",
    f"""WITH {_BAYS}, votes AS (SELECT a.page, a.ratio, count(*) AS n FROM bays a JOIN bays o ON o.page = a.page AND abs(o.ratio - a.ratio) <= {AGREE}::DOUBLE * a.ratio + 1e-9::DOUBLE GROUP BY a.page, a.orientation, a.box, a.ratio),
best AS (SELECT page, ratio FROM votes QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, ratio) = 1),
s AS (SELECT y.page, count(*) AS bays, count(*) FILTER (abs(x.ratio - y.ratio) <= {AGREE}::DOUBLE * y.ratio + 1e-9::DOUBLE) AS agreeing, median(x.ratio) FILTER (abs(x.ratio - y.ratio) <= {AGREE}::DOUBLE * y.ratio + 1e-9::DOUBLE) AS mid FROM bays x JOIN best y ON x.page = y.page GROUP BY 1)
SELECT page, CASE WHEN agreeing >= {LEAST_BAYS} THEN round(mid, 5) END AS points_per_inch, agreeing, bays - agreeing AS disagreeing FROM s""",
)
def grid_calibration(spark, sf_dir):
    """Points for an inch of each page: the ratio of gap and printed length that most bays agree on within 1 %, with the bays it rests on.

    Lengths find the grid lines beside them in one ordered pass over a page's lines and lengths; bays count those
    around them by a window over the logarithm of their ratios.
    """
    lines = _axes(spark, sf_dir).filter("pieces >= 2").select("page", "orientation", F.col("axis").cast("double").alias("at"), F.lit(None).cast("string").alias("box"), F.lit(None).cast("long").alias("inches")).distinct()
    inches = 2 * (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0"))
    side = F.explode(F.array(F.struct(F.lit("vertical").alias("orientation"), (F.col("cx") / 2).alias("at")), F.struct(F.lit("horizontal").alias("orientation"), (F.col("cy") / 2).alias("at"))))
    lengths = _boxes(spark, sf_dir).select("page", side.alias("s"), "box", inches.alias("inches")).filter(F.col("inches") >= LEAST_INCHES).select("page", "s.orientation", "s.at", "box", "inches")
    line = F.when(F.col("box").isNull(), F.col("at"))
    along = W.partitionBy("page", "orientation").orderBy("at")
    # Rows at one place are peers of a range window; a length on a line has that line on both sides, and no gap.
    before, after = F.last(line, ignorenulls=True).over(along.rangeBetween(W.unboundedPreceding, 0)), F.first(line, ignorenulls=True).over(along.rangeBetween(0, W.unboundedFollowing))
    beside = lines.unionByName(lengths).withColumn("before", before).withColumn("after", after)
    bays = beside.filter("box is not null").withColumn("gap", F.col("after") - F.col("before")).filter(F.col("gap") >= LEAST_GAP).select("page", "box", "orientation", (F.col("gap") / F.col("inches")).alias("ratio"))
    # The window's edges are a little wider, so that ratios on them are in.
    near = f"PARTITION BY page ORDER BY log RANGE BETWEEN {1e-10 - log(1 - AGREE):.15f}D PRECEDING AND {1e-10 + log(1 + AGREE):.15f}D FOLLOWING"
    votes = bays.withColumn("log", F.log("ratio")).withColumn("n", F.expr(f"count(1) OVER ({near})"))
    best = votes.groupBy("page").agg(F.max(F.struct("n", (-F.col("ratio")).alias("r"))).alias("b")).select("page", (-F.col("b.r")).alias("best"))
    agrees = F.abs(F.col("ratio") - F.col("best")) <= AGREE * F.col("best") + 1e-9
    s = bays.join(best, "page").groupBy("page").agg(F.count(F.lit(1)).alias("bays"), F.count(F.when(agrees, 1)).alias("agreeing"), F.percentile(F.when(agrees, F.col("ratio")), 0.5).alias("mid"))
    return s.select("page", F.when(F.col("agreeing") >= LEAST_BAYS, F.round("mid", 5)).alias("points_per_inch"), "agreeing", (F.col("bays") - F.col("agreeing")).alias("disagreeing"))


#: What a section seen elsewhere in the document adds, what its family adds, and the most that a confidence becomes.
TYPICAL_BOOST, FAMILY_BOOST, MOST_CONFIDENT = 0.06, 0.03, 0.99
#: Other rows of the document that make a section typical, or a family allowed.
TYPICAL_ROWS, FAMILY_ROWS = 2, 5


@query(
    "document_prior",
    f"""WITH {PREDICTIONS_SQL}, s AS (SELECT page, section, count(*) - 1 AS others FROM predictions WHERE section IS NOT NULL GROUP BY ALL), f AS (SELECT page, family, count(*) - 1 AS others FROM predictions WHERE section IS NOT NULL GROUP BY ALL)
SELECT p.l_orderkey, p.l_partkey, p.l_suppkey, p.l_linenumber, coalesce(s.others, 0) AS section_rows, CASE WHEN p.section IS NULL THEN 0 ELSE f.others END AS family_rows,
  round(if(coalesce(s.others, 0) >= {TYPICAL_ROWS}, {TYPICAL_BOOST}::DOUBLE, 0) + if(p.section IS NOT NULL AND f.others >= {FAMILY_ROWS}, {FAMILY_BOOST}::DOUBLE, 0), 6) AS boost,
  round(greatest(p.confidence::DOUBLE, least({MOST_CONFIDENT}::DOUBLE, p.confidence::DOUBLE + if(coalesce(s.others, 0) >= {TYPICAL_ROWS}, {TYPICAL_BOOST}::DOUBLE, 0) + if(p.section IS NOT NULL AND f.others >= {FAMILY_ROWS}, {FAMILY_BOOST}::DOUBLE, 0))), 6) AS confidence
FROM predictions p LEFT JOIN s ON s.page = p.page AND s.section = p.section LEFT JOIN f ON f.page = p.page AND f.family = p.family""",
)
def document_prior(spark, sf_dir):
    """Confidence raised by what the rest of the document holds: a row never supports itself, and none is lowered."""
    rows = predictions(spark, sf_dir)
    whole = rows.filter("section is not null")
    s = whole.groupBy("page", "section").agg((F.count(F.lit(1)) - 1).alias("section_rows"))
    f = whole.groupBy("page", "family").agg((F.count(F.lit(1)) - 1).alias("f"))
    met = rows.join(s, ["page", "section"], "left").join(f, ["page", "family"], "left").withColumn("section_rows", F.coalesce("section_rows", F.lit(0))).withColumn("family_rows", F.when(F.col("section").isNull(), 0).otherwise(F.col("f")))
    boost = F.when(F.col("section_rows") >= TYPICAL_ROWS, TYPICAL_BOOST).otherwise(0.0) + F.when(F.col("family_rows") >= FAMILY_ROWS, FAMILY_BOOST).otherwise(0.0)
    given = F.col("confidence").cast("double")
    raised = F.greatest(given, F.least(F.lit(MOST_CONFIDENT), given + boost))
    return met.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "section_rows", "family_rows", F.round(boost, 6).alias("boost"), F.round(raised, 6).alias("confidence"))
