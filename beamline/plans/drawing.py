"""Regions, strokes, axes, levels and fits of drawings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import layout as g
from ..registry import query
from ..sources.scratch import written
from ..sources.tables import PREDICTIONS_SQL, predictions, table
from .layout import _BOXES, _PAIRS, _boxes, _each, _paged, _pairs


def _n():
    return F.count(F.lit(1)).alias("n")


_REGIONS = f"""{_BOXES}, regions AS (SELECT page, cx // 500 AS gx, cy // 500 AS gy, min(x0) AS rx0, min(y0) AS ry0, max(x1) AS rx1, max(y1) AS ry1 FROM b WHERE x1 - x0 >= 13 GROUP BY 1, 2, 3)"""


def _with_regions(spark, sf_dir):
    """Boxes with the regions of their page in order; a page has as many regions at most as its sheet has cells."""
    boxes = _boxes(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / 500)
    sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    regions = boxes.filter("x1 - x0 >= 13").groupBy("page", cell("cx").alias("gx"), cell("cy").alias("gy")).agg(*sides)
    lists = regions.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("gx", "gy", "x0", "y0", "x1", "y1"))).alias("regions"))
    return boxes.join(lists, "page", "left")


@query(
    "region_of_point",
    f"""WITH {_REGIONS}, c AS (SELECT b.page, b.box, gx, gy, 2 * rx0 <= cx AND cx <= 2 * rx1 AND 2 * ry0 <= cy AND cy <= 2 * ry1 AS hit, power(rx0 + rx1 - cx, 2) + power(ry0 + ry1 - cy, 2) AS d2 FROM b LEFT JOIN regions r ON r.page = b.page)
SELECT page, box, gx || ':' || gy AS region, coalesce(hit, FALSE) AS inside FROM c QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY hit DESC, CASE WHEN hit THEN 0 ELSE d2 END, gx, gy) = 1""",
)
def region_of_point(spark, sf_dir):
    """The first region that holds a box's centre, else the region of the nearest centre."""
    holds = lambda r: (2 * r["x0"] <= F.col("cx")) & (F.col("cx") <= 2 * r["x1"]) & (2 * r["y0"] <= F.col("cy")) & (F.col("cy") <= 2 * r["y1"])
    far = lambda r: F.pow(r["x0"] + r["x1"] - F.col("cx"), F.lit(2)) + F.pow(r["y0"] + r["y1"] - F.col("cy"), F.lit(2))
    held = F.filter("regions", holds)
    nearest = F.array_min(F.transform("regions", lambda r: F.struct(far(r).alias("d"), r["gx"].alias("gx"), r["gy"].alias("gy"))))
    rows = _with_regions(spark, sf_dir).withColumn("held", held).withColumn("nearest", nearest)
    inside = F.coalesce(F.size("held") > 0, F.lit(False)) & F.col("held").isNotNull()
    first = F.get("held", F.lit(0))
    name = lambda r: F.concat_ws(":", r["gx"], r["gy"])
    return rows.select("page", "box", F.when(inside, name(first)).when(F.col("nearest").isNotNull(), name(F.col("nearest"))).alias("region"), inside.alias("inside"))


_LIES = """CASE WHEN 2 * rx0 < cx AND cx < 2 * rx1 AND 2 * ry0 < cy AND cy < 2 * ry1 AND x0 >= rx0 AND y0 >= ry0 AND x1 <= rx1 AND y1 <= ry1 THEN 2 WHEN NOT (x1 <= rx0 OR x0 >= rx1 OR y1 <= ry0 OR y0 >= ry1) THEN 1 ELSE 0 END"""


@query(
    "region_quarantine",
    f"""WITH {_REGIONS}, c AS (SELECT b.page, b.box, coalesce(max(CASE WHEN rx0 IS NULL THEN 0 ELSE {_LIES} END), 0) AS k FROM b LEFT JOIN regions r ON r.page = b.page GROUP BY 1, 2) SELECT page, box, CASE k WHEN 2 THEN 'inside' WHEN 1 THEN 'boundary' ELSE 'outside' END AS relation FROM c""",
)
def region_quarantine(spark, sf_dir):
    """Boxes wholly in a region with their centre, across its edge, or outside of all; what straddles an edge is left to review."""

    def lies(r: Column) -> Column:
        centre = (2 * r["x0"] < F.col("cx")) & (F.col("cx") < 2 * r["x1"]) & (2 * r["y0"] < F.col("cy")) & (F.col("cy") < 2 * r["y1"])
        whole = (F.col("x0") >= r["x0"]) & (F.col("y0") >= r["y0"]) & (F.col("x1") <= r["x1"]) & (F.col("y1") <= r["y1"])
        apart = (F.col("x1") <= r["x0"]) | (F.col("x0") >= r["x1"]) | (F.col("y1") <= r["y0"]) | (F.col("y0") >= r["y1"])
        return F.when(centre & whole, 2).when(~apart, 1).otherwise(0)

    k = F.array_max(F.transform("regions", lies))
    return _with_regions(spark, sf_dir).select("page", "box", F.when(k == 2, "inside").when(k == 1, "boundary").otherwise("outside").alias("relation"))


#: What a short stroke, a thin one and a leader are, in points.
_STROKE = {
    "keep_score": "CASE WHEN greatest(w, h) < 6 THEN -1000000000 WHEN least(w, h) <= 6 OR least(w, h) * 100 <= 8 * greatest(w, h) THEN 1000000 + greatest(w, h) WHEN greatest(w, h) <= 160 THEN 10000 + greatest(w, h) ELSE greatest(w, h) - 5 * least(w, h) END",
    "significance": "greatest(w * h, 2 * (w + h))",
    "leader": "greatest(w, h) BETWEEN 8 AND 72 AND least(w, h) < 8",
}


@query("stroke_scores", f"WITH {_BOXES}, s AS (SELECT page, box, x1 - x0 AS w, y1 - y0 AS h FROM b) SELECT page, box, {', '.join(f'{v} AS {k}' for k, v in _STROKE.items())} FROM s")
def stroke_scores(spark, sf_dir):
    """What a crowded page keeps first, thin strokes before fills, and strokes that may be leaders."""
    s = _boxes(spark, sf_dir).select("page", "box", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    return s.select("page", "box", *[F.expr(v).alias(k) for k, v in _STROKE.items()])


DASH_GAP, AXIS_GAP = 48, 96
_CHAINS = f"""{_BOXES}, seg AS (SELECT page, box, CASE WHEN x1 - x0 >= y1 - y0 THEN 'horizontal' ELSE 'vertical' END AS orientation, CASE WHEN x1 - x0 >= y1 - y0 THEN cy // 2 ELSE cx // 2 END AS axis,
  CASE WHEN x1 - x0 >= y1 - y0 THEN x0 ELSE y0 END AS lo, CASE WHEN x1 - x0 >= y1 - y0 THEN x1 ELSE y1 END AS hi FROM b),
s1 AS (SELECT *, CASE WHEN axis - lag(axis) OVER (PARTITION BY page, orientation ORDER BY axis, box) > 3 THEN 1 ELSE 0 END AS brk FROM seg),
s2 AS (SELECT *, sum(brk) OVER (PARTITION BY page, orientation ORDER BY axis, box ROWS UNBOUNDED PRECEDING) AS cluster FROM s1),
s3 AS (SELECT *, max(hi) OVER (PARTITION BY page, orientation, cluster ORDER BY lo, hi, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s2),
s4 AS (SELECT *, sum(CASE WHEN lo > reach + {DASH_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY page, orientation, cluster ORDER BY lo, hi, box ROWS UNBOUNDED PRECEDING) AS run FROM s3),
mean AS (SELECT page, orientation, cluster, CAST(sum(axis) AS BIGINT) // count(*) AS axis FROM s4 GROUP BY 1, 2, 3),
chains AS (SELECT page, orientation, m.axis, min(lo) AS lo, max(hi) AS hi, CAST(sum(hi - lo) AS BIGINT) AS ink, count(*) AS pieces FROM s4 JOIN mean m USING (page, orientation, cluster) GROUP BY page, orientation, cluster, run, m.axis),
c1 AS (SELECT *, max(hi) OVER (PARTITION BY page, orientation, axis ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chains),
c2 AS (SELECT *, sum(CASE WHEN lo > reach + {AXIS_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY page, orientation, axis ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM c1),
axes AS (SELECT page, orientation, axis, min(lo) AS lo, max(hi) AS hi, CAST(sum(ink) AS BIGINT) AS ink, CAST(sum(pieces) AS BIGINT) AS pieces, count(*) AS runs FROM c2 GROUP BY page, orientation, axis, run)"""


def _strokes(boxes):
    """Boxes as strokes along their longer side; those of one place are alike to what joins them, so they need no name."""
    flat = (F.col("x1") - F.col("x0")) >= (F.col("y1") - F.col("y0"))
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    return boxes.select("page", flat.alias("flat"), F.floor(pick("cy", "cx") / 2).alias("axis"), pick("x0", "y0").alias("lo"), pick("x1", "y1").alias("hi"))


def _axes(spark, sf_dir):
    """Strokes along one line joined over gaps of a dash, and those chains over wider gaps.

    Strokes are joined where boxes are dealt by page; a crowded page's two directions are dealt to as many tasks as there are strokes for.
    """
    whole, *crowded = [_strokes(x) for x in _paged(spark, sf_dir)]
    n = table(spark, sf_dir, "lineitem").count()
    return _each([whole, *[g.dealt(x, n, "page", "flat") for x in crowded]], _chained)


def _chained(seg):
    by = ["page", "flat"]
    seg = g.islands(seg, by, [F.col("axis")], F.col("axis") - F.lag("axis").over(W.partitionBy(*by).orderBy("axis")) > 3).withColumnRenamed("island", "cluster")

    def runs(rows, by, order, gap):
        reach = F.max("hi").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
        return g.islands(rows.withColumn("reach", reach), by, [F.col(c) for c in order], F.col("lo") > F.col("reach") + gap)

    line = runs(seg, [*by, "cluster"], ["lo", "hi"], DASH_GAP)
    mean = F.floor(F.sum("axis").over(W.partitionBy(*by, "cluster")) / F.count(F.lit(1)).over(W.partitionBy(*by, "cluster")))
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    chains = line.withColumn("mean", mean).groupBy(*by, "cluster", "island", "mean").agg(*ends, F.sum(F.col("hi") - F.col("lo")).alias("ink"), F.count(F.lit(1)).alias("pieces"))
    chains = chains.select(*by, F.col("mean").alias("axis"), "lo", "hi", "ink", "pieces")
    linked = runs(chains, [*by, "axis"], ["lo", "hi"], AXIS_GAP)
    axes = linked.groupBy(*by, "axis", "island").agg(*ends, F.sum("ink").alias("ink"), F.sum("pieces").alias("pieces"), F.count(F.lit(1)).alias("runs"))
    return axes.select("page", F.when(F.col("flat"), "horizontal").otherwise("vertical").alias("orientation"), "axis", "lo", "hi", "ink", "pieces", "runs")


@query("collinear_axes", f"WITH {_CHAINS} SELECT * FROM axes")
def collinear_axes(spark, sf_dir):
    """Axes of a page: dashes chained over gaps of 48, chains linked over gaps of 96, with ink, pieces and runs."""
    return _axes(spark, sf_dir)


_CROSSINGS = f"""{_CHAINS}, long AS (SELECT * FROM axes WHERE pieces >= 2), crossings AS (SELECT DISTINCT v.page, v.axis AS px, h.axis AS py FROM long v JOIN long h ON h.page = v.page AND v.orientation = 'vertical' AND h.orientation = 'horizontal'
  WHERE v.axis BETWEEN h.lo - 20 AND h.hi + 20 AND h.axis BETWEEN v.lo - 20 AND v.hi + 20)"""
_SPACING = """gaps AS (SELECT page, px - lag(px) OVER (PARTITION BY page ORDER BY px) AS gap FROM (SELECT DISTINCT page, px FROM crossings) UNION ALL SELECT page, py - lag(py) OVER (PARTITION BY page ORDER BY py) FROM (SELECT DISTINCT page, py FROM crossings)),
spacing AS (SELECT page, coalesce(median(gap), 120.0) AS spacing FROM gaps GROUP BY page)"""


def _crossings(spark, sf_dir):
    """Where axes of both directions meet, 20 points of overhang allowed; they find each other by cells of 250."""
    long_ = _axes(spark, sf_dir).filter("pieces >= 2").select("page", "orientation", "axis", "lo", "hi")
    cells = F.explode(F.sequence(F.floor((F.col("lo") - 20) / 250), F.floor((F.col("hi") + 20) / 250)))
    h = long_.filter("orientation = 'horizontal'").select("page", F.col("axis").alias("py"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi"), cells.alias("cell"))
    v = long_.filter("orientation = 'vertical'").select("page", F.col("axis").alias("px"), F.col("lo").alias("vlo"), F.col("hi").alias("vhi"), F.floor(F.col("axis") / 250).alias("cell"))
    met = v.join(h, ["page", "cell"]).filter("px between hlo - 20 and hhi + 20 and py between vlo - 20 and vhi + 20")
    return met.select("page", "px", "py").distinct()


@query("grid_intersections", f"WITH {_CROSSINGS}, {_SPACING} SELECT page, px, py, spacing FROM crossings JOIN spacing USING (page)")
def grid_intersections(spark, sf_dir):
    """Crossings of axes, with the median gap between neighbouring ones of the page."""
    crossings = _crossings(spark, sf_dir)
    return crossings.join(_spacing(crossings), "page").select("page", "px", "py", "spacing")


def _spacing(crossings):
    gap = lambda c: crossings.select("page", c).distinct().select("page", (F.col(c) - F.lag(c).over(W.partitionBy("page").orderBy(c))).alias("gap"))
    return gap("px").union(gap("py")).groupBy("page").agg(F.coalesce(F.percentile("gap", 0.5), F.lit(120.0)).alias("spacing"))


_ALLOCATED = """CASE WHEN best IS NULL OR best > 0.55::DOUBLE * spacing THEN 'unresolved' WHEN second - best < 0.25::DOUBLE * spacing AND second < best * 1.35::DOUBLE THEN 'review_required' WHEN best <= 0.22::DOUBLE * spacing THEN 'confirmed' ELSE 'candidate' END"""


@query(
    "mark_allocation",
    f"""WITH {_CROSSINGS}, {_SPACING}, m AS (SELECT page, box, cx, cy FROM b WHERE x1 - x0 >= 13), d AS (SELECT m.page, box, spacing, px, py, sqrt(power(cx - 2 * px, 2) + power(cy - 2 * py, 2)) / 2 AS d FROM m LEFT JOIN spacing s ON s.page = m.page LEFT JOIN crossings c ON c.page = m.page),
r AS (SELECT *, d AS best, lead(d) OVER w AS second, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY page, box ORDER BY d, px, py)), a AS (SELECT *, {_ALLOCATED} AS status FROM r WHERE k = 1)
SELECT page, box, CASE WHEN status <> 'unresolved' THEN px || '/' || py END AS location, status FROM a""",
)
def mark_allocation(spark, sf_dir):
    """Marks on the nearest crossing of their page: none beyond 0.55 of the spacing, a review where two are similarly close.

    What lies beyond 0.8 of the spacing decides nothing, so that is the cell in which marks and crossings meet.
    """
    crossings = _crossings(spark, sf_dir)
    spacing = _spacing(crossings)
    cell = lambda x: F.floor(x / (0.8 * F.col("spacing") + 1))
    marks = _boxes(spark, sf_dir).filter("x1 - x0 >= 13").join(spacing, "page", "left").select("page", "box", "cx", "cy", "spacing", cell(F.col("cx") / 2).alias("gx"), cell(F.col("cy") / 2).alias("gy"))
    at = crossings.join(spacing, "page").select("page", "px", "py", cell(F.col("px")).alias("gx"), cell(F.col("py")).alias("gy"))
    around = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = at.select("page", "px", "py", around.alias("g")).select("page", "px", "py", "g.*")
    d = F.sqrt(F.pow(F.col("cx") - 2 * F.col("px"), F.lit(2)) + F.pow(F.col("cy") - 2 * F.col("py"), F.lit(2))) / 2
    w = W.partitionBy("page", "box").orderBy(F.col("best").asc_nulls_last(), "px", "py")
    ranked = marks.join(near, ["page", "gx", "gy"], "left").withColumn("best", d).withColumn("second", F.lead("best").over(w)).withColumn("k", F.row_number().over(w)).filter("k = 1")
    judged = ranked.withColumn("status", F.expr(_ALLOCATED.replace("::DOUBLE", "D")))
    return judged.select("page", "box", F.when(F.col("status") != "unresolved", F.concat_ws("/", "px", "py")).alias("location"), "status")


_LEVELS = f"""{_BOXES}, lines AS (SELECT page, y0 AS y FROM b WHERE y1 - y0 >= 12 GROUP BY 1, 2), u AS (SELECT page, y, '' AS box, y AS line FROM lines UNION ALL SELECT page, y1, box, NULL FROM b WHERE y1 - y0 < 12)"""
_POSITION = "CASE WHEN at_line IS NOT NULL THEN 'at' WHEN upper IS NOT NULL AND lower IS NOT NULL THEN 'between' WHEN lower IS NOT NULL THEN 'above' WHEN upper IS NOT NULL THEN 'below' ELSE 'unknown' END"
_NEAR = f"CASE WHEN {_POSITION} <> 'between' THEN NULL WHEN y - upper <= 8 THEN 'upper' WHEN lower - y <= 8 THEN 'lower' END"


@query(
    "level_bands",
    f"""WITH {_LEVELS}, p AS (SELECT page, box, y, line, min(line) OVER (PARTITION BY page ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS at_line, max(line) OVER (PARTITION BY page ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upper,
  min(line) OVER (PARTITION BY page ORDER BY y RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lower FROM u)
SELECT page, box, y, {_POSITION} AS position, coalesce(at_line, upper) AS line, {_NEAR} AS near FROM p WHERE line IS NULL""",
)
def level_bands(spark, sf_dir):
    """Ends on a level line, between two, or beyond all; never moved to the nearest. Lines and ends are one ordered window, no join."""
    boxes = _boxes(spark, sf_dir)
    none = F.lit(None).cast("long")
    lines = boxes.filter("y1 - y0 >= 12").select("page", F.col("y0").alias("y")).distinct().select("page", "y", F.lit("").alias("box"), F.col("y").alias("line"))
    both = lines.unionByName(boxes.filter("y1 - y0 < 12").select("page", F.col("y1").alias("y"), "box", none.alias("line")))
    w = W.partitionBy("page").orderBy("y")
    over = both.withColumn("at_line", F.min("line").over(w.rangeBetween(-3, 3))).withColumn("upper", F.max("line").over(w.rangeBetween(W.unboundedPreceding, -1))).withColumn("lower", F.min("line").over(w.rangeBetween(1, W.unboundedFollowing)))
    return over.filter("line is null").select("page", "box", "y", F.expr(_POSITION).alias("position"), F.coalesce("at_line", "upper").alias("line"), F.expr(_NEAR).alias("near"))


@query(
    "similarity_fit",
    f"""WITH {_BOXES}, p AS (SELECT page, cx / 2.0::DOUBLE AS x, cy / 2.0::DOUBLE AS y, 0.5::DOUBLE * (x0 - y0) + (x1 - x0) AS u, 0.5::DOUBLE * (x0 + y0) + (y1 - y0) AS v FROM b),
m AS (SELECT page, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY page),
s AS (SELECT page, n, mx, my, mu, mv, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS b, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS q FROM p JOIN m USING (page) GROUP BY ALL HAVING n >= 3 AND q > 1e-9),
r AS (SELECT page, n, sqrt(a * a + b * b) / q AS scale, degrees(atan2(b, a)) AS rotation, sqrt(power(a / q * (x - mx) - b / q * (y - my) + mu - u, 2) + power(b / q * (x - mx) + a / q * (y - my) + mv - v, 2)) AS res FROM p JOIN s USING (page))
SELECT page, n, round(scale, 6) AS scale, round(rotation, 6) AS rotation, round(avg(res), 6) AS residual_mean, round(max(res), 6) AS residual_max, quantile_disc(res, 0.95) <= 5 AS valid FROM r GROUP BY page, n, scale, rotation""",
)
def similarity_fit(spark, sf_dir):
    """Rotation and one scale by least squares from points of a page to their targets, valid while 95 % of the residuals are within 5 points.

    With the centres taken off, a = sum(p . t) and b = sum(p x t) give the angle atan2(b, a) and the scale |(a, b)| / sum(p . p).
    """
    c = F.col
    p = _boxes(spark, sf_dir).select("page", (c("cx") / 2.0).alias("x"), (c("cy") / 2.0).alias("y"), (0.5 * (c("x0") - c("y0")) + (c("x1") - c("x0"))).alias("u"), (0.5 * (c("x0") + c("y0")) + (c("y1") - c("y0"))).alias("v"))
    m = p.groupBy("page").agg(_n(), *[F.avg(k).alias(f"m{k}") for k in "xyuv"])
    x, y, u, v = [c(k) - c(f"m{k}") for k in "xyuv"]
    centred = p.join(m, "page").select("page", "n", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
    s = centred.groupBy("page", "n").agg(F.sum(c("x") * c("u") + c("y") * c("v")).alias("a"), F.sum(c("x") * c("v") - c("y") * c("u")).alias("b"), F.sum(c("x") * c("x") + c("y") * c("y")).alias("q")).filter("n >= 3 and q > 1e-9")
    ax, bx = c("a") / c("q"), c("b") / c("q")
    res = F.sqrt(F.pow(ax * c("x") - bx * c("y") - c("u"), F.lit(2)) + F.pow(bx * c("x") + ax * c("y") - c("v"), F.lit(2)))
    r = centred.drop("n").join(s, "page").select("page", "n", (F.sqrt(c("a") * c("a") + c("b") * c("b")) / c("q")).alias("scale"), F.degrees(F.atan2("b", "a")).alias("rotation"), res.alias("res"))
    out = r.groupBy("page", "n", "scale", "rotation").agg(F.avg("res").alias("mean"), F.max("res").alias("most"), F.expr("percentile_disc(0.95) within group (order by res)").alias("p95"))
    return out.select("page", "n", F.round("scale", 6).alias("scale"), F.round("rotation", 6).alias("rotation"), F.round("mean", 6).alias("residual_mean"), F.round("most", 6).alias("residual_max"), (c("p95") <= 5).alias("valid"))


@query(
    "distance_norms",
    f"""WITH {_PAIRS}, d AS (SELECT page, greatest(max(x1) - min(x0), 1) AS w, greatest(max(y1) - min(y0), 1) AS h FROM b GROUP BY page)
SELECT page, box, box_b, round(sqrt(d2) / 2 / sqrt(w * w + h * h), 6) AS by_page, round(sqrt(d2) / 2 / (y1 - y0), 4) AS by_text, CASE WHEN page % 5 <> 0 THEN round(sqrt(d2) / 2 * (page % 5), 4) END AS by_scale, page % 5 <> 0 AS scaled FROM pairs JOIN d USING (page) WHERE box < box_b""",
)
def distance_norms(spark, sf_dir):
    """Distances over the page's diagonal, the height of the text, and the scale where the page has one; no scale is null, not 0."""
    size = lambda a, b: F.greatest(F.max(b) - F.min(a), F.lit(1))
    d = _boxes(spark, sf_dir).groupBy("page").agg(size("x0", "x1").alias("w"), size("y0", "y1").alias("h"))
    raw, scale = F.sqrt("d2") / 2, F.col("page") % 5
    near = _pairs(spark, sf_dir).filter("box < box_b").join(d, "page")
    by_page = F.round(raw / F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")), 6)
    return near.select("page", "box", "box_b", by_page.alias("by_page"), F.round(raw / (F.col("y1") - F.col("y0")), 4).alias("by_text"), F.when(scale != 0, F.round(raw * scale, 4)).alias("by_scale"), (scale != 0).alias("scaled"))


#: Points across a cell in which tips meet ends.
TIP_CELL = 64


@query(
    "leader_ends",
    f"""WITH {_BOXES}, e AS (SELECT page, box, x0 AS ex, y0 AS ey, x1 AS ox, y1 AS oy FROM b UNION ALL SELECT page, box, x1, y1, x0, y0 FROM b), h1 AS (SELECT b.page, b.box, b.box AS via, e.box AS seg, e.ox, e.oy FROM b JOIN e ON e.page = b.page AND e.box <> b.box AND abs(e.ex - b.x1) <= 1 AND abs(e.ey - b.y1) <= 1),
h2 AS (SELECT h.page, h.box, h.seg AS via, e.box AS seg, e.ox, e.oy FROM h1 h JOIN e ON e.page = h.page AND e.box <> h.seg AND e.box <> h.box AND abs(e.ex - h.ox) <= 1 AND abs(e.ey - h.oy) <= 1)
SELECT DISTINCT page, box, hop, seg, ox, oy FROM (SELECT page, box, 1 AS hop, seg, ox, oy FROM h1 UNION ALL SELECT page, box, 2, seg, ox, oy FROM h2)""",
)
def leader_ends(spark, sf_dir):
    """Where a stroke leads: its end is followed through up to two strokes that begin or end within a point of it."""
    b = _boxes(spark, sf_dir)
    ends = b.select("page", F.col("box").alias("seg"), F.explode(F.array(*[F.struct(F.col(f"x{i}").alias("ex"), F.col(f"y{i}").alias("ey"), F.col(f"x{1 - i}").alias("ox"), F.col(f"y{1 - i}").alias("oy")) for i in (0, 1)])).alias("e")).select("page", "seg", "e.*")
    # Ends are filed under the cells within a point of them, mostly one; a tip looks in its own.
    filed = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / TIP_CELL), F.floor((F.col(c) + 1) / TIP_CELL)))
    ends = ends.withColumn("gx", filed("ex")).withColumn("gy", filed("ey"))

    def follow(front, hop):
        tips = front.withColumn("gx", F.floor(F.col("fx") / TIP_CELL)).withColumn("gy", F.floor(F.col("fy") / TIP_CELL))
        met = tips.join(ends, ["page", "gx", "gy"]).filter("abs(ex - fx) <= 1 and abs(ey - fy) <= 1 and seg <> via and seg <> box")
        return met.select("page", "box", F.lit(hop).alias("hop"), "seg", "ox", "oy")

    one = written(follow(b.select("page", "box", F.col("box").alias("via"), F.col("x1").alias("fx"), F.col("y1").alias("fy")), 1), "first-hops")
    two = follow(one.select("page", "box", F.col("seg").alias("via"), F.col("ox").alias("fx"), F.col("oy").alias("fy")), 2)
    return one.unionByName(two).distinct()


_HEADS = ("mark", "size", "plate", "anchor", "remarks")


@query(
    "header_columns",
    f"""WITH {_BOXES}, k AS (SELECT page, y0, greatest(0, least(4, (x0 + 4 - page % 50 - 20) // 180)) AS k, x0 + 4 - page % 50 - 20 < 0 AS before FROM b)
SELECT page, ['mark', 'size', 'plate', 'anchor', 'remarks'][CASE WHEN before THEN 1 ELSE k + 1 END] AS field, count(*) AS n, count(DISTINCT y0) AS lines FROM k GROUP BY 1, 2""",
)
def header_columns(spark, sf_dir):
    """Words under the headings of a page's table: the last heading that begins no more than 4 points after the word, else the first."""
    origin = lambda i: F.col("page") % 50 + 20 + 180 * i
    bands = F.array(*[F.struct(origin(i).alias("x"), F.lit(n).alias("name")) for i, n in enumerate(_HEADS)])
    begun = F.filter(bands, lambda band: band["x"] <= F.col("x0") + 4)
    name = F.coalesce(F.array_max(begun)["name"], F.array_min(bands)["name"])
    per_line = _boxes(spark, sf_dir).groupBy("page", name.alias("field"), "y0").agg(_n())
    return per_line.groupBy("page", "field").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lines"))


@query(
    "plate_count_checks",
    f"""WITH {PREDICTIONS_SQL}, listed AS (SELECT page, l_partkey % 40 AS mark, count(*) AS listed FROM predictions WHERE NOT is_schedule AND section IS NOT NULL GROUP BY 1, 2), t AS (SELECT page, l_partkey % 40 AS mark, l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 5 THEN quantity // 11 END AS scheduled FROM predictions WHERE is_schedule)
SELECT t.page, t.mark, l_orderkey, l_linenumber, scheduled, coalesce(listed, 0) AS listed, CASE WHEN scheduled IS NULL THEN 'no_quantity_printed' WHEN scheduled = coalesce(listed, 0) THEN 'match' ELSE 'mismatch' END AS status FROM t LEFT JOIN listed l ON l.page = t.page AND l.mark = t.mark""",
)
def plate_count_checks(spark, sf_dir):
    """The quantity that a schedule prints for a mark against the places that name it; a warning only."""
    rows = predictions(spark, sf_dir).withColumn("mark", F.col("l_partkey") % 40)
    listed = rows.filter("not is_schedule and section is not null").groupBy("page", "mark").agg(F.count(F.lit(1)).alias("k"))
    scheduled = F.when(F.col("l_linenumber") != 5, F.floor(F.col("quantity") / 11))
    t = rows.filter("is_schedule").select("page", "mark", "l_orderkey", "l_linenumber", scheduled.alias("scheduled")).join(listed, ["page", "mark"], "left").withColumn("listed", F.coalesce("k", F.lit(0)))
    status = F.when(F.col("scheduled").isNull(), "no_quantity_printed").when(F.col("scheduled") == F.col("listed"), "match").otherwise("mismatch")
    return t.select("page", "mark", "l_orderkey", "l_linenumber", "scheduled", "listed", status.alias("status"))


@query(
    "identity_match",
    f"""WITH {_BOXES}, nodes AS (SELECT page, box, x0, y0, split_part(box, '-', 2) AS text FROM b WHERE x1 - x0 >= 8), t AS (SELECT page, box, x0, y0, split_part(box, '-', 2) AS text, CASE WHEN y1 - y0 <> 7 THEN box END AS id FROM b),
k AS (SELECT page, x0, y0, min(box) AS box FROM nodes GROUP BY ALL), w AS (SELECT page, text, min(box) AS box FROM nodes GROUP BY ALL)
SELECT t.page, t.box, coalesce(n.box, k.box, w.box) AS node, CASE WHEN n.box IS NOT NULL THEN 'id' WHEN k.box IS NOT NULL THEN 'place' WHEN w.box IS NOT NULL THEN 'text' ELSE 'none' END AS matched_by
  FROM t LEFT JOIN nodes n ON n.page = t.page AND n.box = t.id LEFT JOIN k ON k.page = t.page AND k.x0 = t.x0 AND k.y0 = t.y0 LEFT JOIN w ON w.page = t.page AND w.text = t.text""",
)
def identity_match(spark, sf_dir):
    """The node of a token by its id, else by its place, else by its text on the page."""
    b = _boxes(spark, sf_dir).withColumn("text", F.split("box", "-")[1])
    nodes = b.filter("x1 - x0 >= 8")
    t = b.select("page", "box", "x0", "y0", "text", F.when(F.col("y1") - F.col("y0") != 7, F.col("box")).alias("id"))
    by_id = nodes.select("page", F.col("box").alias("id"), F.col("box").alias("n_id"))
    by_place, by_text = nodes.groupBy("page", "x0", "y0").agg(F.min("box").alias("n_place")), nodes.groupBy("page", "text").agg(F.min("box").alias("n_text"))
    found = t.join(by_id, ["page", "id"], "left").join(by_place, ["page", "x0", "y0"], "left").join(by_text, ["page", "text"], "left")
    how = F.when(F.col("n_id").isNotNull(), "id").when(F.col("n_place").isNotNull(), "place").when(F.col("n_text").isNotNull(), "text").otherwise("none")
    return found.select("page", "box", F.coalesce("n_id", "n_place", "n_text").alias("node"), how.alias("matched_by"))


@query(
    "extraction_faults",
    f"""WITH {_PAIRS}, f AS (SELECT page, 'repeated_text' AS fault, count(*) AS n FROM (SELECT page, split_part(box, '-', 2) AS text FROM b GROUP BY ALL HAVING count(*) > 1) GROUP BY page
UNION ALL SELECT page, 'overlap', count(*) FROM pairs WHERE box < box_b AND x0 < x1_b AND x0_b < x1 AND y0 < y1_b AND y0_b < y1 GROUP BY page UNION ALL SELECT page, 'degenerate', count(*) FROM b WHERE least(x1 - x0, y1 - y0) <= 5 GROUP BY page
UNION ALL SELECT page, 'disconnected', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.page = b.page AND p.box = b.box) GROUP BY page) SELECT * FROM f""",
)
def extraction_faults(spark, sf_dir):
    """Of each page the texts that repeat, boxes that overlap, degenerate boxes, and boxes without a neighbour."""
    b, p = _boxes(spark, sf_dir), _pairs(spark, sf_dir)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    thin, meet = F.expr("least(x1 - x0, y1 - y0) <= 5"), F.expr("box < box_b and x0 < x1_b and x0_b < x1 and y0 < y1_b and y0_b < y1")
    repeated = b.groupBy("page", F.split("box", "-")[1].alias("text")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").groupBy("page").agg(_n()).select("page", F.lit("repeated_text").alias("fault"), "n")
    # Pairs are made once: a box that has any is taken off the boxes that have none.
    near = p.groupBy("page", "box").agg(F.count(F.when(meet, 1)).alias("overlap"))
    counts = b.select("page", none.alias("overlap"), F.when(thin, one).otherwise(none).alias("degenerate"), one.alias("disconnected")).unionByName(near.select("page", "overlap", none.alias("degenerate"), (-one).alias("disconnected")))
    names = ["overlap", "degenerate", "disconnected"]
    other = counts.groupBy("page").agg(*[F.sum(c).alias(c) for c in names]).unpivot(["page"], names, "fault", "n").filter("n > 0")
    return repeated.unionByName(other)


@query(
    "property_graph",
    f"""WITH {_PAIRS}, sizes AS (SELECT page, split_part(box, '-', 2) AS text, count(*) AS k FROM b GROUP BY ALL), r AS (SELECT page, 'node' AS record, CASE WHEN x1 - x0 >= 10 THEN 'text' ELSE 'geometry' END AS kind FROM b
UNION ALL SELECT page, 'edge', CASE WHEN x0 <= x1_b AND x0_b <= x1 AND y0 <= y1_b AND y0_b <= y1 THEN 'touches' WHEN abs(cy - cy_b) <= 6 THEN 'row' WHEN abs(cx - cx_b) <= 6 THEN 'column' ELSE 'near' END FROM pairs WHERE box < box_b)
SELECT page, record, kind, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT page, 'edge', 'same_text', CAST(sum(k - 1) AS BIGINT) FROM sizes WHERE k > 1 GROUP BY page""",
)
def property_graph(spark, sf_dir):
    """Nodes and edges of each page by kind; boxes of one text hang on the first of them, one edge each."""
    b, p = _boxes(spark, sf_dir), _pairs(spark, sf_dir).filter("box < box_b")
    c = F.col
    touches = (c("x0") <= c("x1_b")) & (c("x0_b") <= c("x1")) & (c("y0") <= c("y1_b")) & (c("y0_b") <= c("y1"))
    edge = F.when(touches, "touches").when(F.abs(c("cy") - c("cy_b")) <= 6, "row").when(F.abs(c("cx") - c("cx_b")) <= 6, "column").otherwise("near")
    nodes = b.select("page", F.lit("node").alias("record"), F.when(c("x1") - c("x0") >= 10, "text").otherwise("geometry").alias("kind"))
    counted = nodes.unionByName(p.select("page", F.lit("edge").alias("record"), edge.alias("kind"))).groupBy("page", "record", "kind").agg(_n())
    texts = b.groupBy("page", F.split("box", "-")[1].alias("text")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").groupBy("page").agg(F.sum(c("k") - 1).alias("n"))
    return counted.unionByName(texts.select("page", F.lit("edge").alias("record"), F.lit("same_text").alias("kind"), "n"))
