"""What a sheet's lines say: members that labels name, and tables between rulings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as a
from ..operators import layout as g
from ..operators import tables as t
from ..registry import query
from ..sources.scratch import written
from ..sources.tables import PARTS_SQL, labelled_parts, table
from .drawing import _CHAINS, _axes
from .layout import _BOXES, _boxes, _each, _paged

#: Boxes are labels, members along their longer side, or leaders from corner to corner, by their part.
_KINDS = f"""{_BOXES}, k AS (SELECT *, CAST(split_part(box, '-', 2) AS BIGINT) % 3 AS kind, cx / 2.0::DOUBLE AS px, cy / 2.0::DOUBLE AS py FROM b),
labels_ AS (SELECT page, box AS label, px, py FROM k WHERE kind = 0), leaders AS (SELECT page, box AS leader, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM k WHERE kind = 2),
members AS (SELECT page, box AS member, greatest(x1 - x0, y1 - y0) AS length, if(x1 - x0 >= y1 - y0, x0::DOUBLE, px) AS x0, if(x1 - x0 >= y1 - y0, py, y0::DOUBLE) AS y0, if(x1 - x0 >= y1 - y0, x1::DOUBLE, px) AS x1, if(x1 - x0 >= y1 - y0, py, y1::DOUBLE) AS y1 FROM k WHERE kind = 1)"""


def _far_sql(p: str, s: str) -> str:
    t_ = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({p}.px - {s}.x0) * ({s}.x1 - {s}.x0) + ({p}.py - {s}.y0) * ({s}.y1 - {s}.y0)) / (({s}.x1 - {s}.x0) * ({s}.x1 - {s}.x0) + ({s}.y1 - {s}.y0) * ({s}.y1 - {s}.y0))))"
    off = lambda c: f"({p}.p{c} - ({s}.{c}0 + {t_} * ({s}.{c}1 - {s}.{c}0)))"
    return f"sqrt({off('x')} * {off('x')} + {off('y')} * {off('y')})"


def _sheet(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("kind", F.split_part("box", F.lit("-"), F.lit(2)).cast("long") % 3).withColumn("px", F.col("cx") / 2).withColumn("py", F.col("cy") / 2)
    side = {c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}
    flat = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
    along = {c: F.when(flat, side[c] if c[0] == "x" else F.col("py")).otherwise(F.col("px") if c[0] == "x" else side[c]).alias(c) for c in side}
    labels = rows.filter("kind = 0").select("page", F.col("box").alias("label"), "px", "py")
    members = rows.filter("kind = 1").select("page", F.col("box").alias("member"), F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("length"), *along.values())
    leaders = rows.filter("kind = 2").select("page", F.col("box").alias("leader"), *[c.alias(n) for n, c in side.items()])
    return labels, members, leaders


@query(
    "member_candidates",
    f"""WITH {_KINDS}, ld AS (SELECT l.page, label, leader, {_far_sql('l', 's')} AS d FROM labels_ l JOIN leaders s ON s.page = l.page),
ol AS (SELECT page, label, leader FROM ld WHERE d <= {a.REACH} QUALIFY row_number() OVER (PARTITION BY page, label ORDER BY d, leader) = 1),
e AS (SELECT page, label, x0 AS px, y0 AS py FROM ol JOIN leaders USING (page, leader) UNION ALL SELECT page, label, x1, y1 FROM ol JOIN leaders USING (page, leader)),
tip AS (SELECT e.page, label, member, length, min({_far_sql('e', 's')}) AS d FROM e JOIN members s ON s.page = e.page WHERE {_far_sql('e', 's')} <= {a.TIP_REACH} GROUP BY ALL),
own AS (SELECT l.page, label, member, length, {_far_sql('l', 's')} AS d FROM labels_ l JOIN members s ON s.page = l.page WHERE {_far_sql('l', 's')} <= {a.REACH} AND NOT EXISTS (FROM tip WHERE tip.page = l.page AND tip.label = l.label)),
c AS (SELECT *, 'leader_tip_to_stroke' AS method FROM tip UNION ALL SELECT *, 'proximity_stroke' FROM own), r AS (SELECT *, row_number() OVER w AS nth, lead(d) OVER w AS second FROM c WINDOW w AS (PARTITION BY page, label ORDER BY d, length DESC, member))
SELECT l.page, l.label, method, if(second - d <= {a.MARGIN}, NULL, member) AS member, round(d, 3) AS distance, CASE WHEN d IS NULL THEN 'no_stroke_in_range' WHEN second - d <= {a.MARGIN} THEN 'ambiguous_members' END AS reason FROM labels_ l LEFT JOIN (FROM r WHERE nth = 1) r ON r.page = l.page AND r.label = l.label""",
)
def member_candidates(spark, sf_dir):
    """The member that each label names, by its leader's tips or by its own place; several labels may name one."""
    labels, members, leaders = _sheet(spark, sf_dir)
    best = a.nearest(a.candidates(labels, members, leaders))
    torn = F.coalesce(F.col("second") - F.col("d") <= a.MARGIN, F.lit(False))
    reason = F.when(F.col("d").isNull(), "no_stroke_in_range").when(torn, "ambiguous_members")
    return labels.join(best, ["page", "label"], "left").select("page", "label", "method", F.when(~torn, F.col("member")).alias("member"), F.round("d", 3).alias("distance"), reason.alias("reason"))


@query("member_association")
def member_association(spark, sf_dir):
    """Labels claim members in order, each once, and look farther for what is left."""
    labels, members, leaders = _sheet(spark, sf_dir)
    return a.associated(labels.withColumn("place", F.col("label")), members, leaders)


#: What stands near a page's top reads as headings.
_PRINTED = "CASE WHEN cy < 600 THEN CASE p_partkey % 4 WHEN 0 THEN 'MARK' WHEN 1 THEN 'SIZE' WHEN 2 THEN 'TYPE' ELSE 'REMARKS' END WHEN p_partkey % 2 = 0 THEN 'B' || weight ELSE label END"
_HEADS = "('MARK', 'TYPE', 'NO.', 'TAG', 'SIZE', 'SECTION', 'SHAPE', 'COLUMN SIZE', 'BEAM SIZE')"
_TABLE = f"""{_CHAINS}, {PARTS_SQL.split('printed AS')[0].rstrip().rstrip(',')}, rules AS (SELECT * FROM axes WHERE pieces >= 2), regions AS (SELECT page, min(if(orientation = 'vertical', axis, lo)) AS rx0, min(if(orientation = 'horizontal', axis, lo)) AS ry0, max(if(orientation = 'vertical', axis, hi)) AS rx1, max(if(orientation = 'horizontal', axis, hi)) AS ry1 FROM rules GROUP BY page),
held AS (SELECT DISTINCT page, orientation, axis AS spot FROM rules JOIN regions USING (page) WHERE if(orientation = 'horizontal', least(hi, rx1) - greatest(lo, rx0) >= 0.02::DOUBLE * (rx1 - rx0), least(hi, ry1) - greatest(lo, ry0) >= 0.02::DOUBLE * (ry1 - ry0))),
bounds AS (SELECT page, orientation, spot FROM held QUALIFY coalesce(spot - lag(spot) OVER (PARTITION BY page, orientation ORDER BY spot) > {t.SAME_LINE}, TRUE)),
words AS (SELECT page, box, {_PRINTED} AS text, cx / 2.0::DOUBLE AS px, cy / 2.0::DOUBLE AS py FROM b JOIN parts ON p_partkey = CAST(split_part(box, '-', 2) AS BIGINT)),
one AS (SELECT words.* FROM words JOIN regions USING (page) WHERE px BETWEEN rx0 AND rx1 AND py BETWEEN ry0 AND ry1 QUALIFY row_number() OVER (PARTITION BY page, text, px, py ORDER BY box) = 1),
n AS (SELECT o.*, (SELECT count(*) FROM bounds d WHERE d.page = o.page AND orientation = 'horizontal' AND spot <= py) AS "row", (SELECT count(*) FROM bounds d WHERE d.page = o.page AND orientation = 'vertical' AND spot <= px) AS col,
  (SELECT count(*) FROM bounds d WHERE d.page = o.page AND orientation = 'horizontal') AS rows_, (SELECT count(*) FROM bounds d WHERE d.page = o.page AND orientation = 'vertical') AS cols_ FROM one o),
cells AS (SELECT page, "row", col, string_agg(text, ' ' ORDER BY py, px, box) AS text, count(*) AS words FROM n WHERE "row" BETWEEN 1 AND rows_ - 1 AND col BETWEEN 1 AND cols_ - 1 GROUP BY ALL)"""


def _cells(spark, sf_dir):
    """Rulings and words are dealt by page alike, so that regions, lines and words meet where they are."""
    n = table(spark, sf_dir, "lineitem").count()
    rules = g.dealt(written(_axes(spark, sf_dir).filter("pieces >= 2").select("page", "orientation", "axis", "lo", "hi"), "rules"), n, "page")
    of = lambda f, way, other, c: f(F.when(F.col("orientation") == way, F.col("axis")).otherwise(F.col(other))).alias(c)
    regions = rules.groupBy("page").agg(of(F.min, "vertical", "lo", "x0"), of(F.min, "horizontal", "lo", "y0"), of(F.max, "vertical", "hi", "x1"), of(F.max, "horizontal", "hi", "y1")).withColumn("region", F.lit(1))
    parts = labelled_parts(spark, sf_dir).select("p_partkey", "weight", "label")
    at = _each(_paged(spark, sf_dir), lambda x: x.select("page", "box", "cx", "cy", F.split_part("box", F.lit("-"), F.lit(2)).cast("long").alias("p_partkey"))).join(parts, "p_partkey")
    words = at.select("page", F.col("box").alias("word"), F.expr(_PRINTED).alias("text"), (F.col("cx") / 2).alias("px"), (F.col("cy") / 2).alias("py"))
    return t.cells(regions, rules.select("page", "orientation", F.col("axis").alias("at"), "lo", "hi"), g.dealt(words, n, "page"), along=0.02)


@query("table_cells", f'WITH {_TABLE} SELECT page, "row", col, text, words FROM cells')
def table_cells(spark, sf_dir):
    """The words between two rulings each way of a page."""
    return _cells(spark, sf_dir).select("page", "row", "col", "text", F.col("words").cast("long").alias("words"))


@query(
    "grid_rows",
    f"""WITH {_TABLE}, top AS (SELECT page, "row", col, upper(text) AS label FROM cells WHERE "row" <= {t.HEADING_ROWS}), head AS (SELECT page, min("row") AS head FROM (SELECT page, "row" FROM top GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (label IN {_HEADS}) >= 1) GROUP BY page),
roles AS (SELECT page, head, CASE WHEN label IN ('MARK', 'TYPE', 'NO.', 'TAG') OR label LIKE '% MARK' THEN 'mark' WHEN label IN {_HEADS} THEN 'size' END AS role, min(col) AS col FROM top JOIN head USING (page) WHERE "row" = head GROUP BY ALL),
body AS (SELECT page, "row", max(text) FILTER (role = 'mark') AS mark, max(text) FILTER (role = 'size') AS size FROM cells JOIN head USING (page) LEFT JOIN roles USING (page, head, col) WHERE "row" > head GROUP BY ALL)
SELECT page, "row", mark, size, CASE WHEN mark IS NULL AND size IS NULL THEN 'empty' WHEN mark IS NULL THEN 'no_mark' WHEN size IS NULL THEN 'no_size' ELSE 'read' END AS status FROM body""",
)
def grid_rows(spark, sf_dir):
    """The rows under each page's heading row, with their mark and size."""
    return t.grid_rows(_cells(spark, sf_dir)).select("page", "row", "mark", "size", "status")
