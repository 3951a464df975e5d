"""Annotations put together from pieces, title blocks, and annotations matched with what is known of their place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as a
from ..registry import query
from .layout import _BOXES, _boxes, _each, _paged

#: Boxes as pieces of labels and tags, some of unknown font or turned, by part and order.
_PIECES = f"""{_BOXES}, k AS (SELECT *, CAST(split_part(box, '-', 1) AS BIGINT) AS ord, CAST(split_part(box, '-', 2) AS BIGINT) AS part FROM b),
pieces AS (SELECT page, box, x0, y0, x1, y1, CASE part % 5 WHEN 0 THEN 'W' WHEN 1 THEN '' || part % 40 WHEN 2 THEN 'X' WHEN 3 THEN '[' || part % 30 || ']' ELSE '[' || part % 7 || '] ' END AS text,
  CASE ord % 4 WHEN 0 THEN 10 WHEN 1 THEN 40 ELSE 120 END AS font, if(ord % 20 = 0, 90, 0) AS rotation FROM k)"""


def _named(boxes):
    part = lambda i: F.split_part("box", F.lit("-"), F.lit(i)).cast("long")
    return boxes.withColumn("ord", part(1)).withColumn("part", part(2))


def _numbers(spark, sf_dir):
    return _named(_boxes(spark, sf_dir))


@query(
    "baseline_groups",
    f"""WITH RECURSIVE {_PIECES}, o AS (SELECT *, row_number() OVER (ORDER BY page, y0, x0, box) AS nth FROM pieces),
l AS (SELECT o.*, regexp_full_match(trim(text), '\\[[^\\[\\]]+\\]') AS tag, x0 - lag(x1) OVER (ORDER BY nth) AS gap, lag(font) OVER (ORDER BY nth) AS f, lag(page) OVER (ORDER BY nth) = page
  AND lag(rotation) OVER (ORDER BY nth) = rotation AND abs(y0 + y1 - lag(y0 + y1) OVER (ORDER BY nth)) * 10 <= 8 * greatest(font, lag(font) OVER (ORDER BY nth)) AS level FROM o),
s AS (SELECT *, coalesce(level AND gap >= 0 AND 2 * gap <= 3 * f, FALSE) AS linked FROM l),
walk AS (SELECT nth, nth AS head, FALSE AS modifier FROM s WHERE NOT linked
  UNION ALL SELECT s.nth, CASE WHEN walk.modifier THEN s.nth ELSE walk.head END, s.tag AND NOT walk.modifier FROM walk JOIN s ON s.nth = walk.nth + 1 AND s.linked),
g AS (SELECT s.*, head, modifier FROM s JOIN walk USING (nth))
SELECT any_value(page) AS page, min_by(box, nth) AS piece, count(*) AS n, trim(string_agg(text, '' ORDER BY nth) FILTER (NOT modifier)) AS label,
  trim(string_agg(if(nth > head AND 5 * gap > f, ' ', '') || text, '' ORDER BY nth) FILTER (NOT modifier) || coalesce(' ' || max(text) FILTER (modifier), '')) AS original,
  replace(replace(trim(max(text) FILTER (modifier)), '[', ''), ']', '') AS modifier,
  concat_ws(',', CASE WHEN count(*) FILTER (NOT modifier) > 1 THEN 'same_baseline_merge' END, CASE WHEN bool_or(modifier) THEN 'bracket_modifier_attachment' END) AS reasons,
  min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM g GROUP BY head""",
)
def baseline_groups(spark, sf_dir):
    """Annotations from pieces that go on along a baseline, with the tag behind them as modifier; pages are read whole but for crowded ones."""
    tag = lambda m: F.concat(F.lit("["), (F.col("part") % m).cast("string"), F.lit("]"))
    kind = F.col("part") % 5
    text = F.when(kind == 0, "W").when(kind == 1, (F.col("part") % 40).cast("string")).when(kind == 2, "X").when(kind == 3, tag(30)).otherwise(F.concat(tag(7), F.lit(" ")))
    font = F.when(F.col("ord") % 4 == 1, 40).when(F.col("ord") % 4 > 1, 120)
    pieces = lambda n: n.select("page", F.col("box").alias("piece"), text.alias("text"), "x0", "y0", "x1", "y1", font.alias("font"), F.when(F.col("ord") % 20 == 0, 90).alias("rotation"))
    whole, *crowded = [pieces(_named(x)) for x in _paged(spark, sf_dir)]
    return _each([a.baseline_groups(whole, whole_pages=True), *map(a.baseline_groups, crowded)], lambda x: x)


#: Share of the width beyond which boilerplate lies, widest gap within a block, and play at its edge.
OUTER, BLOCK_GAP, PLAY = 0.70, 0.03, 0.006


@query(
    "title_block",
    f"""WITH {_PIECES}, size AS (SELECT page, max(x1) AS w, max(x0) FILTER (part % 11 = 0 AND page % 3 > 0 AND ord % 2 = 0) AS sheet FROM k GROUP BY page),
pts AS (SELECT DISTINCT page, x0 AS v, w, sheet FROM k JOIN size USING (page) WHERE part % 2 = 0 AND x0 >= {OUTER} * w UNION SELECT page, sheet, w, sheet FROM size WHERE sheet IS NOT NULL),
st AS (SELECT *, coalesce(sheet, max(v) OVER (PARTITION BY page)) AS start FROM pts), below AS (SELECT *, lag(v) OVER (PARTITION BY page ORDER BY v DESC) - v > {BLOCK_GAP}::DOUBLE * w AS wide FROM st WHERE v <= start),
edges AS (SELECT page, min(v) AS edge FROM below x WHERE NOT EXISTS (SELECT 1 FROM below y WHERE y.page = x.page AND y.v >= x.v AND y.wide) GROUP BY page)
SELECT k.page, any_value(edge)::DOUBLE AS edge, count(*) FILTER (x0 >= coalesce(edge::DOUBLE, {OUTER}::DOUBLE * w) - {PLAY}::DOUBLE * w) AS inside FROM k JOIN size USING (page) LEFT JOIN edges USING (page) GROUP BY k.page""",
)
def title_block(spark, sf_dir):
    """Of each page the left edge of its title block, walked from the sheet's number over boilerplate, and how many boxes lie in it."""
    n = _numbers(spark, sf_dir)
    sheet = F.max(F.when((F.col("part") % 11 == 0) & (F.col("page") % 3 > 0) & (F.col("ord") % 2 == 0), F.col("x0")))
    size = n.groupBy("page").agg(F.max("x1").alias("w"), sheet.alias("anchor")).withColumn("gap", F.lit(BLOCK_GAP) * F.col("w"))
    on = n.join(size, "page")
    points = on.filter((F.col("part") % 2 == 0) & (F.col("x0") >= OUTER * F.col("w"))).select("page", F.col("x0").alias("value"))
    edges = a.contiguous_edge(points, size.select("page", "anchor", "gap"), "page")
    inside = F.col("x0") >= F.coalesce("edge", OUTER * F.col("w")) - PLAY * F.col("w")
    return on.join(edges, "page", "left").groupBy("page").agg(F.first("edge").alias("edge"), F.count_if(inside).alias("inside"))


#: Fixed value: how far from an annotation a record of its place may lie.
MATCH_RADIUS = 40


@query(
    "manifest_match",
    f"""WITH {_PIECES}, r AS (SELECT q.page, q.box AS annotation, m.box AS record, if(m.part % 3 = 1, 'mutation', 'clean_control') AS kind, (q.cx - m.cx) ** 2 + (q.cy - m.cy) ** 2 AS d2
  FROM k q JOIN k m ON q.page = m.page AND q.part % 3 = 0 AND (m.part % 3 = 2 OR m.part % 3 = 1 AND m.ord % 4 > 0) WHERE (q.cx - m.cx) ** 2 + (q.cy - m.cy) ** 2 <= 4 * {MATCH_RADIUS * MATCH_RADIUS})
SELECT q.page, q.box AS annotation, record, kind, CAST(d2 AS BIGINT) AS d2 FROM k q LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page, annotation ORDER BY d2, kind = 'clean_control', record) = 1) n ON n.page = q.page AND n.annotation = q.box WHERE q.part % 3 = 0""",
)
def manifest_match(spark, sf_dir):
    """Every annotation with the nearest verified mutation or clean control of its page, by place alone; a mutation goes first where both are equally near."""
    n = _numbers(spark, sf_dir)
    key = F.struct("page", "box")
    asked = n.filter("part % 3 = 0").withColumn("annotation", key)
    records = n.filter("part % 3 = 2 or part % 3 = 1 and ord % 4 > 0").withColumn("turn", (F.col("part") % 3).cast("int"))
    records = records.select("page", F.col("box").alias("record"), F.when(F.col("turn") == 1, "mutation").otherwise("clean_control").alias("kind"), "turn", "cx", "cy")
    found = a.nearest_record(asked.select("page", "annotation", "cx", "cy"), records, MATCH_RADIUS)
    return asked.select("annotation").join(found, "annotation", "left").select("annotation.page", F.col("annotation.box").alias("annotation"), "record", "kind", "d2")
