"""One scheduled column, looked for on the plans of all levels that it spans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import tracing
from ..registry import query
from ..sources.scratch import written
from ..sources.tables import PREDICTIONS_SQL, predictions
from .layout import _BOXES, _boxes

#: Levels of a building; its plans are the pages building * LEVELS + level. A sheet's side in points.
LEVELS, SHEET = 7, 1100
#: Names of grid lines: letters, crossed by numbers.
NAMES = 6

# A box's diagonal is a stroke, rising or falling by its order; low boxes are bubbles, wide ones marks.
_STROKES = "strokes AS (SELECT page, box, x0, CASE WHEN CAST(split_part(box, '-', 1) AS BIGINT) % 2 = 0 THEN y0 ELSE y1 END AS y0, x1, CASE WHEN CAST(split_part(box, '-', 1) AS BIGINT) % 2 = 0 THEN y1 ELSE y0 END AS y1 FROM b)"
_NAME = f"CASE WHEN part % 2 = 0 THEN chr(CAST(65 + part // 2 % {NAMES} AS INTEGER)) ELSE CAST(1 + part // 2 % {NAMES} AS VARCHAR) END"
_RAD, _D = f"radians({{k}} * 180.0::DOUBLE / {tracing.DIRECTIONS})", tracing.DIRECTIONS
_PLACE = lambda k, x, y: f"(-sin({_RAD.format(k=k)}) * {x} + cos({_RAD.format(k=k)}) * {y})"

_TRACE = f"""{_BOXES}, {PREDICTIONS_SQL}, {_STROKES},
bubbles AS (SELECT page, {_NAME} AS name, cx / 2.0::DOUBLE AS x, cy / 2.0::DOUBLE AS y FROM (SELECT *, CAST(split_part(box, '-', 2) AS BIGINT) AS part FROM b WHERE y1 - y0 <= 7)),
d AS (SELECT page, x0, y0, x1, y1, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length, CAST(floor((degrees(atan2(y1 - y0, x1 - x0)) + 180) % 180 * {_D} / 180.0::DOUBLE + 0.5) AS BIGINT) % {_D} AS key FROM strokes),
lines AS (SELECT page, key, floor({_PLACE("key", "x0", "y0")} + 0.5) AS at, sum(length) AS ink FROM d WHERE length >= {tracing.LEAST_STROKE} GROUP BY ALL),
local AS (SELECT DISTINCT u.page, name, x, y, key, {_PLACE("key", "x", "y")} AS c FROM bubbles u JOIN d ON d.page = u.page AND length >= {tracing.LEAST_STROKE}
  AND least(power(x - x0, 2) + power(y - y0, 2), power(x - x1, 2) + power(y - y1, 2)) <= {tracing.LOCAL_REACH**2} AND abs({_PLACE("key", "x", "y")} - {_PLACE("key", "x0", "y0")}) <= {tracing.MISS}),
inked AS (SELECT l.page, name, x, y, l.key, c, round(sum(ink), 6) AS ink FROM local l JOIN lines n ON n.page = l.page AND least(abs(n.key - l.key), {_D} - abs(n.key - l.key)) <= 1 AND abs(n.at - floor(c + 0.5)) <= 1 GROUP BY ALL),
best AS (SELECT * FROM inked QUALIFY row_number() OVER (PARTITION BY page, name, x, y ORDER BY ink DESC, key) = 1),
axes AS (SELECT page, name, key, min(c) AS c, max(ink) AS ink FROM best WHERE ink >= {tracing.LEAST_INK} GROUP BY page, name, key, floor(c + 0.5))"""


def _grid(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    order, part = F.split("box", "-")[0].cast("long"), F.split("box", "-")[1].cast("long")
    rising = order % 2 == 0
    strokes = b.select("page", "x0", F.when(rising, F.col("y0")).otherwise(F.col("y1")).alias("y0"), "x1", F.when(rising, F.col("y1")).otherwise(F.col("y0")).alias("y1"))
    nth = F.floor(part / 2) % NAMES
    name = F.when(part % 2 == 0, F.chr(65 + nth)).otherwise((1 + nth).cast("string"))
    bubbles = b.filter("y1 - y0 <= 7").select("page", name.alias("name"), (F.col("cx") / 2.0).alias("x"), (F.col("cy") / 2.0).alias("y"))
    return tracing.axes(strokes, bubbles)


@query("grid_axes", f"WITH {_TRACE} SELECT page, name, key / 2.0::DOUBLE AS degrees, round(c, 3) AS c, round(ink, 3) AS ink FROM axes")
def grid_axes(spark, sf_dir):
    """The named grid lines of each page, at any angle, with the ink that lies along them."""
    return _grid(spark, sf_dir).select("page", "name", (F.col("key") / 2.0).alias("degrees"), F.round("c", 3).alias("c"), F.round("ink", 3).alias("ink"))


_RAD_A, _RAD_B = _RAD.format(k="f.key"), _RAD.format(k="s.key")
_COLUMN_KEYS = "building, a, b"


@query(
    "column_trace",
    f"""WITH {_TRACE}, columns AS (SELECT page AS building, chr(CAST(65 + l_partkey % {NAMES} AS INTEGER)) AS a, CAST(1 + l_partkey // {NAMES} % {NAMES} AS VARCHAR) AS b, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM predictions WHERE is_schedule AND section IS NOT NULL GROUP BY 1, 2, 3),
plans AS (SELECT *, building * {LEVELS} + level AS page FROM (SELECT *, unnest(range(lo, hi + 1)) AS level FROM columns)),
met AS (SELECT p.building, p.a, p.b, p.level, p.page, round((f.c * cos({_RAD_B}) - s.c * cos({_RAD_A})) / sin({_RAD_B} - {_RAD_A}), 3) AS px, round((f.c * sin({_RAD_B}) - s.c * sin({_RAD_A})) / sin({_RAD_B} - {_RAD_A}), 3) AS py
  FROM plans p JOIN axes f ON f.page = p.page AND f.name = p.a JOIN axes s ON s.page = p.page AND s.name = p.b WHERE least(abs(f.key - s.key), {_D} - abs(f.key - s.key)) > {tracing.PARALLEL}),
points AS (SELECT DISTINCT * FROM met WHERE px BETWEEN 0 AND {SHEET} AND py BETWEEN 0 AND {SHEET}),
near AS (SELECT p.*, m.box AS mark, round(sqrt(power(m.cx / 2.0::DOUBLE - px, 2) + power(m.cy / 2.0::DOUBLE - py, 2)), 6) AS far FROM points p LEFT JOIN b m ON m.page = p.page AND m.x1 - m.x0 >= 13 AND round(sqrt(power(m.cx / 2.0::DOUBLE - px, 2) + power(m.cy / 2.0::DOUBLE - py, 2)), 6) <= {tracing.MARK_REACH}),
found AS (SELECT {_COLUMN_KEYS}, level, count(DISTINCT (px, py)) AS crossings, arg_min(px, (coalesce(far, 1e9), px, py, mark)) AS x, arg_min(py, (coalesce(far, 1e9), px, py, mark)) AS y, arg_min(mark, (far, px, py, mark)) FILTER (mark IS NOT NULL) AS mark FROM near GROUP BY ALL),
named AS (SELECT DISTINCT page, name FROM axes), seen AS (SELECT DISTINCT page FROM b),
r AS (SELECT p.*, coalesce(crossings, 0) AS crossings, x, y, mark, CASE WHEN v.page IS NULL THEN 'no_plan' WHEN na.name IS NULL AND nb.name IS NULL THEN 'no_grid' WHEN na.name IS NULL OR nb.name IS NULL THEN 'one_grid' WHEN crossings IS NULL THEN 'no_crossing' WHEN mark IS NULL THEN 'not_detected' ELSE 'column_symbol' END AS status
  FROM plans p LEFT JOIN found USING (building, a, b, level) LEFT JOIN seen v ON v.page = p.page LEFT JOIN named na ON na.page = p.page AND na.name = p.a LEFT JOIN named nb ON nb.page = p.page AND nb.name = p.b)
SELECT building, a AS grid_a, b AS grid_b, level, page, status, crossings, x, y, mark, count(*) FILTER (status = 'column_symbol') OVER w AS levels_with_symbol, coalesce(string_agg(CAST(level AS VARCHAR), ',' ORDER BY level) FILTER (status <> 'column_symbol') OVER w, '') AS missing FROM r
WINDOW w AS (PARTITION BY {_COLUMN_KEYS})""",
)
def column_trace(spark, sf_dir):
    """One row a scheduled column and plan of a level that it spans: where its two grid lines cross, the mark drawn there, and the column's levels without one.

    A crossing with the nearest mark stands for the plan, else the first by place. Levels are seven at most, so
    a column's list of them is a bounded window.
    """
    entries = predictions(spark, sf_dir).filter("is_schedule and section is not null")
    a, b = F.chr(65 + F.col("l_partkey") % NAMES), (1 + F.floor(F.col("l_partkey") / NAMES) % NAMES).cast("string")
    columns = entries.groupBy(F.col("page").alias("building"), a.alias("a"), b.alias("b")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    level = F.explode(F.sequence("lo", "hi")).alias("level")
    plans = columns.select("building", "a", "b", level).withColumn("page", F.col("building") * LEVELS + F.col("level"))
    lines = written(_grid(spark, sf_dir), "grid-lines")
    marks = _boxes(spark, sf_dir).filter("x1 - x0 >= 13").select("page", F.col("box").alias("mark"), (F.col("cx") / 2.0).alias("x"), (F.col("cy") / 2.0).alias("y"))
    points = tracing.nearest_marks(tracing.crossings(plans, lines, SHEET), marks)
    best = F.min(F.struct(F.coalesce("far", F.lit(1e9)).alias("far"), "px", "py", "mark")).alias("best")
    found = points.groupBy("page", "a", "b").agg(F.count(F.lit(1)).alias("crossings"), best)
    named = lines.select("page", "name").distinct()
    has = lambda c: named.select("page", F.col("name").alias(c), F.lit(True).alias(f"has_{c}"))
    seen = _boxes(spark, sf_dir).select("page").distinct().withColumn("seen", F.lit(True))
    met = plans.join(seen, "page", "left").join(has("a"), ["page", "a"], "left").join(has("b"), ["page", "b"], "left").join(found, ["page", "a", "b"], "left")
    neither = F.col("has_a").isNull() & F.col("has_b").isNull()
    status = (
        F.when(F.col("seen").isNull(), "no_plan")
        .when(neither, "no_grid")
        .when(F.col("has_a").isNull() | F.col("has_b").isNull(), "one_grid")
        .when(F.col("crossings").isNull(), "no_crossing")
        .when(F.col("best.mark").isNull(), "not_detected")
        .otherwise("column_symbol")
    )
    judged = met.withColumn("status", status)
    column, drawn = W.partitionBy("building", "a", "b"), F.col("status") == "column_symbol"
    without = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~drawn, F.col("level"))).over(column)), lambda n: n.cast("string")), ",")
    return judged.select(
        "building", F.col("a").alias("grid_a"), F.col("b").alias("grid_b"), "level", "page", "status", F.coalesce("crossings", F.lit(0)).alias("crossings"), F.col("best.px").alias("x"), F.col("best.py").alias("y"), F.col("best.mark").alias("mark"),
        F.count(F.when(drawn, 1)).over(column).alias("levels_with_symbol"), without.alias("missing"),
    )
