"""Grid lines at any angle, and where two named ones cross on each plan of a building.

A line is n . p = c: its direction is a bucket of half a degree, n its normal there. Defined cases: a stroke shorter
than LEAST_STROKE has no direction; a name of several lines on a page gives all their crossings; rows with nulls in
a place or name meet nothing; empty tables give no lines and no crossings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directions in half a circle, the shortest stroke, how near a bubble a stroke begins and how far its line may miss the centre.
DIRECTIONS, LEAST_STROKE, LOCAL_REACH, MISS = 360, 2.0, 60.0, 1.5
#: Widths of a cell in reaches, and of one of directions and places in buckets: rows are filed under one or two of them, not under nine.
CELL, BUCKETS = 4, 8
#: The least ink along a line, buckets within which lines are parallel, and how far from a crossing a mark is found.
LEAST_INK, PARALLEL, MARK_REACH = 12.0, 20, 12.0


def angle(key: Column) -> Column:
    return F.radians(key * 180.0 / DIRECTIONS)


def place(key: Column, x: Column, y: Column) -> Column:
    """c of the line through a point: what the point measures along the normal."""
    return -F.sin(angle(key)) * x + F.cos(angle(key)) * y


def _nearest(c: Column) -> Column:
    return F.floor(c + 0.5)


def _filed(rows: DataFrame, reach: float, width: float, **places: Column) -> DataFrame:
    """rows under each of the cells, so wide, within reach of a place, in every dimension: few where cells are wide."""
    for name, c in places.items():
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor((c - reach) / width), F.floor((c + reach) / width))))
    return rows


def directed(strokes: DataFrame) -> DataFrame:
    """Strokes (page, x0, y0, x1, y1) with length and key, their direction."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    turned = F.pmod(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))), F.lit(180.0))
    key = F.pmod(_nearest(turned * DIRECTIONS / 180.0), F.lit(DIRECTIONS))
    return strokes.withColumn("length", F.sqrt((dx * dx + dy * dy).cast("double"))).filter(F.col("length") >= LEAST_STROKE).withColumn("key", key)


def axes(strokes: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(page, name, key, c, ink) of bubbles (page, name, x, y): of the lines that start beside a bubble and pass its centre the one of most ink.

    Ink is summed by direction and rounded place first, and a line takes what lies within one of each; strokes find
    bubbles by cells, so both are joins on keys. Lines of one name that round to one place are one.
    """
    drawn = directed(strokes)
    lines = drawn.groupBy("page", "key", _nearest(place(F.col("key"), F.col("x0"), F.col("y0"))).alias("at")).agg(F.sum("length").alias("ink"))
    cell = lambda c: F.floor(c / (CELL * LOCAL_REACH))
    ends = drawn.select("page", "key", F.col("x0").alias("sx"), F.col("y0").alias("sy"), F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e"))
    ends = ends.select("page", "key", "sx", "sy", F.col("e.x").alias("ex"), F.col("e.y").alias("ey")).withColumn("gx", cell(F.col("ex"))).withColumn("gy", cell(F.col("ey")))
    around = _filed(bubbles.select("page", "name", "x", "y"), LOCAL_REACH, CELL * LOCAL_REACH, gx=F.col("x"), gy=F.col("y"))
    x, y, key = F.col("x"), F.col("y"), F.col("key")
    beside = (F.pow(x - F.col("ex"), F.lit(2)) + F.pow(y - F.col("ey"), F.lit(2)) <= LOCAL_REACH**2) & (F.abs(place(key, x, y) - place(key, F.col("sx"), F.col("sy"))) <= MISS)
    local = around.join(ends, ["page", "gx", "gy"]).filter(beside).select("page", "name", "x", "y", "key").distinct().withColumn("c", place(key, x, y))
    turned = F.array_distinct(F.array(*[F.floor(F.pmod(F.col("own") + i, F.lit(DIRECTIONS)) / BUCKETS) for i in (-1, 0, 1)]))
    wide = _filed(local.withColumnRenamed("key", "own").withColumn("mid", _nearest(F.col("c"))).withColumn("k", F.explode(turned)), 1, BUCKETS, a=F.col("mid"))
    near = F.least(F.abs(F.col("key") - F.col("own")), DIRECTIONS - F.abs(F.col("key") - F.col("own"))) <= 1
    drawn_at = lines.withColumn("k", F.floor(key / BUCKETS)).withColumn("a", F.floor(F.col("at") / BUCKETS))
    inked = wide.join(drawn_at, ["page", "k", "a"]).filter(near & (F.abs(F.col("at") - F.col("mid")) <= 1)).groupBy("page", "name", "x", "y", "own", "c").agg(F.round(F.sum("ink"), 6).alias("ink"))
    best = inked.groupBy("page", "name", "x", "y").agg(F.max(F.struct("ink", (-F.col("own")).alias("own"), "c")).alias("b")).filter(F.col("b.ink") >= LEAST_INK)
    one = best.groupBy("page", "name", (-F.col("b.own")).alias("key"), _nearest(F.col("b.c")).alias("at")).agg(F.min("b.c").alias("c"), F.max("b.ink").alias("ink"))
    return one.select("page", "name", "key", "c", "ink")


def crossings(wanted: DataFrame, lines: DataFrame, sheet: float) -> DataFrame:
    """wanted (page, a, b) with px, py, where lines of both names cross on the sheet; lines within 10 degrees do not."""
    first = lines.select("page", F.col("name").alias("a"), F.col("key").alias("ka"), F.col("c").alias("ca"))
    second = lines.select("page", F.col("name").alias("b"), F.col("key").alias("kb"), F.col("c").alias("cb"))
    met = wanted.select("page", "a", "b").distinct().join(first, ["page", "a"]).join(second, ["page", "b"])
    turn = F.abs(F.col("ka") - F.col("kb"))
    met = met.filter(F.least(turn, DIRECTIONS - turn) > PARALLEL)
    ta, tb = angle(F.col("ka")), angle(F.col("kb"))
    # n = (-sin, cos) of both lines; their determinant is the sine of the turn.
    det = F.sin(tb - ta)
    px, py = [F.try_divide(F.col("ca") * f(tb) - F.col("cb") * f(ta), det) for f in (F.cos, F.sin)]
    return met.select("page", "a", "b", F.round(px, 3).alias("px"), F.round(py, 3).alias("py")).filter(f"px between 0 and {sheet} and py between 0 and {sheet}").distinct()


def nearest_marks(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (page, px, py, ...) with the nearest of marks (page, mark, x, y) in reach and its distance; null where there is none."""
    cell = lambda c: F.floor(c / (CELL * MARK_REACH))
    around = _filed(marks.select("page", "mark", "x", "y"), MARK_REACH, CELL * MARK_REACH, gx=F.col("x"), gy=F.col("y"))
    at = points.select("page", "px", "py").distinct().withColumn("gx", cell(F.col("px"))).withColumn("gy", cell(F.col("py")))
    far = F.round(F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2))), 6)
    near = at.join(around, ["page", "gx", "gy"]).withColumn("far", far).filter(F.col("far") <= MARK_REACH)
    first = near.groupBy("page", "px", "py").agg(F.min(F.struct("far", "mark")).alias("m")).select("page", "px", "py", "m.far", "m.mark")
    return points.join(first, ["page", "px", "py"], "left")
