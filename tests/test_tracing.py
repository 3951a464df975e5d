"""Grid lines at an angle, their crossings and the marks on them, by hand-made plans."""

from math import cos, radians, sin

from beamline.operators import tracing


def along(deg, x, y, start, end):
    return tuple(round(v, 4) for v in (x + start * cos(radians(deg)), y + start * sin(radians(deg)), x + end * cos(radians(deg)), y + end * sin(radians(deg))))


STROKES, BUBBLES = "page long, x0 double, y0 double, x1 double, y1 double", "page long, name string, x double, y double"


def test_slanted_lines_cross_where_they_are_drawn(spark):
    # Page 1: A at 30 degrees through (100, 100), 1 at 120 through (400, 100), dashed; a short stroke beside A has less ink.
    rows = [(1, *along(30, 100, 100, a, a + 40)) for a in (10, 60, 110, 160)] + [(1, *along(120, 400, 100, a, a + 40)) for a in (10, 60, 110)]
    rows += [(1, *along(75, 100, 100, 5, 18)), (1, 100.0, 100.0, 101.0, 100.0), (2, *along(30, 100, 100, 10, 50)), (1, None, 0.0, 1.0, 1.0)]
    bubbles = [(1, "A", 100.0, 100.0), (1, "1", 400.0, 100.0), (2, "A", 100.0, 100.0), (2, "1", 500.0, 500.0), (1, "B", None, 5.0), (1, None, 700.0, 700.0)]
    lines = tracing.axes(spark.createDataFrame(rows, STROKES), spark.createDataFrame(bubbles, BUBBLES))
    found = {(r.page, r.name): (r.key, round(r.ink)) for r in lines.collect()}
    assert found == {(1, "A"): (60, 160), (1, "1"): (240, 120), (2, "A"): (60, 40)}
    wanted = spark.createDataFrame([(1, "A", "1"), (1, "A", "1"), (2, "A", "1"), (1, "A", "A")], "page long, a string, b string")
    points = tracing.crossings(wanted, lines, 1000)
    # The foot of the perpendicular from (400, 100) on A.
    [p] = points.collect()
    assert (p.page, p.a, p.b) == (1, "A", "1") and abs(p.px - 325) < 0.01 and abs(p.py - 229.904) < 0.01
    marks = [(1, "near", 326.0, 230.0), (1, "same", 326.0, 230.0), (1, "far", 325.0, 243.0), (2, "other", 325.0, 230.0), (1, "none", None, 1.0)]
    [m] = tracing.nearest_marks(points, spark.createDataFrame(marks, "page long, mark string, x double, y double")).collect()
    assert m.mark == "near" and abs(m.far - 1.0046) < 0.001
    assert tracing.crossings(wanted, lines, 200).count() == 0


def test_lines_within_ten_degrees_do_not_cross(spark):
    lines = spark.createDataFrame([(1, "A", 358, 10.0, 50.0), (1, "1", 17, 40.0, 50.0), (1, "2", 19, 40.0, 50.0)], "page long, name string, key long, c double, ink double")
    wanted = spark.createDataFrame([(1, "A", "1"), (1, "A", "2")], "page long, a string, b string")
    assert {r.b for r in tracing.crossings(wanted, lines, 1000).collect()} <= {"2"}


def test_empty_plans(spark):
    lines = tracing.axes(spark.createDataFrame([], STROKES), spark.createDataFrame([], BUBBLES))
    assert lines.count() == 0
    assert tracing.crossings(spark.createDataFrame([(1, "A", "1")], "page long, a string, b string"), lines, 1000).count() == 0
