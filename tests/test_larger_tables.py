"""What queries over larger tables hang on: one exchange of boxes, tasks by the number of rows, few rows filed."""

import random
from itertools import product

from beamline.operators import association, candidates, layout, tracing

BOX = "box string, page int, x0 long, y0 long, x1 long, y1 long, cx long, cy long"


def filed(frame):
    """The most rows that an explode of the plan gives."""
    frame.collect()
    most, open_ = 0, [frame._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            if name == "GenerateExec":
                most = max(most, node.metrics().apply("numOutputRows").value())
            open_ += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_both_sides_of_near_pairs_are_one_exchange_and_degrees_need_no_other(spark):
    rows = [(f"{i}", i % 3, i, i, i, i, 2 * i, 2 * i) for i in range(300)]
    near = layout.near_pairs(spark.createDataFrame(rows, BOX), 30).groupBy("page", *layout.CELLS, "box").count()
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") <= 2


def test_tasks_grow_with_rows(spark):
    rows = spark.range(10).withColumnRenamed("id", "page")
    assert layout.dealt(rows, 200 * layout.ROWS_A_TASK, "page").rdd.getNumPartitions() == 201


def test_near_fields_by_brute_force(spark):
    rows = [(f"{f}{d}X{w}", f, d, w) for f, d, w in product("WM", range(5), range(0, 40, 3))] + [("N", None, None, None)]
    found = candidates.near_fields(spark.createDataFrame(rows, "label string, family string, depth long, weight long"), 13).collect()
    far = lambda a, b: 10 * abs(a[2] - b[2]) + abs(a[3] - b[3])
    whole = rows[:-1]
    assert sorted(map(tuple, found)) == sorted((a[0], b[0], far(a, b)) for a in whole for b in whole if a != b and a[1] == b[1] and far(a, b) <= 13)


def test_segments_strokes_and_marks_are_filed_under_few_cells(spark):
    draw = random.Random(3)
    spots = [(draw.uniform(0, 5000), draw.uniform(0, 5000)) for _ in range(2000)]
    points = spark.createDataFrame([(1, x, y) for x, y in spots[:50]], "page int, px double, py double")
    segments = spark.createDataFrame([(1, x, y, x + 5, y + 5) for x, y in spots], "page int, x0 double, y0 double, x1 double, y1 double")
    assert 0 < filed(association.near(points, segments, 100.0)) < 4 * len(spots)
    marks = spark.createDataFrame([(1, f"{i}", x, y) for i, (x, y) in enumerate(spots)], "page int, mark string, x double, y double")
    assert 0 < filed(tracing.nearest_marks(points, marks)) < 4 * len(spots)
