"""Near pairs by brute force, and how many cells a box is filed under."""

import random

import pytest

from beamline.operators.layout import near_pairs

SIDES = ("box", "x0", "y0", "x1", "y1", "cx", "cy")


@pytest.mark.parametrize("radius", [7, 30])
def test_near_pairs_by_brute_force_from_few_cells(spark, radius):
    draw = random.Random(radius)
    rows = []
    for i in range(400):
        x, y, w, h = draw.randint(-300, 300), draw.randint(-300, 300), draw.randint(0, 15), draw.randint(0, 15)
        rows.append((f"{i}-{i % 7}", i % 3, x, y, x + w, y + h, 2 * x + w, 2 * y + h))
    rows += [("a", 0, 0, 0, 2 * radius, 0, 2 * radius, 0), ("b", 0, 2 * radius, 0, 2 * radius, 0, 4 * radius, 0), ("c", 0, 6 * radius, 0, 6 * radius, 0, 12 * radius, 0)]
    boxes = spark.createDataFrame(rows, "box string, page int, x0 long, y0 long, x1 long, y1 long, cx long, cy long")
    pairs = near_pairs(boxes, radius)
    want = []
    for a in rows:
        for b in rows:
            d2 = (a[6] - b[6]) ** 2 + (a[7] - b[7]) ** 2
            if a[1] == b[1] and a[0] != b[0] and d2 <= 4 * radius * radius:
                want.append((a[1], a[0], *a[2:], b[0], *b[2:], d2))
    got = [tuple(r) for r in pairs.select("page", *SIDES, *[f"{c}_b" for c in SIDES], "d2").collect()]
    assert sorted(got) == sorted(want) and any(r[1] == "a" and r[8] == "b" for r in got)


def test_a_box_is_filed_under_few_cells(spark):
    draw = random.Random(1)
    rows = [(f"{i}", 0, x, y, x, y, 2 * x, 2 * y) for i, (x, y) in enumerate((draw.randint(0, 5000), draw.randint(0, 5000)) for _ in range(2000))]
    near = near_pairs(spark.createDataFrame(rows, "box string, page int, x0 long, y0 long, x1 long, y1 long, cx long, cy long"), 30)
    near.collect()
    filed, open_ = 0, [near._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            if name == "GenerateExec":
                filed = max(filed, node.metrics().apply("numOutputRows").value())
            open_ += [node.children().apply(i) for i in range(node.children().size())]
    assert len(rows) < filed < 4 * len(rows)
