"""Nearest vectors of a label against plain Python, shard by shard and block by block."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from beamline.operators.neighbours import nearest_of_label

VECTOR = "vec_id long, label long, embedding array<double>"


def plain(rows, every, most):
    norm = lambda e: math.sqrt(sum(x * x for x in e))
    usable = [(i, k, e) for i, k, e in rows if i is not None and k is not None and e is not None and None not in e and not norm(e) <= 0]
    out = set()
    for i, k, e in usable:
        scores = []
        for j, l, f in usable:
            if i % every == 0 and j != i and k == l:
                total = 0.0
                for a, b in zip(e, f):
                    total += a * b
                x = total / (norm(e) * norm(f))
                scores.append((-float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if x == x else -math.inf, j))
        out |= {(i, j, None if x == -math.inf else -x + 0.0, place + 1) for place, (x, j) in enumerate(sorted(scores)[:most])}
    return out


@pytest.mark.parametrize("shard, block", [(16_384, 16_384), (40, 7), (700, 3)])
def test_nearest_by_brute_force(spark, shard, block):
    """Copies, vectors of other lengths, not finite ones and tiny ones, also where a label is in many shards and blocks."""
    rng = random.Random(shard)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(6)]) for i in range(0, 900)]
    rows += [(i, 0, [1.0, 2.0, 2.0, 0.0, 0.0, 0.0]) for i in range(900, 1100)]
    rows += [(1200, 0, [1.0]), (1220, 1, [3.0, 4.0]), (1240, 2, [0.0, 0.0]), (1260, None, [1.0]), (None, 1, [1.0, 1.0]), (1280, 1, None), (1300, 1, [1.0, None])]
    rows += [(1320, 0, [float("inf"), 1.0]), (1341, 1, [float("nan")] * 6), (1361, 0, [1e-160, 2e-160]), (1380, 1, [1e-120, -3e-120, 1e-120]), (1400, 3, [1.0])]
    rows += [(1420, 4, [1.0, 0.0]), *[(1421 + i, 4, [0.00005 + i * 1e-17, 1.0]) for i in range(12)]]
    got = nearest_of_label(spark.createDataFrame(rows, VECTOR), 20, 5, shard, block).collect()
    found = {(r.query_id, r.vec_id, None if math.isnan(r.cosine) else r.cosine + 0.0, r.place) for r in got}
    assert found == plain(rows, 20, 5) and len(got) == len(found)


def test_pairs_do_not_become_rows(spark):
    """What a task gives is a few rows a query, not one for each vector of its label."""
    rng = random.Random(2)
    rows = [(i, 0, [rng.gauss(0, 1) for _ in range(4)]) for i in range(2000)]
    near = nearest_of_label(spark.createDataFrame(rows, VECTOR), 20, 5)
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan
