"""Queries that take a page whole: one exchange of boxes, and crowded pages dealt by id give the same rows."""

import re

import pytest

from beamline import registry
from beamline.plans import evidence, layout

from . import test_oracles
from .test_oracles import duck  # noqa: F401

registry.load()
QUERIES = ["windowed_pairs", "baseline_groups", "collinear_axes"]


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]


@pytest.mark.parametrize("name", QUERIES)
def test_a_page_is_read_where_its_boxes_are(spark, sf_dir, name):
    rows = registry.QUERIES[name](spark, sf_dir)
    rows.collect()
    assert len(exchanges(rows)) == 1


def test_cells_are_read_by_page_alone_and_once(spark, sf_dir):
    cells, rows = (registry.QUERIES[name](spark, sf_dir) for name in ("table_cells", "grid_rows"))
    cells.collect(), rows.collect()
    assert exchanges(cells) and all(re.search(r"hashpartitioning\((page|p_partkey)#\d+L?, \d+\)", x) for x in exchanges(cells))
    assert "l_orderkey" not in rows._jdf.queryExecution().executedPlan().toString()


def test_boxes_without_a_page_meet_none(spark, monkeypatch):
    rows = [(f"{i}", page, 0, 0, 2, 2, 2, 2) for page in (1, None) for i in range(3)]
    monkeypatch.setattr(evidence, "_paged", lambda *_: [spark.createDataFrame(rows, "box string, page long, x0 long, y0 long, x1 long, y1 long, cx long, cy long")])
    assert sorted(map(tuple, evidence.windowed_pairs(spark, "").collect())) == [(1, "0", "1"), (1, "0", "2"), (1, "1", "2")]


@pytest.mark.parametrize("most", [0, 90])
@pytest.mark.parametrize("name", [*QUERIES, "table_cells", "grid_rows"])
def test_crowded_pages(spark, duck, sf_dir, monkeypatch, name, most):  # noqa: F811
    monkeypatch.setattr(layout, "PAGE_ROWS", most)
    assert len(layout._paged(spark, sf_dir)) == 2
    test_oracles.test_query_matches_sql(spark, duck, sf_dir, name)
