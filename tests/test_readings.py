"""Axes and levels of small drawings, and cut-off JSON, against plain Python."""

import json
from itertools import product

import pytest

from beamline.functions.labels import closed_json


WHOLE = json.dumps({"a": [1, {"b": 'x"}]\\'}, "é 𝄞"], "c": {"d": []}, "e": "{["})


def readings(text: str) -> list:
    """What the text can be read as, once a quote or none and up to three brackets are put behind it."""
    found = []
    for n in range(4):
        for quote, *tail in product(["", '"'], *["]}"] * n):
            try:
                found.append(json.loads((text if quote else text.rstrip().removesuffix(",")) + quote + "".join(tail)))
            except ValueError:
                pass
    return found


def test_closed_json(spark):
    texts = [WHOLE[:n] for n in range(1, len(WHOLE) + 1)] + ["[1, ", '{"a":1,', "]}", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(frame.select("i", closed_json(frame["t"])).collect())
    readable = 0
    for i, t in enumerate(texts):
        wanted = readings(t) if t else []
        if wanted:
            readable += 1
            assert json.loads(got[i]) in wanted, t
    assert readable > 20 and got[len(texts) - 1] is None and got[len(texts) - 2] == "" and got[len(texts) - 3] == "]}"
    assert json.loads(got[len(WHOLE) - 1]) == json.loads(WHOLE)


@pytest.fixture
def drawn(spark, tmp_path):
    """A page of two dashed lines that cross, a mark near the crossing, one far away, and two levels."""
    rows = []

    def box(part, x, y, w, h):
        # The stand-in boxes: x from the price, y from the quantity, sides from discount and tax.
        rows.append((1, part, 1, 1, y / 20, float(x), (w - 5) / 100, (h - 5) / 100))

    for i, x in enumerate((0, 40, 80)):
        box(10 + i, x, 100, 12, 5)
    for i, y in enumerate((60, 100, 140)):
        box(20 + i, 60, y, 5, 11)
    box(30, 60, 100, 14, 13)
    box(31, 900, 900, 14, 13)
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_axes_levels_and_marks(spark, drawn):
    from beamline.plans import drawing

    axes = {(r["orientation"], r["lo"], r["hi"], r["pieces"]) for r in drawing.collinear_axes(spark, drawn).collect()}
    assert ("horizontal", 0, 92, 3) in axes or ("horizontal", 0, 92, 4) in axes
    assert ("vertical", 60, 151, 3) in axes
    marks = {r["box"]: r["status"] for r in drawing.mark_allocation(spark, drawn).collect()}
    assert marks == {"1-30": "confirmed", "1-31": "unresolved"}
    ends = {r["box"]: (r["position"], r["line"]) for r in drawing.level_bands(spark, drawn).collect()}
    assert ends["1-10"] == ("between", 100) and ends["1-20"][0] == "above" and ends["1-22"] == ("between", 100)
