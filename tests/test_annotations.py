"""Annotations from pieces, block edges, matches by place and merged ids, against plain Python."""

import random
import re

import pytest

from beamline.operators import annotations as a
from beamline.operators.folds import merge_duplicates, merge_ids

PIECE = "page long, piece string, text string, x0 double, y0 double, x1 double, y1 double, font double, rotation double, label string"


def joined(rows):
    """Pieces in reading order: a chain, then at most one tag behind it."""
    out = []
    for p in sorted(rows, key=lambda r: (r[0], r[4], r[3], r[1])):
        tag = re.fullmatch(r"\[([^\[\]]+)\]", (p[2] or "").strip())
        last = out[-1] if out else None
        if last and last["open"]:
            q = last["rows"][-1]
            size = lambda r: r[7] or 10.0
            near = q[0] == p[0] and abs((q[8] or 0) - (p[8] or 0)) <= 1 and abs((q[4] + q[6]) / 2 - (p[4] + p[6]) / 2) <= 0.4 * max(size(p), size(q)) and 0 <= p[3] - q[5] <= 1.5 * size(q)
            if near:
                last["rows"].append(p)
                if tag:
                    last["modifier"], last["open"] = tag[1], False
                continue
        out.append({"rows": [p], "modifier": None, "open": True})
    return sorted((g["rows"][0][0], g["rows"][0][1], len(g["rows"]), "".join(r[2] or "" for r in g["rows"][: len(g["rows"]) - (g["modifier"] is not None)]).strip(), g["modifier"] or "") for g in out)


@pytest.mark.parametrize("seed, block", [(1, 1 << 16), (2, 7)])
def test_baseline_groups(spark, monkeypatch, seed, block):
    """Also where marks are carried over many blocks."""
    monkeypatch.setattr(a, "BLOCK", block)
    rng, rows = random.Random(seed), []
    for page in (1, 2):
        for line in range(25):
            x = 0.0
            for k in range(rng.randrange(1, 12)):
                x += rng.choice([-2.0, 0.0, 3.0, 14.0, 16.0])
                text = rng.choice(["W", "12", "X", "[4]", "[ 5 ]", " [6] ", None, "[7", "[]"])
                rows.append((page, f"{page}-{line}-{k:02}", text, x, line * 30.0, x + 6, line * 30.0 + rng.choice([8, 10]), rng.choice([None, 0.0, 10.0, 12.0]), rng.choice([None, 0.0, 0.0, 0.0, 90.0]), "clash"))
                x += 6
    got = sorted((r.page, r.piece, r.n, r.label, r.modifier or "") for r in a.baseline_groups(spark.createDataFrame(rows, PIECE)).collect())
    assert got == joined(rows)
    assert sum(bool(m) for *_, m in got) > 10


@pytest.mark.parametrize("seed", [3, 4])
def test_baseline_groups_of_whole_pages(spark, seed):
    """Pages read one by one, with and without lines that go on in the next, give what the table's order gives."""
    rng = random.Random(seed)
    rows = [(p, f"{p}-{i:03}", rng.choice(["W", "[4]", "[ 5 ]", None, "[7"]), x, y, x + 6, y + 8.0, rng.choice([None, 10.0, 40.0]), rng.choice([None, 0.0, 0.0, 90.0]), "") for p in (1, 2, 3) for i, (x, y) in enumerate(sorted(((rng.randrange(30) * 7.0, rng.randrange(6) * 9.0) for _ in range(90)), key=lambda s: (s[1], s[0])))]
    rows += [(None, "lost", "W", 0.0, 0.0, 1.0, 1.0, None, None, "")]
    frame = spark.createDataFrame(rows, PIECE)
    got, want = (sorted(map(repr, a.baseline_groups(frame, whole).collect())) for whole in (True, False))
    assert got == want and any("same_baseline_merge,bracket" in r for r in got)


def test_pieces_print_their_spaces(spark):
    rows = [(1, "a", "W", 0.0, 0.0, 8.0, 10.0, 10.0, 0.0, ""), (1, "b", "8", 9.0, 0.0, 15.0, 10.0, 10.0, 0.0, ""), (1, "c", "X10", 20.0, 0.0, 35.0, 10.0, 10.0, 0.0, ""), (1, "d", "[24]", 40.0, 0.0, 50.0, 10.0, 10.0, 0.0, ""), (None, "e", "W", 0.0, 0.0, 1.0, 1.0, None, None, "")]
    got = a.baseline_groups(spark.createDataFrame(rows, PIECE)).collect()
    assert [(r.label, r.original, r.modifier, r.reasons, r.x1) for r in got] == [("W8X10", "W8 X10 [24]", "24", "same_baseline_merge,bracket_modifier_attachment", 50.0)]
    assert a.baseline_groups(spark.createDataFrame([], PIECE)).collect() == []


def test_contiguous_edge(spark):
    rng = random.Random(5)
    points = [(p, float(rng.randrange(1000))) for p in range(40) for _ in range(rng.randrange(0, 60))] + [(3, None)]
    anchors = [(p, None if p % 3 == 0 else float(rng.randrange(300, 1000)), rng.choice([10.0, 30.5, 80.0])) for p in range(42)]
    want = {}
    for p, start, gap in anchors:
        values = {v for q, v in points if q == p and v is not None}
        edge = max(values, default=None) if start is None else start
        for v in sorted((v for v in values if edge is not None and v < edge), reverse=True):
            if edge - v > gap:
                break
            edge = v
        if edge is not None:
            want[p] = edge
    got = a.contiguous_edge(spark.createDataFrame(points, "page long, value double"), spark.createDataFrame(anchors, "page long, anchor double, gap double"), "page")
    assert {r.page: r.edge for r in got.collect()} == want


def test_nearest_record(spark):
    rng = random.Random(6)
    asked = [(rng.randrange(3), i, rng.randrange(600), rng.randrange(600)) for i in range(120)]
    known = [(rng.randrange(3), i, ("mutation", "clean_control")[i % 2], i % 2, rng.randrange(0, 600, 10), rng.randrange(0, 600, 10)) for i in range(300)] + [(None, 999, "mutation", 0, 1, 1), (1, 998, "mutation", 0, None, 1)]
    want = {}
    for p, i, x, y in asked:
        near = [((x - u) ** 2 + (y - v) ** 2, t, r, k) for q, r, k, t, u, v in known if q == p and u is not None]
        if near and min(near)[0] <= 4 * 40 * 40:
            want[i] = min(near)
    got = a.nearest_record(spark.createDataFrame(asked, "page long, annotation long, cx long, cy long"), spark.createDataFrame(known, "page long, record long, kind string, turn int, cx long, cy long"), 40)
    assert {r.annotation: (r.d2, {"mutation": 0, "clean_control": 1}[r.kind], r.record, r.kind) for r in got.collect()} == want
    assert want


def test_ids_are_one_wherever_they_lie(spark):
    rows = [(1, "A", "i", 0, 0, 10, 10, 0.5, 1), (2, "A", "i", 500, 0, 510, 10, 0.9, 2), (2, "A", "j", 501, 0, 511, 10, 0.4, 3), (2, "B", "k", 501, 0, 511, 10, 0.4, 4), (2, "A", "l", 900, 0, 910, 10, None, 5), (2, "A", None, 700, 0, 710, 10, 0.1, 6), (2, "A", None, 800, 0, 810, 10, 0.1, 7)]
    frame = spark.createDataFrame(rows, "page long, label string, id string, x0 long, y0 long, x1 long, y1 long, confidence double, k long")
    once = merge_ids(frame, "id", ["k"])
    got = sorted((r.label, r.id or "", r.merged) for r in merge_duplicates(once, ["page", "label"], ["k"]).collect())
    assert got == [("A", "", 1), ("A", "", 1), ("A", "i", 3), ("A", "l", 1), ("B", "k", 1)]
