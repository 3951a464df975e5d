"""Association of labels and members, and ruled tables, against plain Python and hand-made sheets."""

import math
import random

import pytest

from beamline.operators import association as a
from beamline.operators import tables as t

LABEL, MEMBER, LEADER = "page long, label string, px double, py double, place string", "page long, member string, length double, x0 double, y0 double, x1 double, y1 double", "page long, leader string, x0 double, y0 double, x1 double, y1 double"


def far(px, py, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    k = 0.0 if n == 0 else max(0.0, min(1.0, ((px - x0) * dx + (py - y0) * dy) / n))
    return math.hypot(px - x0 - k * dx, py - y0 - k * dy)


def plain(labels, members, leaders):
    """Labels in order; nearest leader's ends first, then the label's place; each member once; then farther for what is left."""

    def look(page, points, pool, reach):
        best = {}
        for px, py in points:
            for p, m, length, *s in pool:
                d = far(px, py, *s)
                if p == page and d <= reach:
                    best[m] = min(best.get(m, (d, -length, m)), (d, -length, m))
        return sorted(best.values())

    def found(page, px, py):
        near = sorted((far(px, py, *s), name, s) for p, name, *s in leaders if p == page)
        if near and near[0][0] <= a.REACH:
            s = near[0][2]
            tip = look(page, [(s[0], s[1]), (s[2], s[3])], members, a.TIP_REACH)
            if tip:
                return "leader_tip_to_stroke", tip
        return "proximity_stroke", look(page, [(px, py)], members, a.REACH)

    taken, out, left = set(), {}, []
    order = sorted(labels, key=lambda x: (x[0], x[4], x[1]))

    def claim(page, label, stage, method, rows, again):
        free = [r for r in rows if (page, r[2]) not in taken]
        if not free:
            out[page, label] = (None, None, None, None, "member_already_claimed" if rows else "no_stroke_in_range")
            again.append((page, label))
        elif len(free) > 1 and free[1][0] - free[0][0] <= a.MARGIN:
            out[page, label] = (None, None, None, None, "ambiguous_members")
        else:
            taken.add((page, free[0][2]))
            out[page, label] = (stage, method, free[0][2], round(free[0][0], 3), None)

    for page, label, px, py, _ in order:
        if px is None:
            out[page, label] = (None, None, None, None, "missing_text_bbox")
        elif not any(m[0] == page for m in members):
            out[page, label] = (None, None, None, None, "no_member_candidates")
        else:
            claim(page, label, "primary", *found(page, px, py), left)
    free = [m for m in members if (m[0], m[1]) not in taken]
    for page, label, px, py, _ in order:
        if (page, label) in left:
            was = out[page, label]
            claim(page, label, "recovery", "proximity_stroke", look(page, [(px, py)], free, a.FARTHER * a.REACH), [])
            if out[page, label][4] == "no_stroke_in_range":
                out[page, label] = was
    return out


@pytest.mark.parametrize("seed", range(2))
def test_association(spark, seed):
    rng = random.Random(seed)
    at = lambda: float(rng.randrange(700))
    labels = [(p, f"l{i}", at(), at(), f"{rng.randrange(50):02}") for p in (1, 2) for i in range(25)] + [(1, "lost", None, None, "0"), (9, "alone", 5.0, 5.0, "0")]
    members = []
    for p in (1, 2):
        for i in range(22):
            x, y, n = at(), at(), float(rng.choice([0, 40, 90]))
            members.append((p, f"m{i}", n, x, y, x + n, y))
    leaders = [(p, f"d{i}", at(), at(), at(), at()) for p in (1, 2) for i in range(3)]
    got = a.associated(spark.createDataFrame(labels, LABEL), spark.createDataFrame(members, MEMBER), spark.createDataFrame(leaders, LEADER)).collect()
    want = plain(labels, members, leaders)
    assert {(r.page, r.label): (r.stage, r.method, r.member, r.distance, r.reason) for r in got} == want and len(got) == len(labels)
    claims = [(r.page, r.member) for r in got if r.member]
    assert len(claims) == len(set(claims)) and {v[0] for v in want.values()} >= {"primary", "recovery"}
    assert all((r.confidence is None) == (r.member is None) and (r.member is None or 0.35 <= r.confidence <= 0.95) for r in got)


def test_claims_run_as_one_stream_of_pages(spark):
    """Many small pages are no groups of their own, no rounds of components are run, and a page's claims end with it."""
    found = spark.createDataFrame([(p, f"l{i}", "m", f"s{j}", 5, 20.0 * abs(i - j)) for p in range(300) for i in range(3) for j in range(2)], "page long, label string, method string, member string, length long, d double")
    got = a.claimed(found, found.selectExpr("page", "label", "label as place").distinct())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    rows = {(r.page, r.label): (r.member, r.d, r.reason) for r in got.collect()}
    want = {"l0": ("s0", 0.0, None), "l1": ("s1", 0.0, None), "l2": (None, None, "member_already_claimed")}
    assert rows.keys() == {(p, x) for p in range(300) for x in want}
    assert all((m, None if d is None or d != d else d, why) == want[x] for (_, x), (m, d, why) in rows.items())


def test_association_of_nothing(spark):
    none = [spark.createDataFrame([], s) for s in (LABEL, MEMBER, LEADER)]
    assert a.associated(*none).count() == 0
    one = spark.createDataFrame([(1, "l", 0.0, 0.0, "a")], LABEL)
    assert a.associated(one, none[1], none[2]).collect()[0].reason == "no_member_candidates"


def test_overlapping_regions_are_one(spark):
    rows = [(1, 0, 0, 100, 100), (1, 90, 90, 400, 400), (1, 390, 10, 420, 95), (1, 500, 500, 600, 600), (1, 600, 500, 700, 600), (2, 0, 0, 100, 100)]
    got = sorted(map(tuple, t.merged_regions(spark.createDataFrame(rows, "page long, x0 long, y0 long, x1 long, y1 long")).collect()))
    # The joined box of the first two meets the third only once they are joined.
    assert got == [(1, 0, 0, 420, 400, 1), (1, 500, 500, 600, 600, 2), (1, 600, 500, 700, 600, 3), (2, 0, 0, 100, 100, 1)]


def sheet(spark, rows, extra=()):
    """A table of 3 columns 100 wide and rows 20 high; each cell's words lie side by side."""
    lines = [(1, "vertical", x, 0, 20 * len(rows)) for x in (0, 100, 200, 300)] + [(1, "horizontal", 20 * y, 0, 300) for y in range(len(rows) + 1)]
    lines += [(1, "vertical", 101, 0, 20 * len(rows)), (1, "vertical", 150, 0, 15), (2, "vertical", 50, 0, 100)]
    words = [(1, f"{y}.{x}.{i}", w, 100.0 * x + 20 + 20 * i, 20.0 * y + 10) for y, row in enumerate(rows) for x, cell in enumerate(row) for i, w in enumerate(cell.split())] + list(extra)
    regions = spark.createDataFrame([(1, 1, 0, 0, 300, 20 * len(rows))], "page long, region int, x0 long, y0 long, x1 long, y1 long")
    return t.cells(regions, spark.createDataFrame(lines, "page long, orientation string, at long, lo long, hi long"), spark.createDataFrame(words, "page long, word string, text string, px double, py double"))


def test_cells_headings_and_rows(spark):
    rows = [["STEEL", "", ""], ["GROUP", "BEAMS", ""], ["MARK", "SIZE", "REMARKS"], ["B1", "W12X26", "see plan"], ["B2", "", ""], ["", "W8X10", ""], ["", "", "none"]]
    extra = [(1, "copy", "B1", 20.0, 70.0), (1, "outside", "Z", 500.0, 70.0), (1, "null", None, 20.0, 70.0), (2, "other page", "Y", 10.0, 10.0)]
    table = sheet(spark, rows, extra)
    got = {(r.row, r.col): r.text for r in table.collect()}
    assert got == {(y + 1, x + 1): " ".join(c.split()) for y, row in enumerate(rows) for x, c in enumerate(row) if c}
    heads = {r.col: (r["head"], r.path, r.role) for r in t.headings(table).collect()}
    assert heads == {1: (3, "STEEL > GROUP > MARK", "mark"), 2: (3, "STEEL > BEAMS > SIZE", "size"), 3: (3, "STEEL > BEAMS > REMARKS", "other")}
    assert {r.row: (r.mark, r["size"], r.status) for r in t.grid_rows(table).collect()} == {4: ("B1", "W12X26", "read"), 5: ("B2", None, "no_size"), 6: (None, "W8X10", "no_mark"), 7: (None, None, "empty")}


def test_cells_of_several_regions_by_brute_force(spark):
    """Words on lines, copies of words, and regions that share a page."""
    rng = random.Random(9)
    regions = [(p, r, 100 * r, 0, 100 * r + 90, 90) for p in (1, 2) for r in (0, 1, 2)]
    lines = [(p, way, at, 0, 300 if way == "horizontal" else 90) for p in (1, 2) for way, most in (("horizontal", 90), ("vertical", 290)) for at in rng.sample(range(0, most, 4), 12)]
    words = [(rng.choice((1, 2, 3)), f"w{i:03}", rng.choice("ABC"), rng.randrange(0, 300, 2) / 1.0, rng.randrange(0, 90, 4) / 1.0) for i in range(400)]
    words += [(p, f"x{w}", text, x, y) for p, w, text, x, y in words[:50]]
    want = {}
    for p, r, x0, y0, x1, y1 in regions:
        ys = sorted({at for q, way, at, lo, hi in lines if q == p and way == "horizontal" and y0 - 2 <= at <= y1 + 2})
        xs = sorted({at for q, way, at, lo, hi in lines if q == p and way == "vertical" and x0 - 2 <= at <= x1 + 2})
        seen = set()
        for q, w, text, x, y in sorted(words, key=lambda v: (v[4], v[3], v[1])):
            row, col = sum(at <= y for at in ys), sum(at <= x for at in xs)
            if q == p and x0 <= x <= x1 and y0 <= y <= y1 and 0 < row < len(ys) and 0 < col < len(xs) and (text, x, y) not in seen:
                seen.add((text, x, y))
                want.setdefault((p, r, row, col), []).append(text)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = t.cells(frame(regions, "page long, region int, x0 long, y0 long, x1 long, y1 long"), frame(lines, "page long, orientation string, at long, lo long, hi long"), frame(words, "page long, word string, text string, px double, py double")).collect()
    assert {(r.page, r.region, r.row, r.col): (r.text, r.words) for r in got} == {k: (" ".join(v), len(v)) for k, v in want.items()} and len(got) == len(want) > 50


def test_tables_without_headings_or_words(spark):
    assert t.grid_rows(sheet(spark, [["a", "b", "c"], ["d", "e", "f"]])).count() == 0
    assert sheet(spark, [["", "", ""]], [(1, "edge", "Z", 300.0, 10.0)]).count() == 0
