"""What SQL does not express, against plain Python."""

import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from beamline.functions.labels import REPAIRS, repaired
from beamline.operators import fuzzy
from beamline.operators.folds import longest_matches, merge_duplicates
from beamline.operators.graph import greedy_assignment
from beamline.sources.files import catalog_faults, read_csv_text

LABELS = ["W24X57", "W24X55", "W12X26", "WT7X21", "HP12X53", "C10X20", "MC8X20", "M12X10", "W8X10", "WT24X57", ""]
TOKENS = ["W24X5", "W24XS7", "Q" "W12X26", "24X57", "HPI2X53", "ZZZ", "", "W", "c10x20", "WT24X57"]


def test_ratio_search(spark):
    tokens, labels = (spark.createDataFrame([(x,) for x in rows], f"{name} string") for rows, name in ((TOKENS * 2, "norm"), (LABELS, "label")))
    for block in (100, 3):
        got = defaultdict(list)
        for r in fuzzy.ratio_search(tokens, labels, most=3, least=0.45, block=block).collect():
            got[r.norm].append((-r.ratio, r.label))
        for token in TOKENS:
            ratios = [(-round(min(1.0, SequenceMatcher(None, token, x, autojunk=False).ratio() + (0.08 if token[:3] == x[:3] else 0)), 4), x) for x in LABELS]
            assert sorted(got[token]) == sorted(r for r in ratios if r[0] <= -0.45)[:3], token


def weighted(a, b):
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.5 if fuzzy.CONFUSED.get(x) == y else 1.0
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + cost))
        row = new
    return row[-1]


def test_weighted_edits(spark):
    pairs = [(a, b) for a in TOKENS + ["B0S", "80S"] for b in LABELS + ["8OS", "BO5"]]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.weighted_edits(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in got] == [(a, b, weighted(a, b)) for a, b in pairs]


def test_longest_matches(spark):
    rng = random.Random(1)
    spans = [(k % 3, f"s{k:03}", lo := rng.randrange(60), lo + rng.randrange(9)) for k in range(120)]
    got = {(r.line, r.id) for r in longest_matches(spark.createDataFrame(spans, "line int, id string, lo int, hi int"), ["line"], "lo", "hi", "id").collect()}
    want = set()
    for line in range(3):
        kept = []
        for _, lo, name, hi in sorted((lo - hi, lo, name, hi) for n, name, lo, hi in spans if n == line):
            if all(hi < a or b < lo for a, b in kept):
                kept.append((lo, hi))
                want.add((line, name))
    assert got == want


def test_merge_duplicates(spark):
    rng = random.Random(2)
    rows = [(k, k % 4, x := rng.randrange(6), y := rng.randrange(6), x + 8 + rng.randrange(3), y + 8 + rng.randrange(3), rng.choice([0.5, 0.7, 0.9])) for k in range(80)]
    frame = spark.createDataFrame([(f"b{k}", k, page, x0, y0, x1, y1, c) for k, page, x0, y0, x1, y1, c in rows], "id string, k long, page long, x0 long, y0 long, x1 long, y1 long, confidence double")
    got = {(r.page, r.id, r.merged) for r in merge_duplicates(frame, ["page"], ["k"]).collect()}
    want = set()
    for page in range(4):
        kept = []
        for k, p, x0, y0, x1, y1, c in rows:
            if p != page:
                continue
            for s in kept:
                a0, b0, a1, b1 = s["box"]
                common = max(0, min(x1, a1) - max(x0, a0)) * max(0, min(y1, b1) - max(y0, b0))
                if common and 100 * common >= 60 * ((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - common):
                    s["n"] += 1
                    if c > s["c"]:
                        s.update(id=f"b{k}", box=(x0, y0, x1, y1), c=c)
                    break
            else:
                kept.append({"id": f"b{k}", "box": (x0, y0, x1, y1), "c": c, "n": 1})
        want |= {(page, s["id"], s["n"]) for s in kept}
    assert got == want


def test_greedy_assignment(spark):
    rng = random.Random(3)
    at = [(page, f"b{k:02}", rng.randrange(60), rng.randrange(60)) for page in range(3) for k in range(25)]
    pairs = [(p, a, b, (x - u) ** 2 + (y - v) ** 2) for p, a, x, y in at for q, b, u, v in at if p == q and a < b and (x - u) ** 2 + (y - v) ** 2 <= 900]
    got = {(r.page, r.box, r.box_b) for r in greedy_assignment(spark.createDataFrame(pairs, "page int, box string, box_b string, d2 int"), 4).collect()}
    near = defaultdict(list)
    for p, a, b, d in pairs:
        near[p, a].append(d)
        near[p, b].append(d)
    torn = {k for k, d in near.items() if len(d) > 1 and sorted(d)[1] - sorted(d)[0] < 4}
    taken, want = set(torn), set()
    for d, p, a, b in sorted((d, p, a, b) for p, a, b, d in pairs):
        if (p, a) not in taken and (p, b) not in taken:
            taken |= {(p, a), (p, b)}
            want.add((p, a, b))
    assert got == want and want and torn
    assert greedy_assignment(spark.createDataFrame([], "page int, box string, box_b string, d2 int"), 4).count() == 0


def test_repaired(spark):
    texts = ["W24 x 57", "W24×S7", "WO5", "1O5", "1I5 2|3", "3 / 4", "a\u00a0b  c\t", "1–2—3", "", "OO7", "Hss8✕8"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in texts], "t string").select(repaired(F.col("t")).alias("v")).collect()]
    for text, value in zip(texts, got):
        for pattern, put in REPAIRS:
            text = re.sub(pattern, put, text)
        assert value == text.strip()
    assert got[:5] == ["W24X57", "W24XS7", "W05", "105", "115 213"]


def test_csv_as_text(spark, tmp_path):
    (tmp_path / "c.csv").write_text('label,type\nW1X2,a\nW1X2,b\n,c\nnone,\n"W3,4",a\n')
    rows = read_csv_text(spark, f"file://{tmp_path}/c.csv", ["label", "type"])
    assert [t for _, t in rows.dtypes] == ["string", "string"] and rows.count() == 5
    assert {r.fault: r.n for r in catalog_faults(rows, "label", "type").collect()} == {"blank_label": 1, "blank_type": 1, "no_digit": 1, "repeated": 1, "conflicting": 1}
    assert read_csv_text(spark, f"file://{tmp_path}/none.csv", ["label", "type"]).collect() == []
