"""Masks against labels: by brute force, and through joins whose rows follow the answers."""

import random
import re

import pytest

from beamline.operators import candidates, fuzzy
from beamline.plans.matching import field_any
from beamline.plans.more import field_compatible
from beamline.plans.rules import mask_reasons


def test_masks_meet_labels_as_by_brute_force(spark):
    draw = random.Random(3)
    labels = sorted({f"{draw.choice(['W', 'WT', 'M', 'MC'])}{draw.randint(1, 50)}X{draw.randint(0, 99)}" for _ in range(400)})
    family = lambda t: (re.match("WT|HP|MC|W|M|C", t) or [""])[0]
    texts = [x if draw.random() < 0.2 else "".join("*" if draw.random() < 0.3 else c for c in x) for x in labels] + ["W**X**", "W*****", "*", "", None]
    prints = [(i, t if draw.random() < 0.5 or t is None else t.lower()) for i, t in enumerate(texts)]
    prints += [(1, "W1*X5*"), (1, "W**X**"), (None, "W2*X**"), (None, "W3*X**")]  # keys that repeat are ranked over all their rows
    asked = spark.createDataFrame(prints, "p_partkey int, printed string")
    catalog = spark.createDataFrame([(x, family(x)) for x in labels], "label string, family string")
    want = []
    for key in {k for k, _ in prints}:
        hits = []
        for norm in [t.upper() for k, t in prints if k == key and t is not None and "*" in t]:
            hits += [(x, norm) for x in labels if family(x) == family(norm) and re.fullmatch(norm.replace("*", "."), x)]
        want += [(key, x, n) for n, (x, _) in enumerate(sorted(hits)[:8], 1)]
    got = [(r.p_partkey, r.label, r.place) for r in candidates.wildcard(asked, catalog).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and want


@pytest.mark.parametrize("query", [field_compatible, mask_reasons, field_any])
def test_repeated_parts_make_no_pairs_on_the_way(spark, tmp_path, query):
    """Four times the parts: no join may make more rows than a few for each part and its answers."""
    source = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{source}/part.parquet")
    for i in range(4):
        shifted = parts.withColumn("p_partkey", parts["p_partkey"] + 20_000 * i)
        shifted.coalesce(1).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    got = query(spark, str(tmp_path))
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan()
    made, open_ = [], [plan]
    while open_:
        node = open_.pop()
        inner = {"AdaptiveSparkPlanExec": "executedPlan"}.get(node.getClass().getSimpleName())
        if inner:
            open_.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            open_.append(node.plan())
            continue
        if "Join" in node.nodeName() or node.nodeName() == "Filter":
            made.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert rows and made and " LIKE replace" not in text and " LIKE translate" not in text
    assert max(made) <= 4 * (len(rows) + 4 * parts.count())


@pytest.mark.parametrize("block, part", [(20_000, 4_000), (7, 5)])
def test_nearest_cosines_by_brute_force_without_rows_of_pairs(spark, block, part):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("WX012") for _ in range(draw.randint(2, 6)))
    cut = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    labels, tokens = {word() for _ in range(60)}, {word() for _ in range(40)}
    weight = {g: 1 + 7 * i % 5 for i, g in enumerate(sorted(set().union(*map(cut, labels))))}
    frame = lambda rows, key: spark.createDataFrame([(t, g, float(weight[g])) for t in rows for g in cut(t) if g in weight], f"{key} string, gram string, w double")
    found = fuzzy.nearest_by_cosine(frame(tokens, "norm"), frame(labels, "label"), block, part).collect()
    got, want = {}, {}
    for r in found:
        got[r.norm] = min(got.get(r.norm, (1.0, "")), (-round(r.s / (r.sd * r.sp) ** 0.5, 6), r.label))
    size = lambda grams: sum(weight.get(g, 0) for g in grams)
    for t in tokens:
        hits = [(-round(size(cut(t) & cut(x)) / (size(cut(t)) * size(cut(x))) ** 0.5, 6), x) for x in labels if cut(t) & cut(x)]
        if hits:
            want[t] = min(hits)
    assert got == want and len(found) < len(tokens) * len(labels) / 4
