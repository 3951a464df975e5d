"""Families, similar labels and scales against plain Python."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from beamline.operators import classify, fuzzy
from beamline.plans.inference import document_prior, family_classifier


def test_family_classifier_on_held_out_labels(spark, sf_dir):
    rows = family_classifier(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/part.parquet").count() and len(held) > 100
    assert sum(r.predicted == r.family for r in held) / len(held) >= 0.9
    assert all(0 < r.probability <= 1 for r in rows)


def test_classifier_takes_any_token(spark):
    train = spark.createDataFrame([(f"W{i}X{i % 9}", "W") for i in range(40)] + [(f"HP{i}X{i % 9}", "HP") for i in range(40)], "t string, f string")
    model = classify.family_model(train, "t", "f")
    odd = spark.createDataFrame([("W99X1",), ("hp7x7",), (None,), ("",), ("日本 " * 3000,)], "t string")
    got = [r.predicted for r in classify.predicted(model, odd, "t").collect()]
    assert got[:2] == ["W", "HP"] and set(got) <= {"W", "HP"}


def plain(token, labels, most, least, bonus, letters):
    begin = lambda x: "".join(c for c in x if c.isalpha())[:3] if letters else x[:3]
    scored = []
    for label in labels:
        more = bonus if begin(token) == begin(label) and (begin(token) or not letters) else 0.0
        score = min(1.0, SequenceMatcher(None, token, label, autojunk=False).ratio() + more)
        if score >= least:
            scored.append((-round(score, 4), label))
    return [(label, -s) for s, label in sorted(scored)[:most]]


def test_similar_labels(spark):
    labels = [f"{f}{d}X{w}" for f in ("W", "WT", "HP", "MC") for d in (8, 10, 12) for w in (5, 26, 58)] + ["123", "8X8"]
    tokens = ["W12X2", "1W2X26", "HP10X58", "123X", "X", "", "WT1OX26", "8X8X"]
    frame = lambda name, v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    for most, least, bonus, letters in ((10, 0.55, 0.0, False), (5, 0.45, 0.08, True), (3, 0.55, 0.08, False)):
        got = {}
        for r in fuzzy.ratio_search(frame("norm", tokens), frame("label", labels), most, least, 7, bonus, letters).collect():
            got.setdefault(r.norm, []).append((r.label, r.ratio))
        for t in tokens:
            assert sorted(got.get(t, []), key=lambda x: (-x[1], x[0])) == plain(t, labels, most, least, bonus, letters), t


def test_priors_raise_and_never_lower(spark, sf_dir):
    rows = document_prior(spark, sf_dir)
    given = rows.select("boost", "confidence", "section_rows").agg(F.min("boost"), F.max("boost"), F.max(F.when(F.col("section_rows") < 2, F.col("boost")))).first()
    assert given[0] == 0 and given[1] <= 0.09 and given[2] <= 0.03
