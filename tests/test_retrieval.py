"""The retrieval index against a brute-force recount, on texts that share a frequent n-gram."""

import random
from collections import Counter
from math import log, sqrt

import pytest

from beamline.operators import retrieval

SCHEMA = "anchor string, token string, target string, source string"


def counted(text):
    return Counter(text[i : i + n] for n in range(2, 7) for i in range(len(text) - n + 1))


def vectors(texts, idf):
    out = {}
    for key, text in texts.items():
        raw = {g: (1 + log(c)) * idf[g] for g, c in counted(text).items() if g in idf}
        length = sqrt(sum(w * w for w in raw.values()))
        out[key] = {g: w / length for g, w in raw.items()}
    return out


def brute(anchors, tokens, most):
    df = Counter(g for t in anchors.values() for g in counted(t))
    idf = {g: log((1 + len(anchors)) / (1 + n)) + 1 for g, n in df.items()}
    lists, asked = vectors(anchors, idf), vectors({t: t for t in tokens}, idf)
    found = set()
    for t, q in asked.items():
        scores = [(round(sum(w * v.get(g, 0.0) for g, w in q.items()), 9), a) for a, v in lists.items() if q.keys() & v.keys()]
        best = sorted(scores, key=lambda x: (-x[0], x[1]))[:most]
        found |= {(t, a, s, i + 1) for i, (s, a) in enumerate(best)}
    return found


@pytest.mark.parametrize("most", [1, 5, 80])
def test_search_misses_no_anchor(spark, most):
    rng = random.Random(7)
    texts = {f"W{rng.randint(4, 44)}X{rng.randint(8, 99)}" for _ in range(150)} | {"ABABABAB", "W1"}
    anchors = {t + "|" + t: t for t in texts}
    tokens = [t[:-1] + "7" for t in sorted(texts)[::5]] + ["ABAB", "QQ", "W", "", None, "W12X50", "W12X50"]
    index = retrieval.build(spark.createDataFrame([(a, t, t, "catalog") for a, t in anchors.items()], SCHEMA))
    got = retrieval.search(index, spark.createDataFrame([(t,) for t in tokens], "norm string"), most).collect()
    want = brute(anchors, {t for t in tokens if t}, most)
    plain = {(r.norm, r.anchor, round(r.score, 8), r.place) for r in got}
    assert len(got) == len(want) and plain == {(t, a, round(s, 8), i) for t, a, s, i in want}
    assert not {r.norm for r in got} & {"QQ", "W", ""}


def test_sources_and_targets(spark):
    rows = lambda *x: spark.createDataFrame(x, "token string, target string")
    sources = [("catalog", rows(("W8X10", "W8X10"), (" ", "W8X10"))), ("pair", rows(("w8x10", "W8X10"), ("W8X1O", "W8X10"))), ("approved", rows(("W8X1O", "W8X10"), (None, "W8X10"), ("W8X1", None)))]
    anchors = retrieval.first_source(sources)
    assert sorted((r.token, r.target, r.source) for r in anchors.collect()) == [("W8X10", "W8X10", "catalog"), ("W8X1O", "W8X10", "pair")]
    index = retrieval.build(anchors)
    pool = retrieval.search(index, spark.createDataFrame([("W8X10",), ("W8X1O",)], "norm string"))
    best = {(r.norm, r.section): r.score for r in retrieval.best_targets(index, pool).collect()}
    assert best[("W8X10", "W8X10")] == 1.0 and set(best) == {("W8X10", "W8X10"), ("W8X1O", "W8X10")}


def test_empty_tables(spark):
    index = retrieval.build(spark.createDataFrame([], SCHEMA))
    assert index.postings.count() == 0
    assert retrieval.search(index, spark.createDataFrame([("W8X10",), (None,)], "norm string")).count() == 0


def test_small_blocks_and_parts_give_the_same_pools_without_rows_of_lists(spark):
    anchors = spark.createDataFrame([(f"W{d}X{w}|{d}{w}", f"W{d}X{w}", f"{d}{w}", "catalog") for d in range(10, 20) for w in range(10, 16)], "anchor string, token string, target string, source string")
    tokens = spark.createDataFrame([(f"W{d}X1{w}",) for d in range(10, 22) for w in "*05"] + [("",), (None,), ("ZZ",)], "norm string")
    index = retrieval.build(anchors)
    whole, cut = (sorted(map(tuple, retrieval.search(index, tokens, 5, block, part).collect())) for block, part in ((1000, 1000), (7, 4)))
    assert whole == cut and len(whole) == 36 * 5
    assert "FlatMapCoGroupsInPandas" in retrieval.search(index, tokens, 5)._jdf.queryExecution().executedPlan().toString()
