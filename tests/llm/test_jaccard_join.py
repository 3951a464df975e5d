import random

import pytest

from beamline.llm.components import components
from beamline.llm.jaccard_join import jaccard_components, one_of_each

from .conftest import ROWS, words

SCHEMA = "doc_id long, text string"


def grams(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, n, percent):
    sets = [grams(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), low.get(root(i), -1)) for i, (d, *_) in enumerate(rows))


def found(frame, n, percent):
    low = lambda x: -1 if x is None else x
    return sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in jaccard_components(frame, n, percent).collect())


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_edge_cases(request, table):
    assert found(request.getfixturevalue(table), 3, 90) == brute(ROWS, 3, 90)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(0, edits)):
            w[rng.randrange(len(w))] = rng.choice("abcdef") * 3
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n, percent", [(5, 80), (2, 60)])
def test_large_group_of_near_copies(spark, n, percent):
    """Most pairs share n-grams, some link only through others, and one n-gram is in every text."""
    rng = random.Random(7)
    bases = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) + " and so on for all of them" for _ in range(4)]
    rows = list(enumerate([t for b in bases for t in near_copies(rng, b, 120, 5)]))
    assert found(spark.createDataFrame(rows, SCHEMA), n, percent) == brute(rows, n, percent)


def test_one_of_each_keeps_columns(clashing):
    got = one_of_each(clashing, 3, 90)
    assert got.columns == clashing.columns
    assert {r.doc_id for r in got.collect()} == {d for d, _, c in brute(ROWS, 3, 90) if d == c and d != -1} | {None}


def test_rows_that_share_an_id_are_told_apart(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(1, base), (2, base + " end"), (2, "something else altogether in here now"), (3, None), (3, ""), (None, base)]
    got = one_of_each(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in got) == [(1, base), (2, rows[2][1]), (3, ""), (3, "")]


def test_pairs_that_fail_never_end_the_search(spark):
    """Texts that share rare n-grams but do not link stand between those that do."""
    rng = random.Random(3)
    head = " ".join(f"h{i}" for i in range(12))
    rows = []
    for k in range(40):
        own = [f"k{k}x{i}" for i in range(60)]
        for c in range(6):
            w = own.copy()
            w[rng.randrange(60)] = f"edit{c}"
            rows.append((len(rows), head + " " + " ".join(w)))
    assert found(spark.createDataFrame(rows, SCHEMA), 3, 70) == brute(rows, 3, 70)


def test_empty(no_docs):
    assert jaccard_components(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (6000, 6000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {5000: 5000, 5001: 5000}
    assert got == want


def test_many_rows_without_an_id(spark):
    """Rows of one id, or of none, are told apart by their texts, so no text meets all others."""
    rows = []
    for i in range(2500):
        own = [f"t{i}w{k}" for k in range(60)]
        rows += [(None if i % 2 else 7, " ".join(own)), (None if i % 2 else 7, " ".join([*own[:-1], "end"]))]
    got = found(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert len(got) == 5000 and {c for _, _, c in got} == {-1, 7}
