from collections import defaultdict

import pytest

from beamline.llm.mixing import mix

from .conftest import ROWS, words


def targets(rows, weights=(5, 2, 1), cap=3):
    size = defaultdict(int)
    for _, t, _, s, *_ in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(cap * size[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * size[s]}
        if not over:
            return size, {s: cap * size[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_edge_cases(request, table):
    got = mix(request.getfixturevalue(table)).collect()
    size, want = targets(ROWS)
    assert len(got) == len(ROWS)
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in ROWS)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 3 * r["size"]


def test_taken_words_come_near_targets(small):
    frame, rows = small
    got = mix(frame, block=8).collect()
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    size, want = targets([(r.doc_id, r.text, r.lang, r.source) for r in rows])
    for s in want:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(frame, block=8).collect()))


def test_expectation_is_unbiased(spark):
    """Over many ids of one size, copies average to target over size."""
    frame = spark.createDataFrame([(i, "one two three" if i % 2 else "one two three four five", None, "ab"[i % 3 == 0], 0) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    by = defaultdict(lambda: [0, 0])
    for r in mix(frame).collect():
        by[r.source, r["size"]][0] += r.copies
        by[r.source, r["size"]][1] += 1
        p = r.target / r.source_size
        by[r.source, r["size"]].append(p) if len(by[r.source, r["size"]]) == 2 else None
    for copies, n, p in by.values():
        assert abs(copies / n - p) < 0.08


def test_empty(no_docs):
    assert mix(no_docs).count() == 0
