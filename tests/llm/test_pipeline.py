from collections import Counter

import corpus_pipeline

from .conftest import ROWS, lowered, words
from .test_jaccard_join import brute


def test_stages_on_real_rows(spark, small):
    frame, rows = small
    docs = frame
    sizes = [frame.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), frame.schema)
        after = docs.collect()
        sizes.append(len(after))
        assert docs.columns == frame.columns
        have = {tuple(r) for r in before}
        assert all(tuple(r) in have for r in after)
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        if name == "exact_copies":
            last = {}
            for r in before:
                last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), -1))
            assert sorted(r.doc_id for r in after) == sorted(last.values())
        if name == "near_copies":
            first = {d for d, _, c in brute([(r.doc_id, r.text) for r in before], 5, 80) if d == c}
            assert {r.doc_id for r in after} == first
        if name == "source_mix":
            copies = Counter(r.doc_id for r in after)
            assert max(copies.values()) <= 3
            total = sum(len(words(r.text)) for r in before)
            assert abs(sum(len(words(r.text)) for r in after) - total) < 0.5 * total
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == sizes[-1] and all(r.round_trip for r in last)


def kept_by(name, rows):
    """Which (id, text) a stage keeps of odd rows, where its rule fixes that; None where it does not."""
    if name == "exact_copies":
        last = {}
        for d, t in rows:
            last[lowered(t or "")] = max(last.get(lowered(t or ""), -1), -1 if d is None else d)
        return sorted((d, t) for t, d in last.items())
    if name == "near_copies":
        return sorted((-1 if d is None else d, lowered(t or "")) for (d, t), (_, _, c) in zip(rows, brute_of_rows(rows)) if (-1 if d is None else d) == c)
    return None


def brute_of_rows(rows):
    """Of each row in turn (id, n-grams, smallest id of its component)."""
    numbered = brute([(i, t) for i, (_, t) in enumerate(rows)], 5, 80)
    ids = {}
    for i, _, c in numbered:
        if rows[i][0] is not None:
            ids[c] = min(ids.get(c, rows[i][0]), rows[i][0])
    return [(rows[i][0], n, ids.get(c, -1)) for i, n, c in numbered]


def test_stages_on_odd_rows(spark, clashing):
    """Each stage alone, over all odd rows, with columns of clashing names."""
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    have = {tuple(r) for r in clashing.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, "")
        assert out.columns == clashing.columns
        got = out.collect()
        assert all(tuple(r) in have for r in got)
        want = kept_by(name, rows)
        if want is not None:
            assert sorted((-1 if r.doc_id is None else r.doc_id, lowered(r.text or "")) for r in got) == want, name
        if name == "language":
            assert {r.doc_id for r in got}.isdisjoint({3, 4, 5}) and {7, 8} <= {r.doc_id for r in got}
        if name == "source_mix":
            assert max(Counter((r.doc_id, r.text) for r in got).values()) <= 6
    out = corpus_pipeline.STAGES[-1][1](spark, clashing, "").collect()
    assert len(out) == len(ROWS) and all(r.round_trip for r in out)


def test_stages_in_turn_on_odd_and_no_rows(spark, clashing, no_docs):
    for frame in (clashing, no_docs):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == frame.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert all(r.round_trip for r in out)
    assert not out
