import random

import numpy as np
import pytest

from beamline.llm import minhash_dedup
from beamline.llm.minhash_dedup import Sketches, minhash_components, op13_minhash_dedup

from .conftest import ROWS
from .test_jaccard_join import SCHEMA, brute, near_copies


def found(frame, n, percent, **more):
    low = lambda x: -1 if x is None else x
    rows = minhash_components(frame, n, percent, **more).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in rows)


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_edge_cases(request, table):
    assert found(request.getfixturevalue(table), 3, 85) == brute(ROWS, 3, 85)


@pytest.mark.parametrize("n, percent, length", [(3, 85, 60), (3, 85, 300), (2, 70, 120)])
def test_large_groups_of_near_copies(spark, n, percent, length):
    """Sets below and above the size of a sketch; some link only through others."""
    rng = random.Random(length)
    bases = [" ".join(f"w{rng.randrange(900)}" for _ in range(length)) + " and so on for all of them" for _ in range(4)]
    rows = list(enumerate([t for b in bases for t in near_copies(rng, b, 70, max(4, length // 20))]))
    rows += [(len(rows) + i, " ".join(f"x{i}y{k}" for k in range(length))) for i in range(50)]
    assert found(spark.createDataFrame(rows, SCHEMA), n, percent) == brute(rows, n, percent)


def test_texts_around_the_size_of_a_sketch(spark):
    """One of a pair is its own sketch, the other is not."""
    rows = []
    for k in range(50, 90):
        own = [f"k{k}x{i}" for i in range(k)]
        rows += [(len(rows) + c, " ".join(own[: k - c])) for c in (0, 3, 9)]
    assert found(spark.createDataFrame(rows, SCHEMA), 1, 85) == brute(rows, 1, 85)


def test_passages_that_many_share_link_nothing(spark):
    rng = random.Random(5)
    head = " ".join(f"h{i}" for i in range(60))
    rows = [(i, head + " " + " ".join(f"r{rng.randrange(10**9)}" for _ in range(60))) for i in range(300)]
    assert found(spark.createDataFrame(rows, SCHEMA), 3, 85) == brute(rows, 3, 85)


def test_many_rows_without_an_id(spark):
    """Rows that share a null id are told apart by their texts; none meets all others."""
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        own = [f"t{i}w{k}" for k in range(60)]
        rows += [(None, " ".join(own)), (None, " ".join(own[:rng.randrange(56, 60)]))]
    got = found(spark.createDataFrame(rows, SCHEMA), 3, 85)
    assert len(got) == 3000 and {c for _, _, c in got} == {-1}


def test_groups_that_are_alike_but_not_linked_give_few_pairs(spark, monkeypatch):
    """Pairs at a similarity of some 65 % are told by their bitmaps; none of their square is verified."""
    verified = []
    whole = minhash_dedup.linked_labels.__globals__["linked_pairs"]
    counting = lambda texts, classes, pairs, *more: verified.append(pairs.count()) or whole(texts, classes, pairs, *more)
    monkeypatch.setattr(minhash_dedup, "linked_pairs", counting)
    monkeypatch.setitem(minhash_dedup.linked_labels.__globals__, "linked_pairs", counting)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"r{rng.randrange(10**9)}" if rng.random() < 0.04 else w for w in base) for _ in range(120)]
    rows = list(enumerate([*texts, texts[7] + " and more", texts[40] + " or less"]))
    assert found(spark.createDataFrame(rows, SCHEMA), 3, 85) == brute(rows, 3, 85)
    assert sum(verified) <= 2 * len(rows)


def test_sets_of_one_size_and_place_meet_as_one_kind(spark, monkeypatch):
    """What meets by size and place does not grow with the square of a large group of sets that are alike."""
    met, together = [], minhash_dedup._together
    monkeypatch.setattr(minhash_dedup, "_together", lambda rows: met.append(rows.count()) or together(rows))
    monkeypatch.setattr(minhash_dedup, "CHUNK", 16)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(60)]
    rows = list(enumerate(" ".join(f"r{rng.randrange(10**9)}" if i == k else w for i, w in enumerate(base)) for k in (rng.sample(range(60), 1)[0] for _ in range(400))))
    rows += [(1000 + i, t) for i, t in enumerate([" ".join(f"r{rng.randrange(10**9)}" if i % 9 == k % 9 else w for i, w in enumerate(base)) for k in range(300)])]
    assert found(spark.createDataFrame(rows, SCHEMA), 3, 85) == brute(rows, 3, 85)
    assert 0 < met[0] < 10 * len(rows)


def test_bounds_of_equal_sizes_are_sharper():
    """Linked sets of one size have 91.9 % of each in common, so of their least values too."""
    rule, size = Sketches(85), np.array([5000])
    assert rule.needed(size, size) == 42 and rule.needed(size, np.array([4250])) == 34
    linked, apart = np.array([2 * 5000 * 3 // 37]), np.array([1000])
    assert rule.may_link(size // 4, size // 4, linked // 4) and not rule.may_link(size // 4, size // 4, apart // 3)


def test_bounds():
    rule = Sketches(85)
    assert rule.least() == 34
    assert (rule.prefix(20), rule.prefix(54), rule.prefix(60), rule.prefix(64), rule.prefix(5000)) == (4, 9, 27, 31, 31)


def test_whole_table(spark, small):
    frame, rows = small
    assert found(frame, 3, 85) == brute([(r.doc_id, r.text) for r in rows], 3, 85)
    assert op13_minhash_dedup(spark, "/root/testdata/sf0.001").count() == len(rows)


def test_empty(no_docs):
    assert minhash_components(no_docs).count() == 0
