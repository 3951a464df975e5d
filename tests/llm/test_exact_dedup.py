import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beamline.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode, keep_one, rice_bits

from .conftest import ROWS, lowered


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**57 - 1), unique=True, max_size=300))
def test_golomb_round_trip(values):
    values = np.array(sorted(values), dtype=np.uint64)
    bits = rice_bits(57, len(values))
    assert (golomb_decode(golomb_encode(values, bits), len(values), bits) == values).all()


def expected(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[lowered(t or "")].append(d)
    low = lambda d: -1 if d is None else d
    return sorted(((low(d), low(max(g, key=low)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g), key=str), groups


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_edge_cases(request, table):
    got = exact_dedup(request.getfixturevalue(table)).collect()
    low = lambda d: -1 if d is None else d
    want, groups = expected(ROWS)
    assert sorted(((low(r.doc_id), low(r.keep_id), r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert keep_one(no_docs).count() == 0


def test_keep_one_keeps_all_columns(clashing):
    got = keep_one(clashing)
    assert got.columns == clashing.columns
    assert sorted(lowered(r.text or "") for r in got.collect()) == sorted({lowered(t or "") for _, t, *_ in ROWS})
