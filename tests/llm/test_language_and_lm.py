import functools
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from beamline.llm.language_crf import languages, posteriors, sample_of
from beamline.llm.lm_score import Filter, greatest_count, least_count, levels, lm_scores, segment_bits

from .conftest import ROWS, words


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    emission, transition, steps = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.zeros((3, 3))
    got = posteriors(emission, np.array([0, 4, 4, 9]), transition, stretch=2, steps=steps)
    want, pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 9)):
        here, moves, total = np.zeros((b - a, 3)), np.zeros((3, 3)), 0.0
        for y in itertools.product(range(3), repeat=b - a):
            w = sum(np.exp(transition[s, y[0]]) for s in range(3)) * np.exp(sum(emission[a + i, y[i]] for i in range(b - a)) + sum(transition[y[i - 1], y[i]] for i in range(1, b - a)))
            total += w
            for i in range(b - a):
                here[i, y[i]] += w
            for i in range(1, b - a):
                moves[y[i - 1], y[i]] += w
        want[a:b], pairs = here / total, pairs + moves / total
    assert np.allclose(got, want) and np.allclose(steps, pairs)


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_language_edge_cases(request, table):
    got = languages(request.getfixturevalue(table)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id in (7, 8):
            assert r.lang_pred == "de"


def test_language_without_labels(docs, no_docs):
    assert languages(no_docs).count() == 0
    assert {r.lang_pred for r in languages(docs.filter("lang is null")).collect()} == {"und"}


def test_repeated_ids_lose_no_language(spark):
    """Many rows of one id, null ids, and one text a third of all rows, beside a few rows of other languages."""
    rng = np.random.default_rng(4)
    of = {lang: [f"{lang}{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"] for lang in ("de", "en", "zz")}
    text = lambda lang: " ".join(rng.choice(of[lang], 30))
    rows = [(1, text("de"), "de") for _ in range(700)] + [(None, text("en"), "en") for _ in range(60)] + [(1, of["de"][0], "de")] * 400 + [(next(i for i in range(2, 99) if zlib.crc32(str(i).encode()) % 4 != 2), " ".join([text("zz")] * 3000), "zz")] + [(3, text("zz"), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = sample_of(frame, documents=60).collect()
    assert {x: sum(r.lang == x for r in sample) for x in ("de", "en", "zz")} == {"de": 20, "en": 20, "zz": 1}
    assert len({(r.lang, r.h) for r in sample}) == len(sample) and max(len(r.text) for r in sample) < 13_000
    got = languages(frame).collect()
    truth = {t: t[:2] for _, t, _ in rows}
    names = [r.lang_pred for r in got]
    assert len(got) == len(rows) and Counter(names) == Counter(truth[t] for _, t, _ in rows)


def test_language_held_out_accuracy(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in frame.select("doc_id", "lang").collect()}
    got = [r for r in languages(frame).collect() if r.held_out]
    assert len(got) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)


def held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0


def brute_lm(rows):
    """(id, held_out, tokens, known, N, base score, score) by counting in dictionaries, with counts quantised likewise."""
    tokens = [(d, words(t) + ["\0"]) for d, t, *_ in rows]
    counts, pairs, begins = Counter(), Counter(), 0
    for d, ws in tokens:
        if not held_out(d):
            counts.update(ws)
            pairs.update(zip([None, *ws], ws))
            begins += 1
    n, v = sum(counts.values()), len(counts)
    norm = n + 0.1 * (v + 1)
    level = lambda c: 0 if not c else 1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)
    low = lambda c: next(x for x in itertools.count(1) if level(x) == level(c)) if c else 0
    high = lambda c: max(x for x in range(c, 2 * c + 1) if level(x) == level(c)) if c else 0
    low, high = functools.cache(low), functools.cache(high)
    out = []
    for d, ws in tokens:
        base = sum(math.log10((counts[w] + 0.1) / norm) for w in ws)
        score = sum(math.log10((low(pairs[b, w]) + 2 * (low(counts[w]) + 0.1) / norm) / (high(begins if b is None else counts[b]) + 2)) for b, w in zip([None, *ws], ws))
        out.append((-1 if d is None else d, held_out(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 3), round(score, 3)))
    return sorted(out)


def scores_of(frame, **how):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3), round(r.score, 3)) for r in lm_scores(frame, **how).collect())


def test_levels_hold_their_counts():
    counts = np.array([1, 2, 3, 4, 5, 10, 1000, 10**7])
    level = levels(counts)
    assert (least_count(level) <= counts).all() and (greatest_count(level) >= counts).all()
    assert (levels(least_count(level)) == level).all() and (levels(greatest_count(level)) == level).all()
    assert (levels(greatest_count(level) + 1) > level).all()


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**32, 40_000, dtype=np.uint64))
    counts = rng.zipf(1.6, len(keys)).clip(max=10**6)
    inside, outside = keys[::2], keys[1::2]
    here = Filter({1: segment_bits(inside, counts[::2])}, 3)
    at = np.uint64(1 << 32)
    found = here.probe(inside | at)
    assert (found >= levels(counts[::2])).all() and (found > levels(counts[::2])).mean() < 0.1
    assert (here.probe(outside | at) > 0).mean() < 0.1
    assert not here.probe(inside).any() and len(here.probe(inside[:0])) == 0


@pytest.mark.parametrize("how", [{}, {"vocabulary": 8}, {"broadcast_filter": 0}, {"vocabulary": 0, "segment_grams": 1000}, {"broadcast_filter": 0, "segment_grams": 500}])
def test_lm_scores_match_counting(clashing, how):
    """Whatever is sent to all tasks, with so many probes that the filter has no false positives; of the long text's n-grams some share 32 bits."""
    got, want = scores_of(clashing, probes=40, **how), brute_lm(ROWS)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want], rel=1e-4)
    assert [r[-1] for r in got if r[2] < 1000] == pytest.approx([r[-1] for r in want if r[2] < 1000], abs=2e-3)


def test_lm_scores_do_not_depend_on_the_way(small):
    want = scores_of(small[0], segment_grams=20_000)
    assert scores_of(small[0], segment_grams=20_000, vocabulary=64, broadcast_filter=0) == want


def test_documents_that_occur_twice_score_higher(spark, small):
    """A copy elsewhere in the training documents raises the score of each token."""
    rows = [(i, r.text) for i, r in enumerate(small[1]) if 50 < len(words(r.text)) < 2000][:60]
    twice = [(1000 + i, t) for i, t in rows if i % 2]
    got = lm_scores(spark.createDataFrame(rows + twice, "doc_id long, text string")).collect()
    per = {r.doc_id: r.score / r.n_tokens for r in got if not r.held_out and not held_out(r.doc_id + 1000)}
    once = sorted(v for d, v in per.items() if d % 2 == 0 and d < 1000)
    again = sorted(v for d, v in per.items() if d % 2 and d < 1000)
    assert again[len(again) // 2] > once[len(once) // 2]


def test_lm_beats_its_base(small):
    got = [r for r in lm_scores(small[0]).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_empty(no_docs):
    assert lm_scores(no_docs).count() == 0
