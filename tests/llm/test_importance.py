import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from beamline.llm.importance import gains_of, resample

from .conftest import ROWS, lowered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = [(1, "the quick fox and the river bank"), (2, None), (3, "Straße und Öl, only-here 12345"), (3, "Straße und Öl, only-here 12345"), (4, "")]


def features(text, n):
    w = WORD.findall(lowered(text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n, percent, buckets, min_words):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, features(text, n)[1]))
    for _, text in target:
        t.update(map(bucket, features(text, n)[1]))
    big_s, big_t = s.total(), t.total()
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (big_s + buckets) / ((s[k] + 1) * (big_t + buckets))))
    out = []
    for d, text, *_ in rows:
        words, f = features(text, n)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = order[: percent * len(order) // 100]
    return sorted(((-1 if d is None else d), f, w, s) for d, _, f, w, s in out), [(d, s) for d, _, _, _, s in drawn]


@pytest.mark.parametrize("table, n, buckets", [("docs", 1, 10_000), ("clashing", 3, 50), ("docs", 2, 1)])
def test_against_counting(request, spark, table, n, buckets):
    got = resample(request.getfixturevalue(table), spark.createDataFrame(TARGET, "item_id long, text string"), n=n, percent=60, buckets=buckets, min_words=3).collect()
    rows, drawn = brute(ROWS, TARGET, n, 60, buckets, 3)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_features, r.weight, r.score) for r in got) == rows
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r.doc_id, r.score) for r in ranked] == drawn and [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))


def test_long_words_in_many_texts(spark):
    """A word too long to send to all tasks, in every text."""
    rows = [(i, f"{'x' * 5000} own{i} and common words") for i in range(60)]
    got = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(TARGET, "item_id long, text string"), min_words=1, percent=50).collect()
    want, drawn = brute(rows, TARGET, 1, 50, 10_000, 1)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [d for d, _ in drawn]


def test_empty_tables(spark, docs, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert resample(no_docs, nothing).count() == 0
    got = resample(docs, nothing, min_words=3).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_features, r.weight, r.score) for r in got) == brute(ROWS, [], 1, 10, 10_000, 3)[0]


def test_gains_are_one_row_a_bucket(spark):
    words = spark.createDataFrame([("a", 3, 0, 3, 1), ("b", 1, 2, 1, 1), ("c", 0, 5, 0, 7)], "feature string, s long, t long, seen long, bucket long")
    gain = lambda s, t: math.floor(1000 * math.log((t + 1) * (4 + 10) / ((s + 1) * (7 + 10))))
    assert sorted(map(tuple, gains_of(words, 10).collect())) == [(1, gain(4, 2)), (7, gain(0, 5))]
