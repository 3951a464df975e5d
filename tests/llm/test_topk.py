import math
import random

from beamline.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, rank string, score string, shard string, id string"


def brute(rows, every, k):
    scaled = {}
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def rows_of(rng, n, width=6):
    vectors = [[rng.choice([-1.5, -0.25, 0.0, 0.125, 0.5, rng.uniform(-1, 1)]) for _ in range(width)] for _ in range(n)]
    from struct import pack, unpack

    return [(i, [unpack("f", pack("f", x))[0] for x in v], "r", "s", "h", "d") for i, v in enumerate(vectors)]


def test_matches_brute_force_over_shards_with_ties(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 600)
    rows += [(600 + i, rows[0][1], "r", "s", "h", "d") for i in range(40)]
    got = top_k(spark.createDataFrame(rows, SCHEMA), every=10, k=5, shard_rows=90, block_rows=8).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 5)


def test_edge_cases(spark):
    x = ("r", "s", "h", "d")
    rows = [(0, [1.0, 2.0], *x), (50, [0.5, -1.0], *x), (3, None, *x), (4, [], *x), (5, [1.0, None], *x), (6, [float("nan"), 1.0], *x), (7, [float("inf"), 1.0], *x), (8, [1.0], *x), (9, [1.0, 1.0, 9.0], *x), (None, [1.0, 1.0], *x), (100, None, *x)]
    assert sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 50, 5)


def test_repeated_rows_are_queries_and_candidates_each(spark):
    rng = random.Random(5)
    rows = rows_of(rng, 40)
    rows += [(0, *rng.choice(rows)[1:]), (0, *rows[0][1:]), (10, *rows[3][1:]), (7, *rows[7][1:]), (7, *rows[7][1:])]
    got = top_k(spark.createDataFrame(rows, SCHEMA), every=10, k=5, shard_rows=9, block_rows=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 5)


def test_wide_products_stay_exact(spark):
    rows = [(i, [4000.0 + (i * k) % 7 / 256 for k in range(9000)], "r", "s", "h", "d") for i in range(6)]
    got = top_k(spark.createDataFrame(rows, SCHEMA), every=3, k=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 2)


def test_large_values_are_held_at_the_ends_of_a_long(spark):
    rng = random.Random(2)
    low, high = -(2**63), 2**63 - 1
    rows = [(i, [rng.choice([3e7, -3e7, 1e20, -1e20, 3e38, 1.0]) for _ in range(8)], "r", "s", "h", "d") for i in range(120)]
    from struct import pack, unpack

    rows = [(i, [unpack("f", pack("f", x))[0] for x in v], *rest) for i, v, *rest in rows]
    hold = lambda x: min(max(x, low), high)
    scaled = [(i, [hold(math.floor(256 * x)) for x in v]) for i, v, *_ in rows]
    want = sorted((q, r + 1, i, -s) for q, v in scaled if q % 10 == 0 for r, (s, i) in enumerate(sorted((-hold(sum(a * b for a, b in zip(v, w))), i) for i, w in scaled if i != q)[:5]))
    got = top_k(spark.createDataFrame(rows, SCHEMA), every=10, k=5, shard_rows=30, block_rows=4).collect()
    assert sorted(map(tuple, got)) == want


def test_empty_and_alone(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0], "r", "s", "h", "d")], SCHEMA)).count() == 0
