import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from beamline.llm.prefix_trie import prefix_trie, rebuilt, running

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    seqs = dict(own)
    if rebuild:
        for c, turns in own.items():
            h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
            seqs[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p: sha256(",".join(str(c) for c in sorted(members[p]) if len(seqs[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def found(frame, rebuild):
    return sorted(map(tuple, prefix_trie(frame, rebuild).collect()))


ODD = [
    (1, 0, "user", "hi"), (1, 1, "bot", "hello"), (1, None, "system", "be kind"),
    (2, 0, "user", "hi"), (2, 1, "bot", "hello"), (2, None, "system", "be kind"),
    (3, 5, None, None), (3, 5, "", ""), (3, 5, "a", "b"), (3, 5, "a", "b"), (3, 7, "", "Äß🎉"),
    (None, 0, "user", "lost"), (None, None, None, None), (100, 0, "user", "base"), (100, 1, "bot", "of a family"), (101, 0, "user", "own"), (102, 0, "user", "own"),
    (103, 3, "user", "own"), (103, 9, "user", "later"), (-5, 0, "user", "hi"), (0, 0, "user", "nought"), (-250, 1, "user", "x"), (-200, 1, "user", "y"),
    *[(104, i, "user", f"turn {i % 3}") for i in range(9)], *[(105, i, "user", f"turn {i % 3}") for i in range(9)],
]


@pytest.mark.parametrize("rebuild", [False, True])
def test_odd_rows(spark, rebuild):
    clashing = [F.lit(1).alias(x) for x in ("c", "d", "name", "n", "rep", "saved", "key", "pos", "len", "_at", "_part", "times")]
    assert found(spark.createDataFrame(ODD, SCHEMA).select("*", *clashing), rebuild) == brute(ODD, rebuild)


@pytest.mark.parametrize("rebuild", [False, True])
def test_paths_of_many_lengths(spark, rebuild):
    """Conversations that share, repeat and continue each other, the longest with all powers of two."""
    rng = random.Random(1)
    rows, paths = [], [[]]
    for c in range(260):
        start = rng.choice(paths)
        path = start[: rng.randrange(len(start) + 1)] + [(rng.choice("ub"), rng.choice("abc") * rng.randrange(3)) for _ in range(rng.choice([0, 1, 2, 5, 17, 40]))]
        paths.append(path)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(path)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA), rebuild) == brute(rows, rebuild)


def test_one_conversation_holds_most_rows(spark):
    rows = [(7, i, "user", f"turn {i}") for i in range(3000)] + [(9, i, "user", f"turn {i}" if i < 2500 else "else") for i in range(2600)] + [(c, 0, "user", "hi") for c in range(1000, 1500)]
    got = found(spark.createDataFrame(rows, SCHEMA), False)
    want = sum(len(f"turn {i}") for i in range(2500)) + 499 * 2
    assert len(got) == 1 + 3000 + 100 + 1
    assert got[0][:5] == (7, 0, None, 502, 2) and got[0][5:7] == (3, want)
    one = [r for r in got if r[0] == 1000]
    assert [r[7] for r in one] == [sha256(",".join(map(str, range(1000, 1500))).encode()).hexdigest()]
    assert [r[6] for r in got if r[0] == 7 and r[1] in (2499, 2500, 2501)] == [len("turn 2498") + len("turn 2499"), len("turn 2499"), 0]


def test_sums_that_go_on_over_ranges(spark):
    rows = spark.range(1000).select(F.lit(5).cast("long").alias("c"), F.col("id").alias("at"), (F.col("id") % 7).alias("v"))
    got = {r["at"]: r.up_to for r in running(rows, "at", [], "v", "sums").collect()}
    assert got == {i: sum(k % 7 for k in range(i + 1)) for i in range(1000)}


def test_heads_come_from_the_family(spark):
    turns = spark.createDataFrame([(100, i, b"b%d" % i, 1) for i in range(3)] + [(101, i, b"o%d" % i, 1) for i in range(8)], "c long, pos long, key binary, chars long")
    h = zlib.crc32(b"101") % 6
    got = {(r.c, r.pos): bytes(r.key) for r in rebuilt(turns, 100)[0].collect()}
    assert [got[101, i] for i in range(min(h, 3) + 8 - h)] == [b"b%d" % i for i in range(min(h, 3))] + [b"o%d" % i for i in range(h, 8)]


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA), True) == found(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA), False) == []
