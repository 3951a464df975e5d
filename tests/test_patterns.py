"""Learned patterns against plain matching and a plain trie."""

import random
import re

import pytest
from pyspark.sql import functions as F

from beamline.operators import patterns as p

TOKENS = {
    "W": ["W12X26", "w8x10 ", "W12X26.5", "W12", "W", "WT5X6", "HP10X42", "W12-26", "", "  ", None, "W12X26"],
    "one": ["A1", "A1"],
    "many": ["AA1", "BB2", "CC3", "DD4", "EE5", "EE5.5"],
    "odd": ["1/2(X)", "1/2[X]", "3/4{Y}", "PL|1", "A.B*", "C+D?", "\\^$"],
    "ends": ["A", "A1", "A1B", "A1B2"],
}


def frame(spark, tokens=TOKENS):
    return spark.createDataFrame([(g, t) for g, v in tokens.items() for t in v], "g string, token string")


def made(token):
    return tuple("A" if r[0].isalpha() else "N" if r[0].isdigit() else "S" + r for r in re.findall(p.RUN, token))


def test_every_token_fits_and_others_do_not(spark):
    got = {r.g: r.pattern for r in p.learned(frame(spark), "g", "token").collect()}
    assert set(got) == set(TOKENS)
    for g, tokens in TOKENS.items():
        known = {t.strip().upper() for t in tokens if t and t.strip()}
        for t in known:
            assert re.fullmatch(got[g], t), (g, t, got[g])
        kinds = {made(t) for t in known}
        for other in {t.strip().upper() for v in TOKENS.values() for t in v if t and t.strip()}:
            assert made(other) in kinds or not re.fullmatch(got[g], other), (g, other, got[g])
    assert got["one"] == "A\\d+" and got["ends"] == "A(?:\\d+(?:B(?:\\d+)?)?)?" and got["many"].startswith("[A-Z]+\\d+")


def test_branches_that_go_on_alike_are_one(spark):
    lists = spark.createDataFrame([("g", ["W", "\\d+", "X", "\\d+"]), ("g", ["HP", "\\d+", "X", "\\d+"]), ("g", ["C", "\\d+"])], "g string, fragments array<string>")
    assert p.merged(lists).collect()[0].pattern == "(?:(?:HP|W)\\d+X\\d+|C\\d+)"


@pytest.mark.parametrize("seed", range(3))
def test_merged_tries_fit_the_same_as_their_lists(spark, seed):
    rng = random.Random(seed)
    lists = [(g, [rng.choice("ABC") for _ in range(rng.randrange(1, 6))]) for g in "xy" for _ in range(25)]
    got = {r.g: r.pattern for r in p.merged(spark.createDataFrame(lists, "g string, fragments array<string>")).collect()}
    words = ["".join(rng.choice("ABC") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    for g in "xy":
        known = {"".join(f) for k, f in lists if k == g}
        assert all(bool(re.fullmatch(got[g], w)) == (w in known) for w in [*words, *known])


def test_simplified_ends_and_keeps_what_fits(spark):
    given = ["(?:W)\\d+", "(?:(?:AB)12)X", "(?:A|B|A)C", "(?:A|A)", "(?:A)?B", "A(?:)?", "1\\/2", "(?:\\||\\||A)", "", "(?:A|AB|A)"]
    rows = p.simplified(spark.createDataFrame([(str(i), t) for i, t in enumerate(given)], "g string, pattern string")).collect()
    got = {int(r.g): r.pattern for r in rows}
    assert [got[i] for i in range(7)] == ["W\\d+", "AB12X", "(?:B|A)C", "A", "(?:A)?B", "A", "1/2"]
    for i, t in enumerate(given):
        for word in ("W1", "AB12X", "AC", "BC", "A", "AB", "B", "1/2", "|", ""):
            assert bool(re.fullmatch(t, word)) == bool(re.fullmatch(got[i], word)), (t, word)


def test_scores_of_patterns(spark):
    given = {"W\\d+X\\d+": (0.80, 1.0), "[A-Z]+": (0.70, 1.0), ".*": (0.2, 1.0), "(?:A|B)" * 20: (1.0, 0.05), "": (0.6, 1.0)}
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", p.specificity(F.col("t")), p.readability(F.col("t"))).collect()
    assert {r[0]: (round(r[1], 6), round(r[2], 6)) for r in rows} == given


def test_second_run_changes_nothing(spark):
    none = frame(spark, {}).select("g", "token")
    known = none.select("g", F.col("token").alias("pattern"), F.lit(0).alias("version"))
    known, examples = p.learn_or_reuse(known, none, frame(spark, {"W": ["W12X26"], "C": ["C8X11"]}))
    assert {r.g: (r.status, r.version) for r in known.collect()} == {"W": ("created", 1), "C": ("created", 1)}
    more = frame(spark, {"W": ["W12X26.5", "W10X9"], "C": ["C9X1"], "M": ["M1"]})
    known, examples = p.learn_or_reuse(known.drop("status"), examples, more)
    first = {r.g: (r.status, r.version, r.pattern) for r in known.collect()}
    assert first["C"][:2] == ("reused", 1) and first["W"][:2] == ("updated", 2) and first["M"][:2] == ("created", 1)
    seen = examples.count()
    again, examples = p.learn_or_reuse(known.drop("status"), examples, more)
    assert {r.g: (r.status, r.version, r.pattern) for r in again.collect()} == {g: ("reused", v, t) for g, (_, v, t) in first.items()}
    assert examples.count() == seen


def test_patterns_of_the_tables(spark, sf_dir):
    from beamline.plans.patterns import pattern_knowledge, pattern_learn_trie

    rows = pattern_learn_trie(spark, sf_dir).collect()
    assert rows and all(r.matched == r.total and len(r.pattern) < r.listed_length for r in rows)
    assert {r.family for r in pattern_knowledge(spark, sf_dir).collect()} == {r.family for r in rows}
