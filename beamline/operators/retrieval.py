"""A retrieval index of character n-grams kept as tables, and exact search of it block by block.

Anchors are texts that stand for a target. An anchor's vector holds, for each n-gram, (1 + ln of its count) times
the n-gram's idf, ln((1 + N) / (1 + df)) + 1 over N anchors, at length 1; tokens are weighed alike over the
n-grams that the index knows. Defined cases: a null text is left out; a text shorter than the shortest n-gram has
no vector and is in no result; anchors that repeat are one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import written

#: The shortest and longest n-gram, and how many anchors a token gets.
SHORTEST, LONGEST, POOL = 2, 6, 80
#: Anchors of one block, and tokens of one part: what a task holds at once.
BLOCK_ANCHORS, PART_TOKENS = 50_000, 10_000
#: Scores so near to a pool's last may be equal to it once they are rounded.
NEAR = 2e-9


def all_grams(text: Column) -> Column:
    """Every character n-gram of the text, of all lengths, repeats too."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in range(SHORTEST, LONGEST + 1)])


@dataclass(frozen=True)
class Index:
    """anchors (anchor, token, target, source), grams (gram, df, idf, top: the greatest weight in its list) and postings (gram, anchor, weight)."""

    anchors: DataFrame
    grams: DataFrame
    postings: DataFrame


def first_source(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Anchors (anchor, token, target, source) of all sources' (token, target); of equal ones, but for case, the first source's stays."""
    parts = [rows.select(F.trim("token").alias("token"), "target", F.lit(i).alias("priority"), F.lit(name).alias("source")) for i, (name, rows) in enumerate(sources)]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    first = F.min(F.struct("priority", "token", "source")).alias("first")
    kept = rows.filter("token <> '' and target is not null").groupBy(F.upper("token").alias("upper"), "target").agg(first)
    return kept.select(F.concat_ws("|", "upper", "target").alias("anchor"), "first.token", "target", "first.source")


def _weighed(counted: DataFrame, key: str) -> DataFrame:
    """(key, gram, weight) of (key, gram, n, idf): vectors of length 1."""
    raw = counted.withColumn("raw", (1 + F.log("n")) * F.col("idf"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, key).select(key, "gram", (F.col("raw") / F.col("length")).alias("weight"))


def _counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.explode(all_grams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def build(anchors: DataFrame) -> Index:
    """The index of anchors (anchor, token, target, source), as written tables."""
    anchors = written(anchors, "anchors")
    counted = written(_counted(anchors, "anchor", "token"), "anchor-grams")
    whole = anchors.agg(F.count(F.lit(1)).alias("whole"))
    idf = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(whole)).select("gram", "df", (F.log((1 + F.col("whole")) / (1 + F.col("df"))) + 1).alias("idf"))
    postings = written(_weighed(counted.join(idf, "gram"), "anchor"), "postings")
    top = postings.groupBy("gram").agg(F.max("weight").alias("top"))
    return Index(anchors, written(idf.join(top, "gram"), "gram-bounds"), postings)


def _pools(most: int):
    def pools(tokens: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        """The anchors of one block with the highest scores for each token of one part, with all that tie with the last but for NEAR."""
        columns = ["norm", "anchor", "score"]
        names = anchors["anchor"].tolist()
        lists: dict[str, tuple[list[int], list[float]]] = {}
        for i, held in enumerate(anchors["held"]):
            for g in held:
                at, weights = lists.setdefault(g["gram"], ([], []))
                at.append(i)
                weights.append(g["weight"])
        arrays = {g: (np.array(at), np.array(weights)) for g, (at, weights) in lists.items()}
        rows = []
        for norm, held in zip(tokens["norm"], tokens["held"]):
            score = np.zeros(len(names))
            for g in held:
                if g["gram"] in arrays:
                    at, weights = arrays[g["gram"]]
                    score[at] += g["weight"] * weights
            floor = max(0.0, np.partition(score, -most)[-most] - NEAR) if len(names) > most else 0.0
            met = np.flatnonzero(score > 0.0) if floor == 0.0 else np.flatnonzero(score >= floor)
            rows += [(norm, names[k], score[k]) for k in met]
        return pd.DataFrame(rows, columns=columns)

    return pools


def search(index: Index, tokens: DataFrame, most: int = POOL, block: int = BLOCK_ANCHORS, part: int = PART_TOKENS) -> DataFrame:
    """(norm, anchor, score, place): the anchors of the highest scores of each distinct norm, equal scores by anchor.

    Parts of tokens meet blocks of anchors with their lists; a task sums a token's lists in memory, and only the block's
    pool becomes rows, so that no list is shuffled once for each token. Every list is read, so none is missed.
    """
    known = _counted(tokens.filter("norm is not null").select("norm").distinct(), "norm", "norm").join(index.grams.select("gram", "idf"), "gram")
    vector = lambda rows, key, name: written(rows.groupBy(key).agg(F.collect_list(F.struct("gram", "weight")).alias("held")), name)
    asked, there = vector(_weighed(known, "norm"), "norm", "token-vectors"), vector(index.postings, "anchor", "anchor-vectors")
    blocks, parts = (max(1, -(-rows.count() // n)) for rows, n in ((there, block), (asked, part)))
    all_ = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    there = there.select("*", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"), all_("part", parts))
    asked = asked.select("*", F.pmod(F.xxhash64("norm"), F.lit(parts)).cast("int").alias("part"), all_("block", blocks))
    found = asked.groupBy("part", "block").cogroup(there.groupBy("part", "block")).applyInPandas(_pools(most), "norm string, anchor string, score double")
    scored = found.select("norm", "anchor", F.round("score", 9).alias("score"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("norm").orderBy(F.desc("score"), "anchor"))).filter(F.col("place") <= most)


def best_targets(index: Index, pool: DataFrame) -> DataFrame:
    """(norm, section, score): each target by its best anchor; a token that is a target itself scores 1 there."""
    named = pool.join(index.anchors.select("anchor", "target"), "anchor").select("norm", F.col("target").alias("section"), "score")
    itself = pool.select("norm").distinct().join(index.anchors.select(F.col("target").alias("norm")).distinct(), "norm", "left_semi").select("norm", F.col("norm").alias("section"), F.lit(1.0).alias("score"))
    return named.unionByName(itself).groupBy("norm", "section").agg(F.max("score").alias("score"))
