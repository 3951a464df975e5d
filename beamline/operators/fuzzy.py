"""Similarity of short labels by matching blocks and by weighted edits."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Characters that print alike, each with the one it is taken for.
CONFUSED = {"0": "O", "O": "0", "1": "I", "I": "1", "L": "1", "5": "S", "S": "5", "8": "B", "B": "8", "2": "Z", "Z": "2", "6": "G", "G": "6"}
CONFUSED_COST = 0.5
#: The bonus for the first three characters, and the least ratio.
PREFIX, BONUS, LEAST_RATIO = 3, 0.08, 0.55
#: Labels of one block: so many are held by a task at once.
BLOCK_LABELS = 20_000
#: Tokens of one part, and those that a task multiplies at once.
PART_TOKENS, CHUNK_TOKENS = 4_000, 200
#: Cosines so near to the greatest may be equal to it once they are rounded.
NEAR = 2e-6


def weighted_edits(a: Column, b: Column) -> Column:
    """The edit distance in which a confusable character costs half."""
    confused = F.create_map(*[F.lit(x) for pair in CONFUSED.items() for x in pair])
    chars = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: j.cast("double"))

    def next_row(row: Column, char: Column) -> Column:
        def put(done: Column, j: Column) -> Column:
            other = F.substring(b, j, F.lit(1))
            cost = F.when(char == other, 0.0).when(F.coalesce(F.try_element_at(confused, char) == other, F.lit(False)), CONFUSED_COST).otherwise(1.0)
            return F.concat(done, F.array(F.least(F.get(row, j) + 1, F.get(done, j - 1) + 1, F.get(row, j - 1) + cost)))

        return F.when(F.length(b) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(F.get(row, F.lit(0)) + 1), put)).otherwise(F.array(F.get(row, F.lit(0)) + 1))

    last = F.when(F.length(a) > 0, F.aggregate(chars(a), start, next_row)).otherwise(start)
    return F.element_at(last, -1)


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 64), dtype=np.int16)
    for i, text in enumerate(texts):
        for c in text:
            out[i, ord(c) % 64] += 1
    return out


def _begins(text: str, letters: bool) -> str | None:
    """What a bonus is given for: the first three characters, or the first three letters, of which there must be one."""
    return ("".join(filter(str.isalpha, text))[:PREFIX] or None) if letters else text[:PREFIX]


def _ratio_search(most: int, least: float, bonus: float, letters: bool):
    def search(tokens: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """The best labels of one block; characters in common bound the ratio, so most labels are never compared."""
        labels = [x for row in blocks["labels"] for x in row]
        length, held = np.array([len(x) for x in labels]), _counts(labels)
        begins = [_begins(x, letters) for x in labels]
        rows = []
        for token in tokens["norm"]:
            n, begun = length + len(token), _begins(token, letters)
            more = [bonus if begun is not None and x == begun else 0.0 for x in begins]
            bound = np.where(n > 0, 2.0 * np.minimum(held, _counts([token])).sum(axis=1) / np.maximum(n, 1), 1.0)
            bound = np.minimum(1.0, bound + np.array(more))
            best: list[tuple[float, str]] = []
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < least or len(best) == most and round(bound[i], 4) < -best[-1][0]:
                    break
                matcher = SequenceMatcher(None, token, labels[i], autojunk=False)
                score = min(1.0, matcher.ratio() + more[i])
                if score >= least:
                    best = sorted([*best, (-round(score, 4), labels[i])])[:most]
            rows += [(token, label, -score) for score, label in best]
        return pd.DataFrame(rows, columns=["norm", "label", "ratio"])

    return search


def ratio_search(tokens: DataFrame, labels: DataFrame, most: int = 3, least: float = LEAST_RATIO, block: int = BLOCK_LABELS, bonus: float = BONUS, letters: bool = False) -> DataFrame:
    """tokens (norm) against labels (label): (norm, label, ratio), the best by matching-block ratio, with the bonus where both begin alike: by characters, or by letters alone.

    Distinct tokens visit the labels block by block.
    """
    labels = labels.select("label").distinct()
    blocks = max(1, -(-labels.count() // block))
    dealt = labels.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks))).groupBy("block").agg(F.collect_list("label").alias("labels"))  # some BLOCK_LABELS each
    parts = max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = tokens.select("norm").distinct().withColumn("part", F.pmod(F.xxhash64("norm"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    there = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    found = asked.groupBy("part", "block").cogroup(there.groupBy("part", "block")).applyInPandas(_ratio_search(most, least, bonus, letters), "norm string, label string, ratio double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("r"), "label"))), 1, most)  # `most` of each block
    return found.groupBy("norm").agg(best.alias("best")).select("norm", F.explode("best").alias("b")).select("norm", "b.label", (-F.col("b.r")).alias("ratio"))


def _near_cosines(tokens: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
    """Of each token the labels of one block whose cosine is the greatest but for NEAR, each different value once, by its least label."""
    columns = ["norm", "label", "s", "sd", "sp"]
    if not len(labels):
        return pd.DataFrame([], columns=columns)
    labels = labels.sort_values("label")
    names, whole = labels["label"].to_numpy(), labels["sd"].to_numpy()
    place: dict[str, int] = {}
    for held in labels["held"]:
        for g in held:
            place.setdefault(g["gram"], len(place))
    weights = np.zeros((len(place), len(names)))
    for i, held in enumerate(labels["held"]):
        for g in held:
            weights[place[g["gram"]], i] = g["w"]
    rows = []
    for at in range(0, len(tokens), CHUNK_TOKENS):
        some = tokens.iloc[at : at + CHUNK_TOKENS]
        has = np.zeros((len(some), len(place)))
        for i, held in enumerate(some["held"]):
            has[i, [place[g["gram"]] for g in held if g["gram"] in place]] = 1.0
        shared = has @ weights
        cosine = shared / np.sqrt(whole[None, :] * some["sp"].to_numpy()[:, None])
        top = cosine.max(axis=1)
        for i, (norm, sp) in enumerate(zip(some["norm"], some["sp"])):
            if top[i] > 0:
                near = np.flatnonzero(cosine[i] >= top[i] - NEAR)
                for j in near[np.unique(cosine[i, near], return_index=True)[1]]:
                    rows.append((norm, names[j], shared[i, j], whole[j], sp))
    return pd.DataFrame(rows, columns=columns)


def nearest_by_cosine(tokens: DataFrame, labels: DataFrame, block: int = BLOCK_LABELS, part: int = PART_TOKENS) -> DataFrame:
    """tokens (norm, gram, w) and labels (label, gram, w): (norm, label, s, sd, sp), the labels nearest to the greatest cosine s / sqrt(sd * sp) of weighted sets.

    Blocks of labels meet parts of tokens as matrices, so that no pair becomes a row but the best ones.
    """
    vector = lambda rows, key, whole: written(rows.groupBy(key).agg(F.collect_list(F.struct("gram", "w")).alias("held"), F.sum("w").alias(whole)), key)
    there, asked = vector(labels, "label", "sd"), vector(tokens, "norm", "sp")
    blocks, parts = (max(1, -(-rows.count() // n)) for rows, n in ((there, block), (asked, part)))
    all_ = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    there = there.select("*", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("block"), all_("part", parts))
    asked = asked.select("*", F.pmod(F.xxhash64("norm"), F.lit(parts)).cast("int").alias("part"), all_("block", blocks))
    return asked.groupBy("part", "block").cogroup(there.groupBy("part", "block")).applyInPandas(_near_cosines, "norm string, label string, s double, sd double, sp double")
