"""Near duplicates by bottom-k sketches: the least hash values of a document's n-grams, under one hash function.

A document's sketch holds its KEPT least n-gram hashes (all, if fewer); one pass over the texts takes all sketches and counts
their values. Inverted lists lead from a retained
value to the sketches that hold it, rarest values first: a sketch is filed under as many of its values as
it takes for two sketches that share what linked documents share to meet in a list. Each list's sets first meet two of them, its hubs, which links most
copies. Then sets that are not yet linked meet: sizes, places and parity bitmaps of their least values bound what a pair
can share; a set that no other of its list can be linked with leaves the list before any round, so that a large group of
sets that are alike, but not enough, gives no pairs. The sets of a list's largest component, however many, meet the others but not each other. The pairs that span what a list would
connect, and some to spare, are weighed by the sketch of their union: of its KEPT least values, the part
that both hold estimates the similarity. Pairs that may be linked by it are verified on whole sets. Where a pair
fails and others were withheld, the next round gives more of them, until none is withheld.

Sets of fewer than KEPT n-grams are their own sketches, and their bounds are exact. For larger sets a link can
be overlooked where its estimate falls under a bound that a binomial tail sets: one linked pair in a thousand
million (MISSED) at the least similarity, far fewer above it; its documents still are one component where other
links join them. With 64 values and 85 % the bound is 34 of 64.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a text of
fewer words than n is one n-gram; equal sets are one class whatever their number; rows that repeat an id are
separate rows with that id, null ids too; a null id never is a component's smallest unless all its ids are
null; an empty table gives no rows; other columns are ignored. Whole texts are read. N-grams and sets are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import comb, lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jaccard_join import BROADCAST_IDS, CHUNK, SEGMENTS, SKETCH_BITS, SURVEYED, WholeSets, _paired, _partners, _together, _whole_buckets, classes_of, linked_labels, linked_pairs, ngram_sets, set_id, sketch_of, with_components
from .shared import joined, partitions, written
from .textbytes import mix, slices

#: Values that a sketch holds.
KEPT = 64
#: Greatest chance that the sketches of a linked pair share too few values.
MISSED = 1e-9
#: Least values of a set whose parities a bitmap holds, and its bits: most sets whole, so that it tells copies from what is merely alike.
BITMAP_VALUES, BITMAP_BITS = 2048, 2048
#: Steps of a share, rounded down, for which a bound is kept.
STEPS = 1000


@dataclass(frozen=True)
class Sketches(WholeSets):
    """What two sketches share if their sets are linked."""

    held: int = KEPT

    def kept(self, size: np.ndarray) -> np.ndarray:
        return np.minimum(size, self.held)

    def least(self, held: int | None = None) -> int:
        """The most of a union's held least values that linked sets both hold but for a chance of MISSED."""
        held = held or self.held
        p, tail = self.percent / 100, 0.0
        for x in range(held + 1):
            tail += comb(held, x) * p**x * (1 - p) ** (held - x)
            if tail > MISSED:
                return max(1, x)
        return held

    def shared(self, a: np.ndarray, b: np.ndarray, held: int) -> np.ndarray:
        """What the held least values of two linked sets have in common at least.

        Up to the lower of both last values all are held, so what is common are the members of both among the held least of one set.
        """
        whole, left_out = super().needed(a, b), np.maximum(a - held, 0) + np.maximum(b - held, 0)
        share = np.clip(STEPS * whole // np.maximum(np.maximum(a, b), 1), 0, STEPS)
        return np.where(left_out > 0, np.maximum(whole - left_out, _fewest(held)[share]), whole)

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.shared(a, b, self.held)

    def may_link(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
        return np.minimum(a, BITMAP_VALUES) + np.minimum(b, BITMAP_VALUES) - far >= 2 * self.shared(a, b, BITMAP_VALUES)

    def prefix(self, size: int) -> int:
        """Values that a set of this size is filed under: with fewer left than it must share, no first common value lies beyond them."""
        whole = -(-self.percent * size // 100)
        least = whole if size * 100 < self.held * self.percent else min(whole, self.least())
        return min(size, self.held) - least + 1


@cache
def _fewest(held: int) -> np.ndarray:
    """By share of a set's members that another has too, in steps: the most of its held least values that are in both but for a chance of MISSED, for either set half."""
    x = np.arange(held + 1)
    ways = np.array([lgamma(held + 1) - lgamma(k + 1) - lgamma(held - k + 1) for k in x])
    out = np.zeros(STEPS + 1, dtype=np.int64)
    for step in range(1, STEPS):
        p = step / STEPS
        out[step] = np.searchsorted(np.cumsum(np.exp(ways + x * np.log(p) + (held - x) * np.log1p(-p))), MISSED / 2, "right")
    out[STEPS] = held
    return out


def sketch(grams: np.ndarray, held: int = KEPT) -> np.ndarray:
    """The least of a set's sorted hashes, as non-negative 63-bit integers in their order."""
    return (grams[:held] >> np.uint64(1)).view(np.int64)


def place(values: np.ndarray) -> np.ndarray:
    """Where retained values are counted."""
    return (mix(values.view(np.uint64)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def parity(grams: np.ndarray) -> bytes:
    """The parity of the least values that fall on each bit: two bitmaps differ in no more bits than those values do."""
    return np.packbits(np.bincount((mix(grams[:BITMAP_VALUES]) >> np.uint64(20)).astype(np.int64) % BITMAP_BITS, minlength=BITMAP_BITS).astype(np.uint8) & 1).tobytes()


SKETCHED = f"{SURVEYED}, bits binary, sketch array<long>"
NAMES = [x.split()[0] for x in SKETCHED.split(", ")]


def _sketched(n: int, held: int):
    """Rows (id, text_hash, size, cls) for documents, with bitmap and sketch where a task first meets a set; at its end each task's counts of retained values, by segment."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, dtype=np.uint32), set()
        for batch in (y for x in batches for y in slices(x)):
            sizes, cls, bits, sketches = [], [], [], []
            for grams in ngram_sets(batch.column("text"), n):
                sizes.append(len(grams)), cls.append(set_id(grams)), bits.append(None), sketches.append(None)
                if len(grams) and (sizes[-1], cls[-1]) not in seen:
                    seen.add((sizes[-1], cls[-1]))
                    bits[-1], sketches[-1] = parity(grams), sketch(grams, held)
                    np.add.at(counts, place(sketches[-1]), 1)
            k = len(sizes)
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(bits, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)
        parts = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in np.split(counts, SEGMENTS)] if counts.any() else []
        k = len(parts)
        columns = [*[pa.nulls(k, pa.int64())] * 4, pa.array(range(k), pa.int32()), pa.array(parts, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return sketched


def _file(counted, rule: Sketches):
    """A set's places in the inverted lists, from its sketch: the rarest of its values first."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counted.value
        for batch in batches:
            token, cls, size, pos = [], [], [], []
            for me, k, values in zip(batch.column("cls").to_pylist(), batch.column("size").to_pylist(), batch.column("sketch")):
                values, p = values.values.to_numpy(), rule.prefix(k)
                token.append(values[np.lexsort((values, counts[place(values)]))[:p]]), cls.append(np.full(p, me)), size.append(np.full(p, k)), pos.append(np.arange(p))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (token, cls, size, pos)], names=["token", "cls", "size", "pos"])

    return file


def _lists(filed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, cls, size, pos) of the inverted lists that hold two sets or more, and (token, n, low, high) of them: their length and two hubs."""
    of = F.struct("cls", "size", "pos")
    shared = written(filed.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token"), "shared")
    lists = written(filed.join(shared, "token"), "lists")
    return lists, written(lists.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(of).alias("low"), F.max(of).alias("high")).filter("low.cls <> high.cls"), "heads")


def _to_hubs(lists: DataFrame, heads: DataFrame, rule: Sketches, often: int) -> DataFrame:
    """Pairs (a, b) of a list's sets with its hubs, b, that sizes and places allow."""
    met = joined(lists, heads, ["token"], F.col("n") > often).withColumn("hub", F.explode(F.array("low", "high"))).filter("cls <> hub.cls")
    kept = lambda size: F.least(size, F.lit(rule.held))
    a, b = F.col("size"), F.col("hub.size")
    whole, left_out = F.ceil(rule.percent * (a + b) / F.lit(100 + rule.percent)), a - kept(a) + b - kept(b)
    need = F.when(left_out > 0, F.greatest(whole - left_out, F.lit(rule.least()))).otherwise(whole)
    fits = (100 * F.least(a, b) >= rule.percent * F.greatest(a, b)) & (F.least(kept(a) - F.col("pos"), kept(b) - F.col("hub.pos")) >= need)
    return met.filter(fits).select(F.col("cls").alias("a"), F.col("hub.cls").alias("b")).distinct()


def _most(rows: DataFrame) -> DataFrame:
    """(token, n, top, tops, others) of the lists in rows (token, label, ...) that hold two labels or more: their most frequent label, and the chunks of its sets and of the others."""
    labels = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    most = labels.groupBy("token").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("top")).filter("n > top.m")
    return written(most.select("token", "n", F.col("top.label").alias("top"), F.ceil(F.col("top.m") / CHUNK).cast("int").alias("tops"), F.ceil((F.col("n") - F.col("top.m")) / CHUNK).cast("int").alias("others")), "most")


def _apart(rows: DataFrame, often: int) -> DataFrame:
    """Rows (token, cls, label, ...) dealt into buckets (token, i, j, side) where sets of different labels meet; lists of one label go.

    The sets of a list's most frequent label lie in chunks of their own, which meet the chunks of the other sets but not each other.
    """
    met = joined(rows, _most(rows), ["token"], F.col("n") > often).withColumn("is_top", F.col("label") == F.col("top"))
    own = met.withColumn("own", F.when(F.col("is_top"), -1 - F.pmod(F.xxhash64("cls"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("others"))).cast("int"))
    # Chunks of the most frequent label have numbers below 0.
    other = F.explode(F.sequence(F.when(F.col("is_top"), 0).otherwise(-F.col("tops")), F.col("others") - 1))
    dealt = own.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    return dealt.drop("n", "top", "tops", "others", "is_top", "own", "other")


def _alone(rule: Sketches):
    """Keeps the kinds of which two sets may be linked."""

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            size = rows["size"].to_numpy(np.int64)
            yield rows.loc[rule.kept(size) - rows["pos"].to_numpy(np.int64) >= rule.needed(size, size), ["token", "kind"]]

    return alone


def _placed(rows: DataFrame, rule: Sketches, often: int) -> DataFrame:
    """Rows (token, cls, pos) of rows (token, cls, size, pos, label): the sets that size and place let be linked with another of their list, where those of its most frequent label do not meet each other.

    Sets of one list that agree in size, place and whether theirs is that label are one kind, and kinds meet in their stead: a large group of
    sets that are alike is few kinds, however many sets it has.
    """
    top = F.col("label") == F.col("top")
    known = joined(rows, _most(rows).select("token", "n", "top"), ["token"], F.col("n") > often)
    # A kind's number is odd where its sets have the most frequent label.
    known = written(known.select("token", "cls", "size", "pos", ((F.col("size") * rule.held + F.col("pos")) * 2 + top.cast("long")).alias("kind")), "kinds-of-sets")
    kinds = written(known.groupBy("token", "kind", "size", "pos").agg(F.count(F.lit(1)).alias("sets")), "kinds")
    odd = F.col("kind") % 2 == 1
    alone = kinds.filter(~odd & (F.col("sets") > 1)).mapInPandas(_alone(rule), "token long, kind long")
    apart = _apart(kinds.select("token", F.col("kind").alias("cls"), "size", "pos", F.when(odd, -1).otherwise(F.col("kind")).alias("label")), often)
    met = _together(apart.withColumnRenamed("cls", "grp")).mapInPandas(_partners(rule), "token long, grp long, pos long").select("token", F.col("grp").alias("kind"))
    chosen = written(kinds.join(alone.union(met).distinct(), ["token", "kind"], "left_semi").select("token", "kind", "sets"), "kinds-met")
    return joined(known, chosen, ["token", "kind"], F.col("sets") > often).select("token", "cls", "pos")


def _linkable(rule: Sketches):
    """Of each bucket's sets those whose bitmaps allow a link with another of a different label."""

    def linkable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_buckets(batches):
            size, label, chosen = rows["size"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), np.zeros(len(rows), dtype=bool)
            bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(len(rows), -1)
            for a, b in _paired(rows, rule):
                open_ = (label[a] != label[b]) & ~(chosen[a] & chosen[b])
                a, b = a[open_], b[open_]
                ok = rule.may_link(size[a], size[b], np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64))
                chosen[a[ok]] = chosen[b[ok]] = True
            yield rows.loc[chosen, ["token", "cls", "size", "pos", "bits", "label"]]

    return linkable


def _buckets(lists: DataFrame, sketches: DataFrame, labels: DataFrame, rule: Sketches, often: int) -> DataFrame:
    """(token, i, j, side, cls, size, pos, bits): the sets of different labels that meet in each inverted list; sets that no other can be linked with there, by size and place and then by bitmap, are left out first."""
    known = labels.select(F.col("node").alias("cls"), "label")
    label = lambda rows: rows.join(known, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    apart = written(label(lists), "lists-labels")
    bits = sketches.select("cls", "size", "bits")
    kept = written(label(_placed(apart, rule, often).join(bits, "cls").select("token", "cls", "size", "pos", "bits")), "met")
    close = _together(_apart(kept, often)).mapInPandas(_linkable(rule), "token long, cls long, size long, pos long, bits binary, label long")
    return _apart(written(close.dropDuplicates(["token", "cls"]), "close"), often).drop("label")


def _beside(pairs: DataFrame, sketches: DataFrame, columns: list[str], often: int) -> DataFrame:
    """pairs (a, b), written, with these columns of both sets' sketches, as a_... and b_...; sketches of other sets are not dealt out."""
    of = lambda side: [F.col(c).alias(f"{side}_{c}") for c in columns]
    counts = pairs.select("b", F.lit(1).alias("n")).union(pairs.select("a", F.lit(0))).groupBy(F.col("b").alias("met")).agg(F.sum("n").alias("n"))
    counts = written(counts, "met-counts")
    few = counts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    met = written(sketches.join(F.broadcast(counts) if few else counts, F.col("cls") == F.col("met")).select("cls", "n", *columns), "met-sketches")
    second = met.filter("n > 0").select(F.col("cls").alias("b"), "n", *of("b"))
    return joined(pairs, second, ["b"], F.col("n") > often).join(met.select(F.col("cls").alias("a"), *of("a")), "a")


def _near(rule: Sketches):
    """Keeps the pairs whose bitmaps are as alike as those of linked sets."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, y = (np.frombuffer(b"".join(rows[c]), dtype=np.uint64).reshape(len(rows), -1) for c in ("a_bits", "b_bits"))
            far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield rows.loc[rule.may_link(rows["a_size"].to_numpy(np.int64), rows["b_size"].to_numpy(np.int64), far), ["a", "b"]]

    return near


def _likely(sketches: DataFrame, rule: Sketches, often: int):
    """Keeps the pairs that may be linked by the estimate from the sketch of their union."""

    def likely(pairs: DataFrame) -> DataFrame:
        union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, rule.held)
        met = _beside(written(pairs, "pairs"), sketches, ["sketch"], often).withColumn("u", union).withColumn("both", F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), "u")))
        return met.filter(F.when(F.size("u") == rule.held, F.col("both") >= rule.least()).otherwise(100 * F.col("both") >= rule.percent * F.size("u"))).select("a", "b")

    return likely


def minhash_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", held: int = KEPT) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that links reach), kept (the id is its component's).

    Documents link when their n-gram sets' intersection is at least percent % of their union.
    """
    spark, rule = docs.sparkSession, Sketches(percent, held)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    survey = written(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketched(n, held), SKETCHED), "survey")
    counted = spark.sparkContext.broadcast(sketch_of(survey))
    rows = survey.filter("segment is null").select("id", "text_hash", "size", "cls")
    classes = written(classes_of(rows), "classes")
    sketches = written(survey.filter("bits is not null").select("cls", "size", "bits", "sketch").dropDuplicates(["cls", "size"]), "sketches")
    filed = written(sketches.select("cls", "size", "sketch").mapInArrow(_file(counted, rule), "token long, cls long, size long, pos long"), "filed")
    counted.destroy()
    lists, heads = _lists(filed)
    # Lists and hubs of more rows than this go to all tasks where they are joined: a few for each partition.
    often = max(CHUNK, lists.count() // (4 * partitions(spark)))
    likely = _likely(sketches, rule, often)
    to_hubs = _beside(written(_to_hubs(lists, heads, rule, often), "to-hubs"), sketches, ["size", "bits"], often)
    hubs = written(likely(to_hubs.mapInPandas(_near(rule), "a long, b long")), "hub-pairs")
    labels = written(components(linked_pairs(texts, classes, hubs, n, percent)), "hub-labels")
    buckets = written(_buckets(lists, sketches, labels, rule, often), "buckets")
    out = with_components(rows, classes, linked_labels(texts, classes, buckets, n, rule, likely, labels))
    named = out.select(F.col("id"), F.col("size").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))
    return named.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=85)
