"""Exact self-join of documents on the Jaccard similarity of their word n-grams, by grouped prefixes.

Equal sets are one class; classes of one size whose prefixes agree are one group. The prefix is taken in
a global order, rare n-grams first by a counting sketch over all documents. Groups that share a prefix
n-gram are paired by size and by place of that n-gram, then expanded to their classes, whose parity
bitmaps bound the overlap; what is left is verified on whole sets. A task gives the pairs that span what
it would connect and some to spare: pairs inside what is connected can change no component. Where a pair
fails and others were withheld, the next round gives more of them, until none is withheld, so no link
between components is missed. Postings of a frequent n-gram are dealt
into chunks, and chunk meets chunk in a task of its own.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing;
a text of fewer words than n is one n-gram; rows that repeat an id are separate rows with that id; a
null id never is a component's smallest unless all its ids are null; an empty table gives no rows; other
columns are ignored. N-grams and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, find
from .shared import fresh, partitions, written
from .textbytes import Bytes, mix, slices

#: Counters of the sketch that orders n-grams (4 bytes each); the order decides the cost, never the result.
SKETCH_BITS = 22
SEGMENTS = 64
BITMAP_BITS = 1024
#: Classes of one prefix n-gram that meet in one task at most, twice over.
CHUNK = 256
#: Candidate pairs beyond a spanning tree that a task gives for each class, so that a pair that fails seldom costs a round; each round gives eight times as many.
SPARE = 2
#: Classes to verify up to this number are sent to all tasks (16 MB of ids); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_TURN = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xDB4F0B9175AE2165)]


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct n-grams of lower-cased words."""
    data = Bytes(texts, lower=True)
    starts, ends, firsts = data.words()
    words = data.hashes(starts, ends)
    grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        grams += words[k : k + len(grams)] * _TURN[k % len(_TURN)] + np.uint64(k)
    grams = mix(grams + np.uint64(n))
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix(np.array([sum((words[a + k] * _TURN[k] for k in range(b - a)), np.uint64(b - a))], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def set_id(grams: np.ndarray) -> int:
    total = mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def bitmap(grams: np.ndarray) -> bytes:
    """The parity of the grams that fall on each bit: two bitmaps differ in no more bits than the sets in members."""
    return np.packbits(np.bincount((grams >> np.uint64(20)).astype(np.int64) % BITMAP_BITS, minlength=BITMAP_BITS).astype(np.uint8) & 1).tobytes()


SURVEYED = "id long, text_hash long, size long, cls long, segment int, counts binary"


def _survey(n: int):
    """Rows (id, size, cls) for documents, and at the end of each task its part of the sketch by segment."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        names = ["id", "text_hash", "size", "cls", "segment", "counts"]
        for batch in (y for x in batches for y in slices(x)):
            sizes, cls = [], []
            for grams in ngram_sets(batch.column("text"), n):
                np.add.at(counts, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                sizes.append(len(grams))
                cls.append(set_id(grams))
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        parts = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in np.split(counts, SEGMENTS)] if counts.any() else []
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return survey


def _summed(parts: pd.DataFrame) -> pd.DataFrame:
    size = (4 << SKETCH_BITS) // SEGMENTS
    total = sum((np.frombuffer(pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint32) for x in parts["counts"]), np.zeros(size // 4, dtype=np.uint32))
    return pd.DataFrame({"segment": parts["segment"][:1].to_numpy(), "counts": [total.tobytes()]})


def sketch_of(survey: DataFrame) -> np.ndarray:
    """The whole sketch, of fixed size."""
    rows = survey.filter("segment is not null").select("segment", "counts").groupBy("segment").applyInPandas(_summed, "segment int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for r in rows:
        out.reshape(SEGMENTS, -1)[r["segment"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


@dataclass(frozen=True)
class WholeSets:
    """What a pair must share where whole sets are indexed."""

    percent: int

    def kept(self, size: np.ndarray) -> np.ndarray:
        """Of a set of this size, how many members are indexed."""
        return size

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least number of indexed members that linked sets of these sizes share."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def may_link(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can be linked whose parity bitmaps differ in far bits."""
        return a + b - far >= 2 * self.needed(a, b)


def _postings(sketch, n: int, percent: int):
    """Of each class that a task meets for the first time: one row with its bitmap, and its group's postings once."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, classes, groups = sketch.value, set(), set()
        for batch in (y for x in batches for y in slices(x)):
            token, grp, cls, size, pos, bits = [], [], [], [], [], []
            for grams in ngram_sets(batch.column("text"), n):
                k = len(grams)
                me = set_id(grams) if k else 0
                if not k or (k, me) in classes:
                    continue
                classes.add((k, me))
                p = prefix_length(k, percent)
                order = np.lexsort((grams, counts[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:p]
                first = grams[order]
                group = int(mix(np.array([(mix(first) * (np.arange(p, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64) + np.uint64(k)], dtype=np.uint64)).view(np.int64)[0])
                token.append(np.zeros(1, np.int64)), grp.append(np.array([group])), cls.append(np.array([me])), size.append(np.array([k])), pos.append(np.array([-1])), bits.append(bitmap(grams))
                if group not in groups:
                    groups.add(group)
                    token.append(first.view(np.int64)), grp.append(np.full(p, group)), cls.append(np.full(p, 0)), size.append(np.full(p, k)), pos.append(np.arange(p)), bits.extend([None] * p)
            if token:
                columns = [pa.array(np.concatenate(x), pa.int64()) for x in (token, grp, cls, size, pos)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary())], names=["token", "grp", "cls", "size", "pos", "bits"])

    return postings


def _candidates(rule: WholeSets, spare_most: int):
    """Candidate pairs of each bucket that join what is not yet joined, and a few to spare.

    Rows (a, b) of classes, (la, lb) of their components so far, the tree of this task that they hang on,
    and whether candidates of that tree were withheld because its classes had their spare pairs.
    """

    def pairs_of(rows: pd.DataFrame, parent: dict[int, int], spare: dict[int, int], out: dict[tuple[int, int], tuple[int, int]], withheld: set[int]) -> None:
        size, cls, label = (rows[c].to_numpy(np.int64) for c in ("size", "cls", "label"))
        bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(len(rows), -1)
        for a, b in _paired(rows, rule):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            ok = rule.may_link(size[a], size[b], np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64))
            for x, y in zip(a[ok].tolist(), b[ok].tolist()):
                p, q = find(parent, int(label[x])), find(parent, int(label[y]))
                low, high = int(min(cls[x], cls[y])), int(max(cls[x], cls[y]))
                if (low, high) in out:
                    continue
                if p == q:
                    if spare.get(low, 0) >= spare_most or spare.get(high, 0) >= spare_most:
                        withheld.add(p)
                        continue
                    spare[low], spare[high] = spare.get(low, 0) + 1, spare.get(high, 0) + 1
                parent[max(p, q)] = min(p, q)
                out[low, high] = (int(label[x]), int(label[y]))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent, spare, out, withheld = {}, {}, {}, set()
        for rows in _whole_buckets(batches):
            pairs_of(rows, parent, spare, out, withheld)
        part, open_ = TaskContext.get().partitionId(), {find(parent, x) for x in withheld}
        rows = [(a, b, la, lb, part, tree := find(parent, la), int(tree in open_)) for (a, b), (la, lb) in out.items()]
        yield pd.DataFrame(rows, columns=["a", "b", "la", "lb", "part", "tree", "more"]).astype("int64")

    return candidates


def _whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames that never cut a bucket."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = rows[["token", "i", "j"]].to_numpy(np.int64)
        others = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(others[-1]) + 1 if len(others) else 0
        held = rows.iloc[cut:]
        if cut:
            yield rows.iloc[:cut]
    if held is not None and len(held):
        yield held


def _partners(rule: WholeSets):
    """Of each bucket's groups those that another may be paired with, by size and place."""

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_buckets(batches):
            chosen = np.zeros(len(rows), dtype=bool)
            for a, b in _paired(rows, rule):
                chosen[a] = chosen[b] = True
            yield rows.loc[chosen, ["token", "grp", "pos"]]

    return partners


def _paired(rows: pd.DataFrame, rule: WholeSets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within buckets, by distance in the sorted rows, that size and place allow."""
    key = rows[["token", "i", "j"]].to_numpy(np.int64)
    n = len(key)
    last = np.ones(n, dtype=bool)
    last[:-1] = (key[1:] != key[:-1]).any(axis=1)
    stop = np.flatnonzero(last)
    left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
    size, pos, side = (rows[c].to_numpy(np.int64) for c in ("size", "pos", "side"))
    mixed, room, percent = key[:, 1] != key[:, 2], rule.kept(size) - pos, rule.percent
    for d in range(1, int(left.max(initial=0)) + 1):
        a = np.flatnonzero(left >= d)
        b = a + d
        need = rule.needed(size[a], size[b])
        ok = (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])) & (np.minimum(room[a], room[b]) >= need) & (~mixed[a] | (side[a] != side[b]))
        yield a[ok], b[ok]


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in batches for y in slices(x)):
            got = list(ngram_sets(batch.column("text"), n))
            at = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in got], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), batch.column("wanted")], names=["cls", "grams", "wanted"])

    return sets


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows of each token of two or more rows, dealt into chunks; chunk i meets chunk j in bucket (token, i, j)."""
    many = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("token").alias("t"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "counts")
    own = rows.join(many, F.col("token") == F.col("t")).drop("t").withColumn("own", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other", "chunks")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")


def _buckets(postings: DataFrame, rule: WholeSets) -> DataFrame:
    """(token, i, j, side, cls, size, pos, bits): the classes that meet at each prefix n-gram, by chunks."""
    members = written(postings.filter("pos < 0").groupBy("grp", "cls", "size").agg(F.first("bits").alias("bits")), "members")
    tokens = postings.filter("pos >= 0").select("token", "grp", "size", "pos")
    shared = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("token").alias("t")), "shared")
    live = written(tokens.join(shared, F.col("token") == F.col("t")).select("token", "grp", "size", "pos").distinct(), "postings")
    paired = _together(_dealt(live, "grp")).mapInPandas(_partners(rule), "token long, grp long, pos long").distinct()
    inner = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.xxhash64("grp").alias("token"), "grp", F.lit(0).cast("long").alias("pos"))
    met = written(paired.union(inner), "group-pairs")
    return _dealt(written(met.join(members, "grp").select("token", "cls", "size", "pos", "bits"), "met"), "cls")


def classes_of(rows: DataFrame) -> DataFrame:
    """(cls, size, rep, probe) of rows (id, text_hash, size, cls): each set once, with its smallest id, and the id and hash of a text that has it."""
    return rows.filter("size > 0").groupBy("cls", "size").agg(F.min("id").alias("rep"), F.min(F.struct("id", "text_hash")).alias("probe"))


def linked_pairs(texts: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole sets are alike enough. A class's text is read by id and hash together, so rows that share an id don't meet."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct().join(classes, F.col("wanted") == F.col("cls")).select("wanted", F.col("probe.id").alias("p_id"), F.col("probe.text_hash").alias("p_hash")), "wanted")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(wanted) if few else wanted, (F.xxhash64("text") == F.col("p_hash")) & F.col("id").eqNullSafe(F.col("p_id"))).select("text", "wanted")
    sets = written(chosen.mapInArrow(_sets(n), "cls long, grams array<long>, wanted long").filter("cls = wanted").dropDuplicates(["cls"]).select("cls", "grams"), "sets")
    # A class that has more pairs than most meets them in pieces; four for each partition at most are so many.
    counts = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    often = max(CHUNK, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * partitions(texts.sparkSession)))
    counts = counts.withColumn("pieces", F.ceil(F.col("n") / often).cast("int"))
    dealt = pairs.join(F.broadcast(counts.filter("pieces > 1").select("b", "pieces")), "b", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("a"), F.col("pieces")).cast("int"), F.lit(0)))
    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    right = sets.join(counts, sets["cls"] == counts["b"]).select("b", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("grams").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return written(dealt.join(left, "a").join(right, ["b", "piece"]).filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "linked")


def linked_labels(texts: DataFrame, classes: DataFrame, buckets: DataFrame, n: int, rule: WholeSets, likely: Callable[[DataFrame], DataFrame] | None = None, labels: DataFrame | None = None) -> DataFrame | None:
    """(node, label): of each class that a bucket holds, the smallest class that links reach; None where no pair is found.

    buckets come from _buckets; likely, if given, keeps those of the pairs (a, b) that are worth a look at whole texts;
    labels, if given, say what is linked already.
    """
    spare = SPARE
    while True:
        now = buckets
        if labels is not None:
            now = written(now.join(labels, now["cls"] == labels["node"], "left").drop("node").withColumn("label", F.coalesce("label", "cls")), "labelled")
        else:
            now = now.withColumn("label", F.col("cls"))
        found = written(_together(now).mapInPandas(_candidates(rule, spare), "a long, b long, la long, lb long, part long, tree long, more long"), "found")
        pairs = found.select("a", "b").distinct()
        if not pairs.limit(1).count():
            break
        linked = linked_pairs(texts, classes, written(likely(pairs), "likely") if likely else pairs, n, rule.percent)
        # Components are contracted: a round joins only the labels of the rounds before.
        new = written(components(found.join(linked, ["a", "b"], "left_semi").select(F.col("la").alias("a"), F.col("lb").alias("b"))), "contracted")
        if labels is None:
            labels = new
        else:
            turned = new.select(F.col("node").alias("was"), F.col("label").alias("now"))
            known = labels.join(turned, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
            labels = written(known.union(new.join(labels.select("node"), "node", "left_anti")), "labels")
        # A tree whose pairs were all linked is settled, and so is one of which none was withheld; the rest meets again with more to spare.
        broken = found.filter("more = 1").join(linked, ["a", "b"], "left_anti").select("part", "tree").distinct()
        open_ = written(found.filter("more = 1").join(broken, ["part", "tree"], "left_semi").select(F.explode(F.array("la", "lb")).alias("open")).distinct(), "open")
        if not open_.limit(1).count():
            break
        buckets, spare = now.join(open_, F.col("label") == F.col("open"), "left_semi").drop("label"), spare * 8
    return labels


def with_components(rows: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows (id, text_hash, size, cls) with low, the smallest id of the row's component (null where the set is empty)."""
    if labels is None:
        of = classes.select(F.col("cls").alias("c"), F.col("size").alias("s"), F.col("rep").alias("low"))
    else:
        named = classes.join(labels, classes["cls"] == labels["node"], "left").select("cls", "size", "rep", F.coalesce("label", "cls").alias("label"))
        lows = named.groupBy("label").agg(F.min("rep").alias("low"))
        of = named.join(lows, "label").select(F.col("cls").alias("c"), F.col("size").alias("s"), "low")
    return rows.join(of, (F.col("cls") == F.col("c")) & (F.col("size") == F.col("s")), "left").select("id", "text_hash", "size", "cls", "low")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id, component_id (the smallest id that links reach), text_hash.

    Documents link when their n-gram sets' intersection is at least percent % of their union.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    survey = written(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_survey(n), SURVEYED), "survey")
    sketch = spark.sparkContext.broadcast(sketch_of(survey))
    rows = survey.filter("segment is null").select("id", "text_hash", "size", "cls")
    classes = written(classes_of(rows), "classes")
    postings = written(texts.select("text").mapInArrow(_postings(sketch, n, percent), "token long, grp long, cls long, size long, pos long, bits binary"), "prefixes")
    rule = WholeSets(percent)
    buckets = written(_buckets(postings, rule), "buckets")
    sketch.destroy()
    out = with_components(rows, classes, linked_labels(texts, classes, buckets, n, rule))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("cls")).alias("class_id"), F.coalesce("low", "id").alias("component_id"), "text_hash")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the rows with the smallest id, with all columns.

    Every row without words stays, and so do equal rows of the smallest id. Null and empty texts are without
    words; a null id is larger than any other; long texts are compared whole. An empty table gives an empty table; columns may have any names.
    """
    found = jaccard_components(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), n, percent)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct("doc_id", "text_hash").alias(name := fresh(docs.columns, "first"))).distinct()
    same = docs[id_col].cast("long").eqNullSafe(first[name]["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == first[name]["text_hash"])
    return docs.join(first, same, "left_semi")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")
