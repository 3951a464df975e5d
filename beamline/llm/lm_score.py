"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

All words and pairs of the training documents are counted. The filter is dealt into segments by n-gram;
an n-gram of count c is entered into its segment once for each level up to 1 + floor(log c), so that
probing levels in turn until one is missing gives its quantised count. The number of segments follows the
number of tokens, and each segment's size the entries it holds, so nothing is left out at any size of the
corpus. A filter of up to BROADCAST_FILTER bytes goes to all tasks; a larger one stays where it lies, and
tasks send the distinct n-grams of each slice to the segments' owners and get their levels back. Both ways
probe the same bits and give the same scores.

A token's probability is (pair + PRIOR * word) / (before + PRIOR): pair is the least count of the pair's
level, before the greatest count of the level of the word before it, and word the smoothed estimate from
the least count of the word's level. After no word do these sum to more than 1, but for what the
filter's false positives (1 in 2**PROBES) add; after an unknown word the word estimate stands alone.

The exact base score takes frequent words from a table of fixed size and joins all others by a shuffle.

Defined cases: a null text is empty and has the end token alone; a null id counts as the empty text
when documents are dealt to training; rows that repeat an id are scored each; without training documents
every known count is 0; an empty table gives no rows; other columns are ignored. Words are told apart by
64-bit hashes, n-grams by 32 bits and their segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textbytes import SLICE_BYTES, Bytes, mix, slices

#: Frequent words whose exact counts all tasks hold for the base score, 16 bytes each; it decides the cost, never the result.
VOCABULARY = 1 << 18
#: A filter of more bytes than this is not sent to all tasks.
BROADCAST_FILTER = 1 << 26
#: N-grams of a segment at most, on average.
SEGMENT_GRAMS = 1 << 20
PROBES = 4
#: Counts are quantised in powers of this.
LEVEL = 1.5
#: Weight of the word estimate, in words before the token.
PRIOR = 2.0
#: Tokens that are counted together in a task before they are passed on.
COUNTED_TOGETHER = 2_000_000
#: Bytes of text whose n-grams are sent to the segments together.
ASKED_TOGETHER = 4_000_000
_END, _START = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_TURN = np.uint64(0x9FB21C651E98DF25)


class Vocabulary:
    """Sorted hashes of the frequent words with their counts; the word ids are places in it."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.bits = max(1, len(words).bit_length())
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.append(np.searchsorted(self.words, edges), len(words))
        self.deep = int(np.diff(self.first).max(initial=0))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 where it is none of these words."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        top = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        todo = np.flatnonzero(at < stop)
        for _ in range(self.deep):
            hit = self.words[at[todo]] == hashes[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log(count)) in powers of LEVEL, for counts of 1 and more."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(LEVEL) + 1e-9).astype(np.int64)


def least_count(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    level = np.asarray(level, dtype=np.float64)
    return np.where(level > 0, np.ceil(LEVEL ** (level - 1) - 1e-6), 0.0)


def greatest_count(level: np.ndarray) -> np.ndarray:
    """The greatest count of a level; 0 for level 0."""
    level = np.asarray(level, dtype=np.float64)
    return np.where(level > 0, np.maximum(least_count(level), np.ceil(LEVEL**level - 1e-6) - 1), 0.0)


def gram_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The 64-bit key of each pair of neighbours; a word alone has its own hash, turned."""
    return mix(before * _TURN + words)


def split_keys(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segment in the upper 32 bits and the key within it in the lower: all that n-grams are told apart by."""
    return ((keys >> np.uint64(32)) % np.uint64(segments) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _places(keys: np.ndarray, level: int, sizes: np.ndarray | np.uint64, probes: int) -> Iterator[np.ndarray]:
    """The bits of each key (the lower 32 bits) at a level, in a segment of that size."""
    a = mix((keys & np.uint64(0xFFFFFFFF)) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    step = (a >> np.uint64(32)) | np.uint64(1)
    return (((a & np.uint64(0xFFFFFFFF)) + np.uint64(i) * step) % sizes for i in range(probes))


def segment_bits(keys: np.ndarray, counts: np.ndarray, probes: int = PROBES) -> bytes:
    """The filter of one segment: about half of its bits are set."""
    top = levels(counts)
    size = max(64, -(-int(top.sum() * probes / math.log(2)) // 64) * 64)
    bits = np.zeros(size, dtype=np.uint8)
    for level in range(1, int(top.max(initial=0)) + 1):
        for p in _places(keys[top >= level], level, np.uint64(size), probes):
            bits[p.astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


class Filter:
    """Segments' bits one after the other; a segment without n-grams has none."""

    def __init__(self, segments: dict[int, bytes], count: int, probes: int = PROBES):
        sizes = np.zeros(count, dtype=np.int64)
        for k, bits in segments.items():
            sizes[k] = len(bits)
        self.sizes, self.starts, self.probes = sizes * 8, (np.cumsum(sizes) - sizes) * 8, probes
        self.bits = np.frombuffer(b"".join(segments[k] for k in sorted(segments)), dtype=np.uint8)

    def probe(self, split: np.ndarray) -> np.ndarray:
        """The level of each split key: how many levels in turn are members."""
        segment = (split >> np.uint64(32)).astype(np.int64)
        size, start = self.sizes[segment], self.starts[segment]
        out, todo, level = np.zeros(len(split), dtype=np.int64), np.flatnonzero(size > 0), 1
        while len(todo):
            inside = todo
            for i, p in enumerate(_places(split[todo], level, size[todo].astype(np.uint64), self.probes)):
                at = start[inside] + (p if not i else p[where]).astype(np.int64)
                hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                where = np.flatnonzero(hit) if not i else where[hit]
                inside = inside[hit]
                if not len(inside):
                    break
            todo = inside
            out[todo] = level
            level += 1
        return out


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["w", "c"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in (y for x in batches for y in slices(x)):
        data = Bytes(batch.column("text"), lower=True)
        starts, ends, _ = data.words()
        held.append(data.hashes(starts, ends).view(np.int64))
        n += len(starts)
        if n >= COUNTED_TOGETHER:
            yield _counted(held)
            held, n = [], 0
    if n:
        yield _counted(held)


def _with_ends(data: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words and ends, those before them, document)."""
    starts, ends, firsts = data.words()
    per = np.diff(firsts) + 1
    doc = np.repeat(np.arange(len(per)), per)
    stop = np.cumsum(per) - 1
    inner = np.ones(len(doc), dtype=bool)
    inner[stop] = False
    words = np.full(len(doc), _END, dtype=np.uint64)
    words[inner] = data.hashes(starts, ends)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[stop - per + 1] = _START
    return words, before, doc


def _single(words: np.ndarray) -> np.ndarray:
    return mix(words ^ _TURN)


def _packed(held: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct split keys with their counts, one row a segment; sorted keys go as compressed gaps."""
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    segment = (keys >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(segment, prepend=-1))
    low, counts = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts.astype(np.uint32)
    rows = [(int(segment[a]), b - a, pa.compress(np.diff(low[a:b], prepend=np.uint32(0)).tobytes(), codec="zstd", asbytes=True), pa.compress(counts[a:b].tobytes(), codec="zstd", asbytes=True)) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)])]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["segment", "n", "keys", "counts"])


def _unpacked(n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint32)


def _count_grams(segments: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (y for x in batches for y in slices(x)):
            words, before, _ = _with_ends(Bytes(batch.column("text"), lower=True))
            held += [split_keys(k, segments) for k in (_single(words), _single(before[before == _START]), gram_keys(before, words))]
            n += len(words)
            if n >= COUNTED_TOGETHER:
                yield _packed(held)
                held, n = [], 0
        if n:
            yield _packed(held)

    return count


def _segment_of(probes: int):
    def built(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(_unpacked(n, k), dtype=np.uint32) for n, k in zip(rows["n"], rows["keys"])])
        counts = np.concatenate([_unpacked(n, c) for n, c in zip(rows["n"], rows["counts"])])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        firsts = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        bits = segment_bits(keys[firsts].astype(np.uint64), np.add.reduceat(counts, firsts), probes)
        return pd.DataFrame({"segment": rows["segment"][:1].to_numpy(), "size": [len(bits)], "bits": [bits]})

    return built


def _log_probabilities(pair: np.ndarray, word: np.ndarray, before: np.ndarray, norm: float) -> np.ndarray:
    """log10 of each token's probability, from the levels of the pair, of the word and of the word before."""
    top = np.arange(max(int(x.max(initial=0)) for x in (pair, word, before)) + 1)
    low, high = least_count(top), greatest_count(top)
    return np.log10((low[pair] + PRIOR * (low[word] + 0.1) / norm) / (high[before] + PRIOR))


DOC_FIELDS = "row long, id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<long>"
ASK_FIELDS = "slice long, segment long, n long, keys binary, rows array<long>, lengths array<long>, places binary"


def _nulls(fields: str, k: int) -> list[pa.Array]:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return [pa.nulls(k, types[x.split()[1]]) for x in fields.split(", ")]


def _questions(words: np.ndarray, before: np.ndarray, doc: np.ndarray, rows: pa.Array, segments: int, slice_: int) -> list[pa.Array]:
    """Of a slice one row of distinct n-grams for each segment to ask, and one of its tokens as places among them."""
    zip_ = lambda x: pa.compress(x.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
    grams = split_keys(np.concatenate([gram_keys(before, words), _single(words), _single(np.array([_START]))]), segments)
    keys, places = np.unique(grams, return_inverse=True)
    segment = (keys >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(segment, prepend=-1)).tolist()
    ends = [*edges[1:], len(keys)]
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    k, lengths = len(edges), np.bincount(doc, minlength=len(rows))
    return [
        pa.array([slice_] * (k + 1)), pa.array([*segment[edges].tolist(), None], pa.int64()), pa.array([*(b - a for a, b in zip(edges, ends)), len(words)]),
        pa.array([*(zip_(np.diff(low[a:b], prepend=np.uint32(0))) for a, b in zip(edges, ends)), None], pa.binary()), pa.array([None] * k + [rows.to_pylist()], pa.list_(pa.int64())),
        pa.array([None] * k + [lengths.tolist()], pa.list_(pa.int64())), pa.array([None] * k + [zip_(places)], pa.binary()),
    ]


def _score(shared, filter_, norm: float, trained: int, segments: int):
    """Rows with the base score of frequent words, the hashes of other words, and the score if the filter is here, else questions to its segments."""
    names = [x.split()[0] for x in f"{DOC_FIELDS}, {ASK_FIELDS}".split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = np.int64(TaskContext.get().partitionId()) << 40, 0
        vocabulary = shared.value
        base_of = np.log10((vocabulary.counts + 0.1) / norm)
        end_base, end_known = math.log10((trained + 0.1) / norm), int(trained > 0)
        for batch in (y for x in batches for y in slices(x, limit=SLICE_BYTES if filter_ else ASKED_TOGETHER)):
            words, before, doc = _with_ends(Bytes(batch.column("text"), lower=True))
            k = batch.num_rows
            if filter_ is None:
                asked = _questions(words, before, doc, batch.column("row"), segments, int(part) + nth)
                yield pa.RecordBatch.from_arrays([*_nulls(DOC_FIELDS, len(asked[0])), *asked], names=names)
                nth += 1
                scores = np.zeros(k)
            else:
                held: Filter = filter_.value
                distinct, of = np.unique(np.concatenate([words, before]), return_inverse=True)
                alone = held.probe(split_keys(_single(distinct), segments))[of]
                pairs, at = np.unique(gram_keys(before, words), return_inverse=True)
                p = _log_probabilities(held.probe(split_keys(pairs, segments))[at], alone[: len(words)], alone[len(words) :], norm)
                scores = np.bincount(doc, weights=p, minlength=k).astype(np.float64)
            inner = words != _END
            ids, of_doc = vocabulary.ids(words[inner]), doc[inner]
            head = ids >= 0
            at = np.concatenate([[0], np.cumsum(np.bincount(of_doc[~head], minlength=k))]).astype(np.int32)
            base = np.bincount(of_doc[head], weights=base_of[ids[head]], minlength=k).astype(np.float64) + end_base
            columns = [batch.column("row"), batch.column("id"), batch.column("held_out"), pa.array(np.bincount(doc, minlength=k)), pa.array(np.bincount(of_doc[head], minlength=k) + end_known), pa.array(base), pa.array(scores), pa.ListArray.from_arrays(pa.array(at), pa.array(words[inner][~head].view(np.int64)))]
            yield pa.RecordBatch.from_arrays([*columns, *_nulls(ASK_FIELDS, k)], names=names)

    return score


def _answer(probes: int):
    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """Levels of the n-grams that slices ask of one segment."""
        here = Filter({0: held["bits"].iloc[0]}, 1, probes) if len(held) else None
        found = []
        for n, keys in zip(asked["n"], asked["keys"]):
            level = here.probe(np.cumsum(_unpacked(n, keys), dtype=np.uint64)) if here else np.zeros(n, dtype=np.int64)
            found.append(pa.compress(level.astype(np.uint8).tobytes(), codec="zstd", asbytes=True))
        return pd.DataFrame({"slice": asked["slice"], "segment": asked["segment"], "n": asked["n"], "levels": found}, columns=["slice", "segment", "n", "levels"])

    return answer


def _finish(norm: float):
    def finish(slice_: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("segment")
        found = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=int(n), codec="zstd", asbytes=True), dtype=np.uint8) for n, x in zip(answers["n"], answers["levels"])]).astype(np.int64)
        me = slice_.iloc[0]
        n, lengths = int(me["n"]), np.asarray(me["lengths"])
        level = found[_unpacked(2 * n + 1, me["places"])]
        pair, word, before = level[:n], level[n : 2 * n], np.empty(n, dtype=np.int64)
        before[1:] = word[: n - 1]
        before[np.cumsum(lengths) - lengths] = level[2 * n]
        p = _log_probabilities(pair, word, before, norm)
        return pd.DataFrame({"row": np.asarray(me["rows"]), "asked": np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=p, minlength=len(lengths))})

    return finish


def _asked_scores(asked: DataFrame, filter_: DataFrame, probes: int, norm: float) -> DataFrame:
    """(row, asked): scores by asking the segments where they lie."""
    to = asked.filter("segment is not null").select("slice", "segment", "n", "keys")
    answers = written(to.groupBy("segment").cogroup(filter_.groupBy("segment")).applyInPandas(_answer(probes), "slice long, segment long, n long, levels binary"), "answers")
    slices_ = asked.filter("segment is null").select("slice", "n", "rows", "lengths", "places")
    return slices_.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(_finish(norm), "row long, asked double")


def held_out_of(id_: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % parts == part


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10, vocabulary: int = VOCABULARY, broadcast_filter: int = BROADCAST_FILTER, segment_grams: int = SEGMENT_GRAMS, probes: int = PROBES) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32 of the id as text is not 0 modulo parts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out_of(F.col(id_col), parts, 0).alias("held_out"))
    training = texts.filter("not held_out").select("text")
    counts = written(training.mapInArrow(_count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "words")
    trained = docs.filter(~held_out_of(F.col(id_col), parts, 0)).count()
    level = F.floor(F.log2("c") * 8)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("all")).orderBy(F.desc("level")).collect()  # some 8 rows for each doubling of the greatest count
    total, distinct = trained + sum(r["all"] for r in sizes), (1 if trained else 0) + sum(r["n"] for r in sizes)
    norm = total + 0.1 * (distinct + 1)
    least, n = math.inf, 0
    for r in sizes:
        n += r["n"]
        if n > vocabulary:
            break
        least = r["level"]
    head = counts.filter(level >= F.lit(float(least))).toPandas()  # vocabulary rows at most
    shared = spark.sparkContext.broadcast(Vocabulary(head["w"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)))
    segments = max(1, -(-(total + distinct) // segment_grams))
    filter_ = written(training.mapInArrow(_count_grams(segments), "segment long, n long, keys binary, counts binary").groupBy("segment").applyInPandas(_segment_of(probes), "segment long, size long, bits binary"), "filter")
    whole = None
    if (filter_.agg(F.sum("size")).first()[0] or 0) <= broadcast_filter:
        # broadcast_filter bytes at most, fetched part by part.
        whole = spark.sparkContext.broadcast(Filter({r["segment"]: bytes(r["bits"]) for r in filter_.toLocalIterator()}, segments, probes))
    rows = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(shared, whole, norm, trained, segments), f"{DOC_FIELDS}, {ASK_FIELDS}")
    rows = written(rows, "scores")
    for sent in (shared, whole):
        if sent is not None:
            sent.destroy()
    scored = rows.filter("slice is null").select(*[x.split()[0] for x in DOC_FIELDS.split(", ")])
    if whole is None:
        asked = _asked_scores(rows.filter("slice is not null"), filter_, probes, norm).withColumnRenamed("row", "a")
        scored = scored.drop("score").join(asked, F.col("row") == F.col("a")).withColumnRenamed("asked", "score")
    rare = counts.filter(level < F.lit(float(least))).select(F.col("w").alias("t"), "c")
    tail = scored.select("row", F.explode("tail").alias("w")).join(rare, F.col("w") == F.col("t"), "left")
    sums = tail.groupBy("row").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(norm))).alias("b"), F.count("c").alias("k")).withColumnRenamed("row", "r")
    joined = scored.drop("tail").join(sums, F.col("row") == F.col("r"), "left")
    return joined.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), "score")


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
