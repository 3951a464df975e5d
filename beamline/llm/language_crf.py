"""Language of whole texts by a linear-chain conditional random field over their words.

A word's features are hashed: affixes of 1 to 4 bytes, byte trigrams, and the word itself (a learned
lexicon). Weights and transitions are fitted on code-switched sequences made of labelled documents; a
text's words are labelled by forward-backward, and its language is the label of the greatest summed
probability. Long texts are cut into stretches whose transfer matrices are multiplied first, so
forward-backward runs over whole texts, many stretches at once.

Defined cases: a null text, or one without a letter, is "und" with score 0; without labelled documents
all are "und"; a null id counts as the empty text when documents are held out; equal sums go to the
first language in order; rows that repeat an id are judged each, and learned from each where their texts
differ; texts are judged whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .lm_score import held_out_of
from .shared import unit_hash, written
from .textbytes import Bytes, slices

#: Labelled documents that the field is fitted on, as many of each language, the first by the hash of their ids and texts (20 of each at least).
FITTED_DOCUMENTS = 600
#: Bytes of such a document at most; of a longer one pieces are taken at even distances.
FITTED_BYTES = 12_000
PIECE_BYTES = 400
FEATURES = 1 << 18
STRETCH = 32
ROUNDS = 25
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
_SALTS = np.arange(10, dtype=np.uint64) * _SALT


def _cores(data: Bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word from its first to its last letter; empty where it has none."""
    letters = _LETTER[data.data]
    n = len(letters)
    at = np.arange(n)
    following = np.minimum.accumulate(np.where(letters, at, n)[::-1])[::-1] if n else at
    preceding = np.maximum.accumulate(np.where(letters, at, -1)) if n else at
    lo = np.minimum(following[starts], ends)
    hi = np.maximum(preceding[ends - 1] + 1, lo)
    return lo, hi


class WordFeatures:
    """The distinct words of a slice, with their hashed features as one flat list."""

    def __init__(self, data: Bytes):
        starts, ends, self.firsts = data.words()
        lo, hi = _cores(data, starts, ends)
        hashes = data.hashes(lo, hi)
        self.real = hi > lo
        self.words, where, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        lo, hi = lo[where], hi[where]
        length, rows, cols, n = hi - lo, [], [], np.arange(len(lo))

        def add(kind: int, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
            rows.append(of)
            cols.append(((data.hashes(a, b) ^ _SALTS[kind]) * _SALT >> np.uint64(46)).astype(np.int64))

        ok = length > 0
        add(0, lo[ok], hi[ok], n[ok])
        for k in range(1, 5):
            ok = length >= k
            add(k, lo[ok], lo[ok] + k, n[ok])
            add(k + 4, hi[ok] - k, hi[ok], n[ok])
        count = np.maximum(length - 2, 0)
        inner = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        add(9, inner, inner + 3, np.repeat(n, count))
        self.rows, self.cols = np.concatenate(rows), np.concatenate(cols)
        self.weight = 1.0 / np.sqrt(np.maximum(1, np.bincount(self.rows, minlength=len(n))))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(distinct words, languages)"""
        out = np.stack([np.bincount(self.rows, weights=weights[self.cols, k], minlength=len(self.words)) for k in range(weights.shape[1])], axis=1)
        return out * self.weight[:, None]

    def gradient(self, by_word: np.ndarray) -> np.ndarray:
        by_word = by_word * self.weight[:, None]
        return np.stack([np.bincount(self.cols, weights=by_word[self.rows, k], minlength=FEATURES) for k in range(by_word.shape[1])], axis=1)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def posteriors(emission: np.ndarray, firsts: np.ndarray, transition: np.ndarray, stretch: int = STRETCH, steps: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over every sequence: the probability of each label at each word.

    emission: log-potentials of the words; sequence i is firsts[i]:firsts[i + 1]; before its first word stands a label of uniform weight.
    steps, if given, gets the expected number of each step between neighbours added.
    """
    n, k = emission.shape
    out = np.zeros((n, k))
    if not n:
        return out
    step = np.exp(transition - transition.max())
    per = np.diff(firsts)
    stretches = -(-per // stretch)
    base = np.cumsum(stretches) - stretches
    owner = np.repeat(np.arange(len(per)), stretches)
    lo = firsts[owner] + (np.arange(len(owner)) - base[owner]) * stretch
    size = np.minimum(firsts[owner + 1] - lo, stretch)
    m = len(lo)
    potential = np.exp(emission - emission.max(axis=1, keepdims=True))
    alive = [np.flatnonzero(size > t) for t in range(int(size.max()))]
    # What each stretch does to the vector that enters it.
    through = np.tile(np.eye(k), (m, 1, 1))
    for t, rows in enumerate(alive):
        moved = (through[rows].reshape(-1, k) @ step).reshape(-1, k, k) * potential[lo[rows] + t][:, None, :]
        through[rows] = moved / moved.sum(axis=(1, 2), keepdims=True)
    # Entering vectors of all stretches, from the left and from the right.
    left, right = np.full((m, k), 1.0 / k), np.full((m, k), 1.0 / k)
    longest = int(stretches.max())
    by_length = np.argsort(-stretches, kind="stable")
    having = np.searchsorted(-stretches[by_length], -np.arange(1, longest + 1), "right")
    for j in range(1, longest):
        at = base[by_length[: having[j]]] + j
        left[at] = _normal(np.einsum("ik,ikl->il", left[at - 1], through[at - 1]))
        at = base[by_length[: having[j]]] + stretches[by_length[: having[j]]] - 1 - j
        right[at] = _normal(np.einsum("ikl,il->ik", through[at + 1], right[at + 1]))
    forward = left
    for t, rows in enumerate(alive):
        forward[rows] = _normal((forward[rows] @ step) * potential[lo[rows] + t])
        out[lo[rows] + t] = forward[rows]
    inner = np.ones(n, dtype=bool)
    inner[firsts[:-1][per > 0]] = False
    backward, ahead = right, out.copy() if steps is not None else out
    for t in range(len(alive) - 1, -1, -1):
        rows = alive[t]
        at = lo[rows] + t
        if steps is not None:
            to = inner[at]
            joint = ahead[at[to] - 1][:, :, None] * step * (potential[at] * backward[rows])[to][:, None, :]
            steps += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        out[at] = _normal(out[at] * backward[rows])
        backward[rows] = _normal((backward[rows] * potential[at]) @ step.T)
    return out


class LanguageField:
    """Weights of the hashed features and of the transitions between labels."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.weights, self.transition = languages, weights, transition

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities of each word's label, which words have a letter, the first word of each text)"""
        words = WordFeatures(Bytes(texts, lower=True))
        return posteriors(words.scores(self.weights)[words.of], words.firsts, self.transition), words.real, words.firsts


def fit(texts: list[str], languages: list[str], rounds: int = ROUNDS) -> LanguageField:
    """Maximum likelihood by adaptive gradient steps, over sequences that switch between runs of documents' words."""
    names = sorted(set(languages))
    words = WordFeatures(Bytes(pa.array(texts, pa.string()), lower=True))
    k = len(names)
    gold_of = np.array([names.index(x) for x in languages], dtype=np.int64)
    rng = np.random.default_rng(5)
    # Runs of 5 to 60 words in random order: neighbours often differ in language.
    runs = []
    for d, (a, b) in enumerate(zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist())):
        while a < b:
            to = min(b, a + int(rng.integers(5, 61)))
            runs.append((a, to, d))
            a = to
    order = rng.permutation(len(runs))
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(runs[i][0], runs[i][1]) for i in order]])
    gold = np.concatenate([np.zeros(0, np.int64), *[np.full(runs[i][1] - runs[i][0], gold_of[runs[i][2]]) for i in order]])
    n = len(place)
    firsts = np.append(np.arange(0, n, 2 * STRETCH), n)
    of, real = words.of[place], words.real[place]
    weights, transition = np.zeros((FEATURES, k)), np.eye(k) * 2.0
    seen_w, seen_t = np.full((FEATURES, k), 1e-8), np.full((k, k), 1e-8)
    target = np.zeros((n, k))
    target[np.arange(n), gold] = 1.0
    inner = np.ones(n, dtype=bool)
    inner[firsts[:-1]] = False
    follow = np.flatnonzero(inner)
    gold_steps = np.zeros((k, k))
    np.add.at(gold_steps, (gold[follow - 1], gold[follow]), 1.0)
    for _ in range(rounds if n else 0):
        emission = words.scores(weights)[of]
        expected = np.zeros((k, k))
        p = posteriors(emission, firsts, transition, steps=expected)
        off = (target - p) * real[:, None]
        by_word = np.stack([np.bincount(of, weights=off[:, j], minlength=len(words.words)) for j in range(k)], axis=1)
        g = words.gradient(by_word) - 0.01 * weights
        t = gold_steps - expected
        seen_w += g * g
        seen_t += t * t
        weights += 0.5 * g / np.sqrt(seen_w)
        transition += 0.2 * t / np.sqrt(seen_t)
    return LanguageField(names, weights.astype(np.float32).astype(np.float64), transition)


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in batches for y in slices(x)):
            field: LanguageField = shared.value
            p, real, firsts = field.label(batch.column("text"))
            sums = np.vstack([np.zeros((1, p.shape[1])), np.cumsum(p * real[:, None], axis=0)])
            total = sums[firsts[1:]] - sums[firsts[:-1]]
            n = total.sum(axis=1)
            best = total.argmax(axis=1)
            ok = np.array(batch.column("lettered").to_pylist(), dtype=bool) & (n > 0.5)
            score = np.where(ok, np.clip(total[np.arange(len(best)), best] / np.maximum(n, 1e-9), 0.0, 1.0), 0.0)
            names = [field.languages[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["row", "held_out", "lang_pred", "score"])

    return predict


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of more than FITTED_BYTES as pieces taken at even distances over the whole text."""
    for batch in batches:
        texts = []
        for text in batch.column("text").to_pylist():
            raw = text.encode()
            if len(raw) > FITTED_BYTES:
                last, n = len(raw) - PIECE_BYTES, FITTED_BYTES // PIECE_BYTES
                text = " ".join(raw[last * i // (n - 1) :][:PIECE_BYTES].decode(errors="ignore") for i in range(n))
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(texts, pa.string())], names=["lang", "h", "text"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    if rows:
        field = fit([r["text"] for r in rows], [r["lang"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([field.languages]), pa.array([field.weights.astype(np.float32).tobytes()]), pa.array([field.transition.tobytes()])], names=["languages", "weights", "transition"])


def sample_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, documents: int = FITTED_DOCUMENTS) -> DataFrame:
    """(lang, h, text): of each language the labelled documents with the smallest hashes outside the held-out part.

    Rows that repeat id, text and language count once. As many documents of each language are taken,
    `documents` in all or 20 of each, so that no language is lost; long texts are shortened.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out_of(F.col(id_col), parts, part))
    chosen = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    # Ids first, then the texts of those chosen alone. Hashes that are sure to rank lower leave before the ranking, so that
    # few rows of a language meet in a task.
    counts = written(chosen.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    each = max(20, documents // max(1, counts.count()))
    near = chosen.join(F.broadcast(counts), "lang").filter(unit_hash(F.col("h")) * F.col("n") < 2.0 * each).select("lang", "h").distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy(unit_hash(F.col("h")), "h"))
    ids = written(near.withColumn("place", place).filter(F.col("place") <= each).select(F.col("lang").alias("l"), F.col("h").alias("k")), "sample")
    picked = chosen.join(F.broadcast(ids), (F.col("h") == F.col("k")) & (F.col("lang") == F.col("l")), "left_semi")
    return picked.mapInArrow(_shortened, "lang string, h long, text string").dropDuplicates(["lang", "h"])


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, documents: int = FITTED_DOCUMENTS) -> LanguageField | None:
    """The field fitted on a bounded sample of the labelled documents outside the held-out part, in one task; the driver gets the weights."""
    rows = written(sample_of(docs, id_col, text_col, lang_col, parts, part, documents), "fitted-rows").coalesce(1).sortWithinPartitions("lang", "h", "text")
    got = rows.mapInArrow(_fitted, "languages array<string>, weights binary, transition binary").collect()
    if not got:
        return None
    names = list(got[0]["languages"])
    return LanguageField(names, np.frombuffer(got[0]["weights"], np.float32).reshape(FEATURES, -1).astype(np.float64), np.frombuffer(got[0]["transition"], np.float64).reshape(len(names), -1))


def judged(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row, held_out, lang_pred, score) of every row of docs; row is a struct of the named columns. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*columns).alias("row"), held_out_of(F.col(id_col), 4, 2).alias("held_out"), text.alias("text"), text.rlike("\\p{L}").alias("lettered"))
    field = fit_on(docs, id_col, text_col, lang_col)
    if field is None:
        return rows.select("row", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([rows.schema["row"], rows.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(field)), schema)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score; languages are learned from rows that are not held out."""
    return judged(docs, [id_col], id_col, text_col, lang_col).select(F.col(f"row.{id_col}").cast("long").alias(id_col), "held_out", "lang_pred", "score")


def op5_language_crf(spark, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
