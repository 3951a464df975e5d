"""Importance resampling towards a target set: documents are drawn by how much likelier their n-grams are in the target.

Each document becomes rows (word run, times it occurs). Their strings are counted once over all documents and
over the target into one dictionary; each distinct string is hashed once, into a bucket; a bucket's gain is the
log ratio of its smoothed shares in target and documents; and the dictionary's gains are joined back to the
documents' rows. A document's weight is the mean of its gains; Gumbel noise from its id is added, and the
highest scores are drawn, which samples without replacement.

Strings that are in more than one in FREQUENT of all rows go to all tasks (no more than FREQUENT of them exist,
each of FREQUENT_BYTES at most), so no task gets all rows of a frequent word; the rest meets by a shuffle. Ranks
come from range partitions and their sizes.

Defined cases: a null or empty text has no features, a weight of 0 and is never drawn; whole texts are read;
rows that repeat an id are separate rows with equal noise; a null id counts as an empty string in the noise and
comes last among ties; repeated rows have ranks of their own; an empty target gives gains by the documents alone;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import CRC_TABLE_SQL, LOWER, UPPER, crc_sql, joined, numbered, partitions, written
from .textbytes import Bytes, slices

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
FREQUENT = 50_000
FREQUENT_BYTES = 64
#: ASCII but letters and digits stands between words.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FEATURES = "row long, id long, words long, feature string, n long"


def _strings(data: Bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice, and the number of its text of each."""
    starts, ends, firsts = data.words(BETWEEN)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    solid = ~BETWEEN[data.data]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data.data[solid])))
    return words, np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def _runs(words: pa.Array, text: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to n words within a text, joined by one space."""
    runs, owners = [words], [text]
    for k in range(2, n + 1):
        last = max(0, len(words) - k + 1)
        same = text[:last] == text[k - 1 : k - 1 + last]
        runs.append(pc.binary_join_element_wise(*[words.slice(i, last) for i in range(k)], pa.scalar(" ", words.type)).filter(pa.array(same)))
        owners.append(text[:last][same])
    return pa.concat_arrays(runs), np.concatenate(owners)


def _count(n: int):
    """Rows (row, id, words) for texts, and (row, feature, n) for the distinct features of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in (y for x in batches for y in slices(x)):
            k = batch.num_rows
            words, text = _strings(Bytes(batch.column("text"), lower=True))
            runs, owner = _runs(words, text, n)
            coded = runs.dictionary_encode()
            width = max(1, len(coded.dictionary))
            pairs, times = np.unique(owner * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            rows = np.arange(row, row + k)
            row += k
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("id"), pa.array(np.bincount(text, minlength=k).astype(np.int64)), pa.nulls(k, pa.string()), pa.array(np.bincount(owner, minlength=k).astype(np.int64))], names=["row", "id", "words", "feature", "n"])
            for at in range(0, len(pairs), 100_000):
                part = pairs[at : at + 100_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(rows[part // width]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), coded.dictionary.take(pa.array(part % width)).cast(pa.string()), pa.array(times[at : at + 100_000].astype(np.int64))], names=["row", "id", "words", "feature", "n"])

    return count


def counted(docs: DataFrame, n: int, id_col: str | None, text_col: str) -> DataFrame:
    """Each row of docs as (row, id, words, null, n: its features) and its distinct features as (row, null, null, feature, n), written."""
    id_ = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return written(docs.select(id_.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_count(n), FEATURES), "features")


def dictionary_of(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(feature, s, t, seen, bucket): each distinct string of both once, with its counts, the documents' rows that hold it, and its hash."""
    rows = docs.filter("feature is not null").select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("seen"))
    other = target.filter("feature is not null").select("feature", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"), F.lit(0).cast("long").alias("seen"))
    strings = rows.union(other).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("seen").alias("seen"))
    return written(strings.withColumn("bucket", F.pmod(F.crc32(F.encode("feature", "UTF-8")), F.lit(buckets))), "dictionary")


def gains_of(dictionary: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): as many rows as there are buckets at most."""
    sums = dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = dictionary.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    real = lambda name: F.col(name).cast("double")
    ratio = (real("t") + 1) * (real("all_s") + buckets) / ((real("s") + 1) * (real("all_t") + buckets))
    return sums.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(id_: Column, seed: int) -> Column:
    """Noise that depends on the id alone, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, percent: int = PERCENT, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank; ranks from 1 for the percent % of documents of min_words words that are drawn, else null."""
    rows = counted(docs, n, id_col, text_col)
    dictionary = dictionary_of(rows, counted(target, n, None, target_col), buckets)
    seen = dictionary.agg(F.sum("seen")).first()[0] or 0
    strings = written(dictionary.filter("seen > 0").join(F.broadcast(gains_of(dictionary, buckets)), "bucket").select("feature", "seen", "gain"), "gains")
    features = rows.filter("feature is not null").select("row", "feature", "n")
    met = joined(features, strings, ["feature"], (F.col("seen") > max(1, seen // FREQUENT)) & (F.octet_length("feature") <= FREQUENT_BYTES))
    sums = met.groupBy("row").agg(F.sum(F.col("gain") * F.col("n")).alias("gain"))
    texts = rows.filter("feature is null").select("row", "id", "words", F.col("n").alias("n_features"))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain").cast("double") / F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    scored = written(texts.join(sums, "row", "left").withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).drop("gain"), "scored")
    drawable = scored.filter(F.col("words") >= min_words)
    drawn = drawable.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), "row"]
    ranked = numbered(drawable.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order), "ranked", "rank")
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.filter(F.col("words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op11_importance(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT r, unnest(w) AS w FROM d),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (SELECT w, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM f UNION ALL SELECT w, 0, 1 FROM b) GROUP BY w),
h AS MATERIALIZED (SELECT w, s, v.t, {crc_sql("w", "crc.t")} % 10000 AS k FROM v, crc),
g AS (SELECT k, CAST(floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM h) + 10000) / ((CAST(sum(s) AS DOUBLE) + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM h) + 10000)))) AS BIGINT) AS gain FROM h GROUP BY k),
m AS (SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN h USING (w) JOIN g USING (k) GROUP BY r),
s AS (SELECT doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS p FROM s)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN p <= (SELECT count(*) FROM s WHERE n_features >= 20) * 10 // 100 THEN p END AS rank FROM o
"""
