"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each task sorts the 64-bit fingerprints of its texts, splits them by owner and sends every owner one
Golomb-Rice coded block of distinct values. Owners decode the blocks of their range, and answer each
block with a bitmap of the values that occur more than once. Only texts behind a set bit are shuffled
whole, grouped by their bytes, and so verified. Senders' rows live in a written table in the shared
folder, so that a lost executor never changes an address.

Defined cases: a null text is empty; a null doc_id is smaller than any other; of rows that repeat a
doc_id within one group one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, lower_ascii, partitions, written

#: Rows that one block of a sender covers at most, over all owners.
BLOCK_ROWS = 262_144
#: Suspect fingerprints up to this number go to all tasks (16 MB); more are joined by a shuffle.
BROADCAST_SUSPECTS = 2_000_000


def golomb_encode(increasing: np.ndarray, bits: int) -> bytes:
    """Gaps of increasing unsigned integers: first all quotients by 2**bits in unary, then all remainders in bits each."""
    gaps = np.diff(increasing, prepend=np.uint64(0))
    high = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.ones(int(high.sum()) + len(high), dtype=np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    low = (gaps[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(code: bytes, n: int, bits: int) -> np.ndarray:
    tail = (n * bits + 7) // 8
    stream = np.frombuffer(code, dtype=np.uint8)
    stops = np.flatnonzero(np.unpackbits(stream[: len(stream) - tail]) == 0)[:n]
    high = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    low = np.unpackbits(stream[len(stream) - tail :])[: n * bits].reshape(n, bits).astype(np.uint64)
    low = (low << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((high << np.uint64(bits)) | low, dtype=np.uint64)


def rice_bits(span_bits: int, n: int) -> int:
    """The remainder's width for n values spread over 2**span_bits."""
    return max(0, min(60, span_bits - max(1, n).bit_length()))


def _blocks(fp: np.ndarray, ids: np.ndarray, sha: np.ndarray, sender: int, block: int, owner_bits: int) -> pd.DataFrame:
    order = np.argsort(fp, kind="stable")
    fp, ids, sha = fp[order], ids[order], sha[order]
    values, first, count = np.unique(fp, return_index=True, return_counts=True)
    owner = (values >> np.uint64(64 - owner_bits)).astype(np.int64)
    mask = np.uint64((1 << (64 - owner_bits)) - 1)
    rows = []
    for lo, hi in _runs(owner):
        n = hi - lo
        bits = rice_bits(64 - owner_bits, n)
        a, b = first[lo], first[hi] if hi < len(first) else len(fp)
        rows.append((sender, block, int(owner[lo]), n, bits, golomb_encode(values[lo:hi] & mask, bits), np.repeat(np.arange(n), count[lo:hi]), ids[a:b], sha[a:b]))
    return pd.DataFrame(rows, columns=["sender", "block", "owner", "n", "bits", "code", "nth", "ids", "shas"])


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return zip(edges[:-1], edges[1:]) if len(keys) else iter(())


def _send(owner_bits: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sender, block, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK_ROWS:
                yield _sent(held, sender, block, owner_bits)
                block, held, n = block + 1, [], 0
        if n:
            yield _sent(held, sender, block, owner_bits)

    return send


def _sent(held: list[pd.DataFrame], sender: int, block: int, owner_bits: int) -> pd.DataFrame:
    all_ = pd.concat(held)
    return _blocks(all_["fp"].to_numpy(np.int64).view(np.uint64), all_["id"].astype(object).where(all_["id"].notna(), None).to_numpy(), all_["sha"].to_numpy(), sender, block, owner_bits)


def _answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """What the owner answers: for each block a bitmap of the values that other blocks hold too."""
    values = [golomb_decode(c, n, b) for c, n, b in zip(blocks["code"], blocks["n"], blocks["bits"])]
    seen, count = np.unique(np.concatenate(values), return_counts=True)
    many = seen[count > 1]
    maps = [np.packbits(np.isin(v, many, assume_unique=True)).tobytes() for v in values]
    return pd.DataFrame({"sender": blocks["sender"], "block": blocks["block"], "owner": blocks["owner"], "bitmap": maps})


def _open(owner_bits: int):
    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                values = golomb_decode(x.code, x.n, x.bits) | (np.uint64(x.owner) << np.uint64(64 - owner_bits))
                nth = np.asarray(x.nth)
                suspect = np.unpackbits(np.frombuffer(x.bitmap, dtype=np.uint8))[: x.n].astype(bool) | (np.bincount(nth, minlength=x.n) > 1)
                yield pd.DataFrame({"id": pd.array(list(x.ids), dtype="Int64"), "sha": list(x.shas), "fp": values.view(np.int64)[nth], "suspect": suspect[nth], "address": (np.int64(x.sender) << 40) + (np.int64(x.block) << 32) + 0, "place": (np.int64(x.owner) << 32) + np.arange(len(nth))})

    return opened


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id (the largest id of the equal texts), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Exactly one row of each group is kept.
    """
    spark = docs.sparkSession
    owner_bits = max(1, (2 * partitions(spark)).bit_length())
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    prints = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm")).select("id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    blocks = written(prints.mapInPandas(_send(owner_bits), "sender int, block int, owner int, n int, bits int, code binary, nth array<int>, ids array<long>, shas array<binary>"), "fingerprints")
    answers = blocks.select("sender", "block", "owner", "n", "bits", "code").groupBy("owner").applyInPandas(_answer, "sender int, block int, owner int, bitmap binary")
    rows = written(blocks.join(answers, ["sender", "block", "owner"]).mapInPandas(_open(owner_bits), "id long, sha binary, fp long, suspect boolean, address long, place long"), "addresses")
    suspects = rows.filter("suspect")
    prints_of = suspects.select("fp").distinct()
    texts = docs.select(norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    few = prints_of.limit(BROADCAST_SUSPECTS + 1).count() <= BROADCAST_SUSPECTS
    verified = texts.join(F.broadcast(prints_of) if few else prints_of, "fp", "left_semi").groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size"))
    groups = verified.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    best = suspects.groupBy("fp", "sha").agg(F.max(F.struct("id", "address", "place")).alias("best"))
    # One row a group, written before rows meet it: both sides of the join are then plain exchanges, and a large group's can be split.
    decided = suspects.join(written(groups.join(best, ["fp", "sha"]), "groups"), ["fp", "sha"])
    stays = (F.col("address") == F.col("best.address")) & (F.col("place") == F.col("best.place"))
    out = decided.select(F.col("id"), F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), "sha")
    alone = rows.filter("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return out.unionByName(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns: of equal texts the row with the largest id.

    A null text equals an empty one; a null id is smaller than any other, and counts as a value; of rows
    that repeat id and text one stays, whichever comes first; long texts are compared whole; an empty table
    gives an empty table; columns may have any names.
    """
    gone = exact_dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    name = fresh(docs.columns, "kept")
    kept = gone.filter("kept").select(F.struct("doc_id", "text_sha256").alias(name))
    sha = F.sha2(lower_ascii(F.coalesce(docs[text_col], F.lit(""))), 256)
    again = gone.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    out = docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept[name]["doc_id"]) & (sha == kept[name]["text_sha256"]), "left_semi")
    return out.withColumn(name, sha).dropDuplicates([id_col, name]).drop(name) if again else out


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
