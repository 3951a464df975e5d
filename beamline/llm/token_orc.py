"""Token ids in ORC: integer run-length encoded arrays in doc_id order, read back by stripes.

Documents are range-partitioned by id, encoded where they lie, and written as one ORC file a
partition, with row indexes and a Bloom filter on the id. Each row holds its offset within the file;
the files' totals, one row a file, turn offsets into global starts when reading.

Defined cases: a null text is empty and gives the end id alone; null ids come first; rows that repeat
an id lie together, ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import partitions, scratch_path
from .textbytes import slices

END_ID = 2
#: Entries that a worker remembers, about 200 bytes each.
REMEMBERED = 1_000_000
ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}

_ODD = re.compile("[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_PLAIN = re.compile("[\n -~\xa1-\xff]*")
_BEFORE_WORD = re.compile(r" (?=\S)")


class SegmentEncoder(dict):
    """A tokenizer whose byte-level pattern never joins what stands before a space that precedes a word.

    Maps a segment (as if it followed a space) to its ids as bytes; texts are encoded segment by
    segment, each distinct one once.
    """

    def __init__(self, path: str):
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pattern = regex.compile(PATTERN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.shown = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
        self.stops = {x: self.piece(x) for x in ".,"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin1").translate(self.shown)
        ids = array("I", [t.id for t in self.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def segment(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return self.whole(text)
        parts = self.pattern.findall(text)
        if len(parts) == 1:
            return self.piece(text)
        return b"".join([self[x[1:]] if x[0] == " " and len(x) > 1 else self.piece(x) for x in parts])

    def __missing__(self, rest: str) -> bytes:
        if rest.isalpha() and _PLAIN.fullmatch(rest):
            # One word is one piece; a word before a stop or comma, the usual case, is two.
            out = self.piece(f" {rest}")
        elif rest[-1:] in (".", ",") and (word := rest[:-1]).isalpha() and _PLAIN.fullmatch(word):
            out = self[word] + self.stops[rest[-1]]
        else:
            out = self.segment(f" {rest}")
        if len(self) >= REMEMBERED:
            self.clear()
        self[rest] = out
        return out

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self.whole(text)
        if "  " in text or " \n" in text or text[-1] == " " or _ODD.search(text):
            first, *rest = _BEFORE_WORD.split(text)
        else:
            first, *rest = text.split(" ")
        return (self.segment(first) if first else b"") + b"".join(map(self.__getitem__, rest))


_encoders: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, start, end = encoder(path), TaskContext.get().partitionId(), 0, np.array([end_id], dtype="<u4").tobytes()
        for batch in (y for x in batches for y in slices(x)):
            coded = [tokens.encode(t or "") + end for t in batch.column("text").to_pylist()]
            n = np.array([len(x) // 4 for x in coded], dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype=np.int32)), batch.column("doc_id"), pa.array(start + at[:-1]), pa.array(n), ids], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            start += int(at[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int | None = None) -> None:
    """Encode the texts of docs and write them in ascending id order as ORC files under path."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_encode(tokenizer, end_id), "part int, doc_id long, local_start long, n_tokens long, ids array<int>").write.options(**ORC_OPTIONS | ({"orc.stripe.size": str(stripe_bytes)} if stripe_bytes else {})).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document that write_tokens wrote."""
    rows = spark.read.schema("part int, doc_id long, local_start long, n_tokens long, ids array<int>").orc(path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = files.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, at = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]) * 4
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_orc(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(read_tokens(spark, path))
