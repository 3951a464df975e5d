"""Encoding to the pieces of a SentencePiece model by streaming Viterbi, and decoding back.

The best segmentation has the greatest sum of piece scores; where sums tie, the piece that begins
earlier wins. `stream` is the search itself: it keeps the scores of one window, as long as the longest
piece, and commits ids as soon as every surviving path passes one boundary. The same rule gives the windows
of the main path: when no piece holds the space sign after another character, all paths meet before every
run of spaces, so what lies between two such boundaries is committed there, in batches of windows of one
length, each distinct one once. Words over SHORT characters, runs of spaces, texts that hold the sign itself,
and models without that property go through `stream`. Characters outside the vocabulary become byte pieces.

Defined cases: a null or empty text has no ids; decoding the ids of a text gives the text back byte by byte,
except that the space sign U+2581 itself comes back as a space; rows that repeat an id are encoded each;
an empty table gives no rows; columns that the output does not name are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Bytes, mix, slices

SIGN = "▁"
#: Words up to this many characters are searched many at once; longer ones one by one.
SHORT = 40
_BLANK = np.zeros(256, dtype=bool)
_BLANK[32] = True
_TURN = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_TURN, -1, 2**64)
_UP = np.array([pow(_TURN, i, 2**64) for i in range(SHORT + 2)], dtype=np.uint64)
_DOWN = np.array([pow(_BACK, i, 2**64) for i in range(SHORT + 2)], dtype=np.uint64)


def _sums(points: np.ndarray) -> np.ndarray:
    """Running hashes of the rows' code points, from 0."""
    out = np.zeros((len(points), points.shape[1] + 1), dtype=np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(77)) * _UP[: points.shape[1]], axis=1, out=out[:, 1:])
    return out


class PieceTable:
    """Pieces, and all beginnings of pieces, by the hash of their characters; every key lies in one of two places."""

    def __init__(self, pieces: dict[str, int], bits: int = 19):
        begun = {p[:k] for p in pieces for k in range(1, len(p))}
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        #: The piece's id, -1 where there is none; whether a longer piece begins so.
        self.ids, self.longer = np.full(1 << bits, -1, dtype=np.int32), np.zeros(1 << bits, dtype=bool)
        for text in {*pieces, *begun}:
            entry = (mix(_sums(np.array([[ord(c) for c in text]]))[0, -1:])[0], pieces.get(text, -1), text in begun)
            at = int(self._places(entry[0])[0])
            while entry[0]:
                was = (self.keys[at], self.ids[at], self.longer[at])
                self.keys[at], self.ids[at], self.longer[at] = entry
                entry = was
                if entry[0]:
                    first, second = map(int, self._places(entry[0]))
                    at = second if at == first else first

    def _places(self, keys):
        return keys >> self.shift, (keys >> np.uint64(8)) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids or -1, whether longer pieces begin so)"""
        a, b = self._places(keys)
        at = np.where(self.keys[a] == keys, a, b)
        hit = self.keys[at] == keys
        return np.where(hit, self.ids[at], -1), hit & self.longer[at]


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.score = np.full(n + 1, -np.inf)
        self.bytes_: list[bytes] = [b""] * n
        self.byte_ids = np.full(256, model.unk_id(), dtype=np.int32)
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.score[i], self.bytes_[i] = i, model.get_score(i), piece.replace(SIGN, " ").encode()
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.splits = not any(SIGN in p.lstrip(SIGN) for p in self.ids)
        self.table = PieceTable({p: i for p, i in self.ids.items() if len(p) <= SHORT})
        self.flat = np.frombuffer(b"".join(self.bytes_), dtype=np.uint8)
        self.lengths = np.array([len(x) for x in self.bytes_], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.rare: dict[str, np.ndarray] = {}

    def stream(self, chars: str) -> Iterator[list[int]]:
        """Commits the ids of chars (with space signs) as soon as they are certain."""
        score, back, done, ids = {0: 0.0}, {}, 0, self.ids
        n = len(chars)
        for end in range(1, n + 1):
            best, how = -np.inf, None
            for start in range(max(done, end - self.longest), end):
                id_ = ids.get(chars[start:end])
                s = score[start] + (self.score[id_] if id_ is not None else self.unknown if end - start == 1 else -np.inf)
                if s > best:
                    best, how = s, (start, id_)
            score[end], back[end] = best, how
            score.pop(end - self.longest, None) if end - self.longest > done else None
            if end == n or (end - done) % (2 * self.longest) == 0:
                # The latest boundary that the paths of all positions in the window share.
                live = {end} if end == n else set(range(end - self.longest + 1, end + 1))
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(back[top][0])
                meet = live.pop()
                if meet > done:
                    path, at = [], meet
                    while at > done:
                        start, id_ = back[at]
                        path.append([id_] if id_ is not None else self.byte_ids[list(chars[start:at].encode())].tolist())
                        at = start
                    yield [i for p in reversed(path) for i in p]
                    for k in range(done, meet):
                        score.pop(k, None)
                    for k in range(done + 1, meet + 1):
                        back.pop(k, None)
                    done = meet

    def segment(self, chars: str) -> np.ndarray:
        found = self.rare.get(chars)
        if found is None:
            found = np.array([i for part in self.stream(chars) for i in part], dtype=np.int32)
            if len(chars) <= 200:
                if len(self.rare) > 50_000:
                    self.rare.clear()
                self.rare[chars] = found
        return found

    def short_words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of the words' ids) for words of one length, rows of code points that begin with the space sign."""
        n, length = points.shape
        sums = np.ascontiguousarray(_sums(points).T)
        best, start, piece = np.full((length + 1, n), -np.inf), np.zeros((length + 1, n), np.int8), np.full((length + 1, n), -1, np.int32)
        best[0] = 0.0
        for begin in range(length):
            rows, behind, so_far = np.arange(n), sums[begin], best[begin]
            for end in range(begin + 1, min(length, begin + self.longest) + 1):
                id_, longer = self.table.find(mix((sums[end].take(rows) - behind) * _DOWN[begin]))
                if end == begin + 1:
                    s = so_far + np.where(id_ >= 0, self.score.take(id_), self.unknown)
                    better = np.flatnonzero(s > best[end])
                else:
                    known = np.flatnonzero(id_ >= 0)
                    s = so_far.take(known) + self.score.take(id_.take(known))
                    gain = s > best[end].take(rows.take(known))
                    better, s = known[gain], s[gain]
                at = rows.take(better)
                best[end][at], start[end][at], piece[end][at] = s if len(s) == len(at) else s.take(better), begin, id_.take(better)
                # Only words that go on like a longer piece are looked at further.
                on = np.flatnonzero(longer)
                if not len(on):
                    break
                rows, behind, so_far = rows.take(on), behind.take(on), so_far.take(on)
        # Backwards along the best paths: (row, end, id) of every piece, put in order by sorting.
        at, rows, out = np.full(n, length), np.arange(n), []
        while len(rows):
            now = at[rows]
            out.append((rows, now, piece[now, rows]))
            at[rows] = start[now, rows]
            rows = rows[at[rows] > 0]
        row, end, id_ = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((end, row))
        row, end, id_ = row[order], end[order], id_[order]
        if (id_ < 0).any():
            odd = np.flatnonzero(id_ < 0)
            coded = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in points[row[odd], end[odd] - 1].tolist()]
            count = np.ones(len(id_), dtype=np.int64)
            count[odd] = [len(x) for x in coded]
            row, id_ = np.repeat(row, count), np.repeat(id_, count)
            id_[id_ < 0] = np.concatenate(coded)
        return id_, np.cumsum(np.bincount(row, minlength=n))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the ids' offsets of each text)"""
        signed = pc.fill_null(pc.match_substring(texts, SIGN), False)
        if not self.splits or pc.any(signed).as_py():
            # A sign in the text itself may join runs of spaces: such texts are searched whole.
            alone = np.array(signed.to_pylist(), dtype=bool) | (not self.splits)
            ids, at = self.encode(pa.array([None if a else t for a, t in zip(alone, texts.to_pylist())], pa.string())) if not alone.all() else (np.zeros(0, np.int32), np.zeros(len(alone) + 1, np.int64))
            coded = [self.segment(SIGN + t.replace(" ", SIGN)) if a and t else ids[lo:hi] for a, t, lo, hi in zip(alone, texts.to_pylist(), at[:-1], at[1:])]
            return np.concatenate([np.zeros(0, np.int32), *coded]), np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
        data = Bytes(texts)
        starts, ends, firsts = data.words(_BLANK)
        n = len(starts)
        doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        is_first = np.zeros(n, dtype=bool)
        is_first[firsts[:-1][np.diff(firsts) > 0]] = True
        before = np.where(is_first, data.offsets[doc], np.concatenate([[0], ends[:-1]])[:n])
        signs = starts - before + is_first
        _, where, of = np.unique(data.hashes(starts, ends), return_index=True, return_inverse=True)
        raw = data.raw.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ids, sizes, spans = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        filled = 0
        order = np.argsort(lengths, kind="stable")
        edges = np.searchsorted(lengths[order], np.arange(1, SHORT + 1))
        for length in range(1, SHORT):
            at = order[edges[length - 1] : edges[length]]
            for some in np.split(at, range(8192, len(at), 8192)):
                if not len(some):
                    continue
                points = np.frombuffer("".join([SIGN + words[i] for i in some.tolist()]).encode("utf-32-le"), dtype=np.uint32).reshape(len(some), length + 1)
                got, stops = self.short_words(points)
                ids.append(got)
                sizes[some] = np.diff(stops, prepend=0)
                spans[some] = filled + stops - sizes[some]
                filled += len(got)
        for i in order[edges[SHORT - 1] :].tolist():
            got = self.segment(SIGN + words[i])
            ids.append(got)
            sizes[i], spans[i], filled = len(got), filled, filled + len(got)
        size, span = sizes[of], spans[of]
        # Words after several spaces, and spaces at the end, one by one.
        for i in np.flatnonzero(signs != 1).tolist():
            got = self.segment(SIGN * int(signs[i]) + words[of[i]])
            ids.append(got)
            size[i], span[i], filled = len(got), filled, filled + len(got)
        last = np.where(np.diff(firsts) > 0, ends[np.maximum(firsts[1:] - 1, 0)] if n else data.offsets[:-1], data.offsets[:-1])
        rest = data.offsets[1:] - last + (np.diff(firsts) == 0)
        rest[np.diff(data.offsets) == 0] = 0
        tails = np.flatnonzero(rest > 0)
        tail_ids = [self.segment(SIGN * int(rest[i])) for i in tails.tolist()]
        ids.extend(tail_ids)
        tail_size = np.array([len(x) for x in tail_ids], dtype=np.int64)
        size = np.insert(size, firsts[1:][tails], tail_size)
        span = np.insert(span, firsts[1:][tails], filled + np.cumsum(tail_size) - tail_size)
        doc = np.insert(doc, firsts[1:][tails], tails)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        out = flat[np.repeat(span - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return out, np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=len(firsts) - 1))]).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, the bytes' offsets of each text)"""
        keep = np.ones(len(ids), dtype=bool)
        length = self.lengths[ids]
        begin = self.starts[ids]
        first = offsets[:-1][np.diff(offsets) > 0]
        blank = self.flat[begin[first]] == 32
        begin[first[blank]] += 1
        length[first[blank]] -= 1
        ends = np.cumsum(length)
        out = self.flat[np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[offsets]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in batches for y in slices(x)):
            ids, at = codec(path).encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=[*batch.schema.names, "ids"])

    return encode


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, ends = codec(path).decode(flat, at)
            texts = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
            raw = np.ascontiguousarray(flat.astype("<u4")).view(np.uint8)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            rest = [i for i, name in enumerate(batch.schema.names) if name != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(np.diff(at)), pa.array(crc, pa.int64()), texts], names=[*[batch.schema.names[i] for i in rest], "n_ids", "ids_crc32", "decoded"])

    return decode


def _round_trip(path: str, with_ids: bool):
    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in batches for y in slices(x)):
            ids, at = codec(path).encode(batch.column("text"))
            data, ends = codec(path).decode(ids, at)
            raw, texts = memoryview(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8)), data.tobytes()
            given = Bytes(batch.column("text"))
            whole = given.raw.tobytes()
            crc, sha, same = [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                back = texts[ends[i] : ends[i + 1]]
                crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                sha.append(hashlib.sha256(back).hexdigest())
                same.append(back == whole[given.offsets[i] : given.offsets[i + 1]].replace(SIGN.encode(), b" "))
            columns = {"id": batch.column("id"), "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), "n_ids": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64()), "decoded_sha256": pa.array(sha, pa.string()), "round_trip": pa.array(same, pa.bool_())}
            if not with_ids:
                del columns["ids"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return round_trip


def checked_pieces(docs: DataFrame, model: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row encoded and decoded in one task: id, ids (if asked for), n_ids, ids_crc32, decoded_sha256, round_trip."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(_round_trip(model, with_ids), f"id long, {'ids array<int>, ' if with_ids else ''}n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids) of every row of docs; a null text comes back empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(model), "id long, text string, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(coded: DataFrame, model: str) -> DataFrame:
    """coded with its column ids replaced by n_ids, ids_crc32 (of the ids as little-endian 32-bit) and the text they decode to."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name != "ids")
    return coded.mapInArrow(_decode(model), f"{kept}, n_ids long, ids_crc32 long, decoded string")


def op8_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return checked_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, with_ids=False)
