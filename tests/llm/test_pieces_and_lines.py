import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from beamline.llm.line_dedup import drop_repeated_lines, line_report, repeated_lines
from beamline.llm.piece_codec import SIGN, PieceCodec, checked_pieces, decode_pieces, encode_pieces

from .conftest import ROWS, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


def whole(codec, chars):
    """Viterbi over the whole text at once."""
    n = len(chars)
    best, how = [0.0] + [-np.inf] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - codec.longest), end):
            id_ = codec.ids.get(chars[start:end])
            s = best[start] + (codec.score[id_] if id_ is not None else codec.unknown if end - start == 1 else -np.inf)
            if s > best[end]:
                best[end], how[end] = s, (start, id_)
    out, end = [], n
    while end:
        start, id_ = how[end]
        out.append([id_] if id_ is not None else codec.byte_ids[list(chars[start:end].encode())].tolist())
        end = start
    return [i for part in reversed(out) for i in part]


def test_streams_and_batches_match_the_whole_search(codec):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", ".", "日", SIGN, "🎉", "the", "ing ", "   ", "\r", "x" * 50, "ab" * 100]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(400)] + ["", " ", "  ", SIGN, None]
    ids, at = codec.encode(pa.array(texts))
    raw, ends = codec.decode(ids, at)
    for i, text in enumerate(texts):
        want = whole(codec, SIGN + text.replace(" ", SIGN)) if text else []
        assert ids[at[i] : at[i + 1]].tolist() == want, text
        assert (not text) or [x for part in codec.stream(SIGN + text.replace(" ", SIGN)) for x in part] == want
        assert raw[ends[i] : ends[i + 1]].tobytes().decode() == (text or "").replace(SIGN, " ")


def test_scores_equal_the_library_search(codec, tmp_path):
    """The library, told that the model is a unigram one, finds no better sum."""
    import sentencepiece

    raw = open(MODEL, "rb").read()
    at = raw.rindex(b"tok_v0") + 6
    (tmp_path / "m").write_bytes(raw[:at] + b"\x18\x01" + raw[at + 2 :])
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    for text in ("the heaon thing", "Straße und Äpfel", "a  b   c", "hello world, this is a test"):
        ours = [x for part in codec.stream(SIGN + text.replace(" ", SIGN)) for x in part]
        theirs = library.nbest_encode(text, nbest_size=8)[0]
        assert sum(codec.score[i] for i in ours) == sum(codec.score[i] for i in theirs)


def test_a_stream_keeps_a_bounded_window(codec):
    parts = list(codec.stream(SIGN + "the quick brown fox " * 200))
    assert len(parts) > 50 and max(map(len, parts)) < 200


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_round_trip_of_tables(request, table):
    got = decode_pieces(encode_pieces(request.getfixturevalue(table), MODEL), MODEL).collect()
    low = lambda d: -1 if d is None else d
    assert sorted((low(r.doc_id), r.decoded) for r in got) == sorted((low(d), (t or "").replace(SIGN, " ")) for d, t, *_ in ROWS)


def test_checked_pieces(clashing):
    import hashlib

    got = checked_pieces(clashing, MODEL).collect()
    low = lambda d: -1 if d is None else d
    assert all(r.round_trip and len(r["ids"]) == r.n_ids for r in got)
    assert sorted((low(r.doc_id), r.decoded_sha256) for r in got) == sorted((low(d), hashlib.sha256((t or "").replace(SIGN, " ").encode()).hexdigest()) for d, t, *_ in ROWS)


def test_pieces_empty(no_docs):
    assert checked_pieces(no_docs, MODEL).count() == 0
    assert decode_pieces(encode_pieces(no_docs, MODEL), MODEL).count() == 0


def brute_lines(rows, least):
    """Positions of lines in a run of `least` lines, or of one line of over 50 words, that an earlier place holds too."""
    seen, gone = set(), []
    for doc, text in rows:
        lines = text.split("\n") if text is not None else []
        cut = set()
        for i in range(len(lines) - least + 1):
            run = tuple(lines[i : i + least])
            if run in seen:
                cut.update(range(i, i + least))
            seen.add(run)
        for i, line in enumerate(lines):
            if len(words(line)) > 50:
                if line in seen:
                    cut.add(i)
                seen.add(line)
        gone.append((doc, sorted(cut)))
    return gone


@pytest.mark.parametrize("least", [1, 2, 3])
def test_repeated_lines(spark, least):
    rng = random.Random(least)
    long = ["over " * 51, " ".join(["x"] * 50), "a\t" * 30 + "b  " * 22]
    rows = [(i, "\n".join(rng.choice(["x", "y", "z", "", f"u{rng.random()}", *long]) for _ in range(rng.randrange(1, 12)))) for i in range(40)] + [(40, None), (41, "")]
    # Long runs that repeat whole and in part.
    run = [f"r{i}" for i in range(500)]
    rows += [(50, "\n".join(run)), (51, "\n".join(["own", *run[100:350], "end"])), (52, "\n".join(run[:40] + ["between"] + run[300:]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: p for d, p in brute_lines(rows, least) if p}
    got = {}
    for r in repeated_lines(frame, least).collect():
        got.setdefault(r.id, []).append(r.pos)
    assert {d: sorted(p) for d, p in got.items()} == want
    cut = {r.doc_id: r.text for r in drop_repeated_lines(frame, least).collect()}
    for d, t in rows:
        assert cut[d] == (t if d not in want else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]))


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_intervals_of_the_suffix_order(spark, least):
    """Ranks, common prefixes of neighbours and their intervals against sorting all suffixes."""
    from beamline.llm.line_dedup import neighbour_prefixes, prefix_intervals, suffix_order

    rng = random.Random(least)
    runs = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))] for _ in range(12)] + [[7] * 9, [7] * 9]
    rows = [(d, i, 0, len(x) - i, line) for d, x in enumerate(runs) for i, line in enumerate(x)]
    order, levels = suffix_order(spark.createDataFrame(rows, "doc long, pos long, run long, size long, line long"), least)
    suffixes = {(d, i): tuple(x[i:]) for d, x in enumerate(runs) for i in range(len(x))}
    ordered = sorted(set(suffixes.values()))
    assert {(r.doc, r.pos): r.r for r in order.collect()} == {k: ordered.index(x) + 1 for k, x in suffixes.items()}
    common = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in itertools.pairwise(ordered)]
    prefixes = neighbour_prefixes(order, levels)
    assert [min(r.lcp, least) for r in prefixes.orderBy("r").collect()] == [min(c, least) for c in common]
    starts = itertools.accumulate((i + 1 if c < least else 0 for i, c in enumerate(common)), max)
    assert [r.i for r in prefix_intervals(prefixes, least).orderBy("r").collect()] == list(starts)


def test_lines_edge_cases(clashing, no_docs):
    got = drop_repeated_lines(clashing)
    assert got.columns == clashing.columns and got.count() == len(ROWS)
    text = {r.doc_id: r.text for r in got.filter("text like '%start%'").collect()}
    assert text == {12: "start\nend"}
    assert line_report(clashing).count() == len(ROWS)
    assert line_report(no_docs).count() == 0
