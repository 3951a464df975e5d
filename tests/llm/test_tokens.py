import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from beamline.llm.shared import scratch_path
from beamline.llm.token_orc import SegmentEncoder, read_tokens, token_digest, write_tokens

from .conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_segments_encode_as_whole_texts():
    encoder, rng = SegmentEncoder(PATH), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", ".", ",", "'s", "'t", "\xa0", "　", "\x1c", "日本", "<|endoftext|>", "ß", "🎉", " \n", "the", "\r", " "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        assert encoder.encode(text) == encoder.whole(text)


@pytest.mark.parametrize("table", ["docs", "clashing"])
def test_round_trip_through_orc(spark, request, table):
    path = scratch_path(spark, "t")
    write_tokens(request.getfixturevalue(table), path, PATH)
    got = sorted(token_digest(read_tokens(spark, path)).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(PATH)
    low = lambda d: -1 if d is None else d
    assert [low(r.doc_id) for r in got] == sorted(low(d) for d, *_ in ROWS)
    want = sorted((low(d), zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())) for d, t, *_ in ROWS)
    assert sorted((low(r.doc_id), r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_files_are_orc_with_pushed_filters(spark, docs):
    path = scratch_path(spark, "t")
    write_tokens(docs, path, PATH)
    frame = spark.read.orc(path).filter("doc_id = 6").select("n_tokens")
    assert frame.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)]" in frame._jdf.queryExecution().toString()


def test_stripes_are_pruned_by_their_metadata(spark):
    """Files of many stripes, of which a read of a few ids opens few."""
    from pyarrow import orc

    path = scratch_path(spark, "t")
    rows = spark.range(60_000).selectExpr("id as doc_id", "concat('word ', id % 50) as text").repartition(3)
    write_tokens(rows, path, PATH, stripe_bytes=50_000)
    files = [f for f in spark.read.orc(path).inputFiles()]
    stripes = [orc.ORCFile(f.removeprefix("file://")).nstripes for f in files]
    assert max(stripes) > 1

    def read(condition):
        frame = spark.read.orc(path).filter(condition).select("doc_id", "n_tokens")
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    assert read("doc_id >= 0") == 60_000
    assert read("doc_id between 100 and 120") < 60_000 / max(2, sum(stripes)) * 2
    # An id that no stripe's Bloom filter or range holds reads nothing.
    assert read("doc_id = 70000") == 0


def test_empty(spark, no_docs):
    path = scratch_path(spark, "t")
    write_tokens(no_docs, path, PATH)
    assert token_digest(read_tokens(spark, path)).count() == 0
