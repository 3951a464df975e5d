import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lowered(text or ""))


LONG = " ".join(f"wort{i} und Straße{i % 97}" for i in range(60_000))
#: (doc_id, text, lang, source, n_chars) with nulls, empties, ties, repeats, odd white space and a long text.
ROWS = [
    (1, "The quick brown Fox jumps over the lazy dog near the river bank today", "en", "a", 1),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", "en", "b", None),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "   \t\n ", "de", "b", 6),
    (6, "Straße über Äpfel und Öl  mit  zwei   Leerzeichen\r\n\x0bund Zeilen", "de", "c", 1),
    (7, LONG, "de", "a", len(LONG)),
    (8, LONG + " ende", "de", None, 1),
    (9, "12345 !!! 🎉 ▁ 日本", None, "c", 1),
    (9, "12345 !!! 🎉 ▁ 日本", None, "c", 1),
    (10, "a", "fr", "d", 1),
    (11, "line one\nline two\nline three\nother", "en", "a", 1),
    (12, "start\nline one\nline two\nline three\nend", "en", "b", 1),
    (12, "same id, other text", "en", "b", 1),
    (None, "no id but text", "en", "a", 1),
    (None, "no id but text", "en", "a", 1),
    (13, "<|endoftext|> a b", "en", "a", 1),
    (14, "Ärger ARGER arger", "de", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names an operator might use for its own.
CLASHING = ("id", "size", "cls", "label", "key", "value", "rank", "norm", "fp", "sha", "p", "w", "c", "row", "ids", "pos", "line", "kept", "copies", "nth", "held_out", "lettered", "tail", "part",
            "_kept_id", "_kept_sha", "_first", "_id", "_copies", "_words", "_copy", "_row", "_nth", "_gone", "_size", "_source", "kept_", "first", "mixed", "_mixed", "gone", "text_hash", "n", "h", "k", "l")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """Some real documents: (DataFrame, list of rows)."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return frame, frame.collect()
