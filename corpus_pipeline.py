"""A corpus pipeline: language, exact copies, near copies, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from beamline.llm import exact_dedup, jaccard_join, language_crf, mixing, piece_codec
from beamline.llm.shared import fresh, written

#: A document whose words speak less clearly than this for one language is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (so null and empty texts) and those of no clear language.

    Languages are learned from the labels of docs; without any label all documents are rejected. Null ids,
    sources and labels are no reason to reject; texts are judged whole; repeated rows are judged alike; an
    empty table gives an empty table; columns may have any names.
    """
    found = language_crf.judged(docs, docs.columns)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z the document with the largest id stays.

    A null text equals an empty one and a null id is the smallest; of repeated rows one stays; long texts
    are compared whole; an empty table gives an empty table; columns may have any names.
    """
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; the document with the smallest id of each group stays.

    Null, empty and wordless texts are in no group and stay; a null id is the largest; equal rows stay or go
    together; long texts are compared whole; an empty table gives an empty table; columns may have any names.
    """
    return jaccard_join.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it, 0 to 3 times.

    Null and empty texts have size 0; a null source is a source of its own; rows that repeat an id are taken
    one by one; an empty table gives an empty table; columns may have any names.
    """
    name = fresh(docs.columns, "mixed")
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    copies = written(mixed.select(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("source"), "size", "nth", "copies").alias(name)), "copies")
    of = F.col(name)
    size = mixing.text_size(docs["text"])
    same = docs["doc_id"].eqNullSafe(of["id"]) & docs["source"].eqNullSafe(of["source"]) & (size == of["size"])
    if copies.filter(of["nth"] > 1).limit(1).count():
        # Rows that repeat an id, a source and a size are numbered too.
        nth = fresh([*docs.columns, name], "nth")
        order = F.row_number().over(W.partitionBy("doc_id", "source", mixing.text_size(F.col("text"))).orderBy(F.xxhash64("text"))).cast("long")
        numbered = docs.withColumn(nth, order)
        same = numbered["doc_id"].eqNullSafe(of["id"]) & numbered["source"].eqNullSafe(of["source"]) & (mixing.text_size(numbered["text"]) == of["size"]) & (numbered[nth] == of["nth"])
        docs, columns = numbered, docs.columns
    else:
        columns = docs.columns
    taken = docs.join(copies.filter(of["copies"] > 0), same)
    return taken.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), of["copies"]))).select(columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number and checksum, the hash of what they decode to, and whether that is the text.

    Null and empty texts have no ids and decode to the empty text; null ids stay null; repeated rows give
    equal rows; texts are encoded whole; an empty table gives no rows; other columns are ignored.
    """
    return piece_codec.checked_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("pieces", pieces),
]

#: The rounding of the mix and the language model have no SQL; the tests run each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
