"""Patterns of families, learned, judged and kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import normalised
from ..operators import patterns as p
from ..registry import query
from ..sources.tables import labelled_parts


def _tokens(spark, sf_dir):
    return labelled_parts(spark, sf_dir).select(F.col("family").alias("g"), normalised(F.col("printed")).alias("token"), "p_partkey")


@query("pattern_learn_trie")
def pattern_learn_trie(spark, sf_dir):
    """One pattern for all prints of a family, with its make-ups, the distinct prints, those it fits, and the length of a mere list of them."""
    tokens = _tokens(spark, sf_dir).select("g", "token").distinct()
    lists = p.fragment_lists(tokens, "g", "token")
    made = lists.groupBy("g").agg(F.count(F.lit(1)).alias("make_ups"))
    listed = tokens.groupBy("g").agg(F.sum(F.length("token") + 1).alias("listed_length"))
    found = p.judged(p.simplified(p.merged(lists)), tokens)
    return found.join(made, "g").join(listed, "g").select(F.col("g").alias("family"), "pattern", "make_ups", "total", "matched", "listed_length", "confidence", F.round(p.readability(F.col("pattern")), 6).alias("readable"))


@query("pattern_knowledge")
def pattern_knowledge(spark, sf_dir):
    """The table of patterns after prints without damage, then all prints: what the second run did to each family's pattern."""
    tokens = _tokens(spark, sf_dir)
    none = tokens.select("g", "token").limit(0)
    known = none.select("g", F.col("token").alias("pattern"), F.lit(0).alias("version"))
    known, examples = p.learn_or_reuse(known, none, tokens.filter("p_partkey % 7 > 5").select("g", "token"))
    known, examples = p.learn_or_reuse(known.drop("status"), examples, tokens.select("g", "token"))
    counts = examples.groupBy("g").agg(F.count(F.lit(1)).alias("examples"))
    return known.join(counts, "g", "left").select(F.col("g").alias("family"), "pattern", "version", "status", F.coalesce("examples", F.lit(0)).alias("examples"))
