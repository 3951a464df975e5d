"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import written


def find(parent: dict[int, int], x: int) -> int:
    """The root of x; the paths that are walked become shorter."""
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while x != root:
        parent[x], x = root, parent.get(x, x)
    return root


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of each batch as stars around their smallest nodes."""
    for batch in batches:
        parent: dict[int, int] = {}
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"a": nodes, "b": [find(parent, x) for x in nodes]}, columns=["a", "b"]).astype("int64")


def _kept(stars: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """stars as a written table, with its rows' number and a sum that changes when any of them does; both come with the write."""
    seen = Observation()
    got = written(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("all")), "stars")
    return got, (seen.get["n"], int(seen.get["all"] or 0))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node that can be reached."""
    now, seen = _kept(edges.filter("a <> b").mapInPandas(_stars, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = down.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        was = seen
        now, seen = _kept(small)
        if was == seen:
            break
    ends = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return ends.union(ends.select(F.col("label").alias("node"), "label").distinct())
