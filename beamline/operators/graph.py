"""Components, propagation and assignment over pairs of near boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import written


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that a chain of pairs reaches.

    Each round takes the smallest root among neighbours, then the root's own root; rounds are written to
    the shared folder, so that lineage stays short.
    """
    edges = written(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(F.col(b), F.col(a))).distinct(), "edges")
    roots = written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("root")), "roots")
    while True:
        near = edges.join(roots, edges["y"] == roots["node"]).groupBy("x").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots["node"] == near["x"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("r"), F.col("root").alias("further"))
        now = written(lower.join(jump, F.col("root") == F.col("r"), "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "roots")
        if not now.filter("old <> root").limit(1).count():
            return now.select("node", "root")
        roots = now.select("node", "root")


def strongest_seed(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """pairs (page, box, box_b) and seeds (page, box, strength): for every other box the strongest seed near it."""
    near = pairs.join(seeds.select("page", F.col("box").alias("box_b"), "strength"), ["page", "box_b"])
    best = near.groupBy("page", "box").agg(F.max(F.struct("strength", "box_b")).alias("best"))
    return best.join(seeds.select("page", "box"), ["page", "box"], "left_anti").select("page", "box", F.col("best.box_b").alias("seed"), F.col("best.strength").alias("strength"))


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Pairs of which each is the other's nearest; ties go to the smaller box."""
    place = F.row_number().over(W.partitionBy("page", "box").orderBy("d2", "box_b"))
    first = pairs.select("page", "box", "box_b", "d2", place.alias("place")).filter("place = 1").drop("place")
    back = first.select("page", F.col("box").alias("box_b"), F.col("box_b").alias("box"))
    return first.join(back, ["page", "box", "box_b"]).filter(F.col("box") < F.col("box_b"))


def greedy_assignment(pairs: DataFrame, margin: int) -> DataFrame:
    """One-to-one pairs, nearest first: pairs (page, box, box_b, d2) with box < box_b.

    A box whose two nearest differ by less than margin in d2 abstains. In each round the pairs that are
    first for both of their boxes are taken, which gives the same pairs as going through all of them in
    order of (d2, box, box_b); rounds go on until no pair is left.
    """
    key = F.struct("d2", "box", "box_b")
    sides = lambda rows: rows.select("page", F.explode(F.array("box", "box_b")).alias("me"), key.alias("pair"))
    two = sides(pairs).groupBy("page", "me").agg(F.slice(F.sort_array(F.collect_list("pair.d2")), 1, 2).alias("d"))  # boxes within the radius
    torn = two.filter((F.size("d") > 1) & (F.col("d")[1] - F.col("d")[0] < margin)).select("page", "me")

    def without(rows: DataFrame, taken: DataFrame) -> DataFrame:
        for side in ("box", "box_b"):
            rows = rows.join(taken.withColumnRenamed("me", side), ["page", side], "left_anti")
        return rows.select("page", "box", "box_b", "d2")

    left, done = written(without(pairs, torn), "open-pairs"), None
    while left.limit(1).count():
        best = sides(left).groupBy("page", "me").agg(F.min("pair").alias("pair"))
        taken = best.groupBy("page", "pair").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("page", "pair.box", "pair.box_b", "pair.d2")
        taken = written(taken, "taken")
        done = taken if done is None else done.unionByName(taken)
        left = written(without(left, taken.select("page", F.explode(F.array("box", "box_b")).alias("me"))), "open-pairs")
    return done if done is not None else left
