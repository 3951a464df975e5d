"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A document's expected number of copies is its source's target over its source's size. The fractions
are rounded block by block: within a block documents are paired in turn, and words are moved from one
to the other at random until one of the two fractions is 0 or 1, so that the block's expected words
never change; long documents go first, so that a short one tends to be left. What is left of a block, one fraction, meets the residuals of other blocks of its source
at the next level of a reduction tree, until each source has one residual, which is drawn.

Defined cases: a null text has size 0 and takes no words; sources of size 0 have target 0; a null
source is a source of its own, the last; rows that repeat an id are rounded one by one; an empty table
gives no rows; columns of the input keep clear of those added here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import unit_hash, written

#: Fractions that one block rounds in turn, on average; blocks are dealt by hash.
BLOCK = 128
CAP = 3
WEIGHTS = (5, 2, 1)


def text_size(text: Column) -> Column:
    """The number of maximal runs of characters other than tab to carriage return and space."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with each one's share of all sizes.

    Weights repeat over the sources in code point order, null last. A target stops at cap times its
    source's size; the excess is shared by weight among the others until none is above.
    """
    spark = sources.sparkSession
    # The table of sources is first sorted by range and numbered within ranges, so that no task holds all.
    ranged = written(sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id()), "sources")
    before = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("range").orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[(place % len(weights)).cast("int")]
    numbered = written(ranged.join(F.broadcast(before), "range").select("source", "source_size", weight.alias("weight")), "weights")
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * F.lit(float(cap))
    # Each pass adds the sources that the last share would carry past their cap; shares only grow, so it ends.
    share, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(share) > most
        at = numbered.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if at["n"] == capped or not at["open"]:
            break
        capped, share = at["n"], (total - at["held"]) / at["open"]
    return numbered.select("source", "source_size", F.least(F.col("weight") * F.lit(share), most).alias("target"))


def _move(open_: Column, new: Column) -> tuple[Column, Column]:
    """One meeting of two fractions: (still open, decided), structs (key, p, size, u); u is the pair's draw."""
    a, b = open_["size"], new["size"]
    words = open_["p"] * a + new["p"] * b
    # All words that both expect go to one, or one is filled and the rest is the other's.
    up_open, up_new = F.least(F.lit(1.0), words / a), F.least(F.lit(1.0), words / b)
    down_open, down_new = (words - up_new * b) / a, (words - up_open * a) / b
    to_open = F.when(up_open > down_open, (open_["p"] - down_open) / (up_open - down_open)).otherwise(F.lit(1.0))
    first = new["u"] < to_open
    p_open = F.when(first, up_open).otherwise(down_open)
    p_new = F.when(first, down_new).otherwise(up_new)
    open_ends = F.when(first, up_open >= 1.0).otherwise(up_new < 1.0)
    ends = lambda p: F.when(p >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    as_ = lambda x, p: F.struct(x["key"].alias("key"), p.alias("p"), x["size"].alias("size"), x["u"].alias("u"))
    still = F.when(open_ends, as_(new, p_new)).otherwise(as_(open_, p_open))
    done = F.when(open_ends, as_(open_, ends(p_open))).otherwise(as_(new, ends(p_new)))
    return still, done


def _level(items: DataFrame, level: int, last: bool) -> DataFrame:
    """Rounds each (source, block) in turn: rows (source, key, p, size, decided), one undecided a block at most."""
    draw = unit_hash(F.col("source"), F.col("key"), F.lit(level))
    grouped = items.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("turn"), unit_hash(F.col("key"), F.lit(level), F.lit("order")).alias("tie"), F.struct("key", "p", "size", draw.alias("u")).alias("it")))).alias("all"))
    folded = F.aggregate(
        F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))),
        F.struct(F.col("all")[0]["it"].alias("open"), F.slice(F.transform("all", lambda x: x["it"]), 1, 0).alias("done")),
        lambda acc, x: _step(acc, x["it"]),
    )
    rows = grouped.select("source", folded.alias("f")).select("source", F.explode(F.concat(F.transform("f.done", lambda x: F.struct(x["key"].alias("key"), x["p"].alias("p"), x["size"].alias("size"), F.lit(True).alias("decided"))), F.array(F.struct(F.col("f.open.key").alias("key"), F.col("f.open.p").alias("p"), F.col("f.open.size").alias("size"), ((F.col("f.open.p") <= 0.0) | (F.col("f.open.p") >= 1.0)).alias("decided"))))).alias("x"))
    rows = rows.select("source", "x.*")
    if last:
        drawn = F.when(unit_hash(F.col("source"), F.col("key"), F.lit("last")) < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0))
        rows = rows.withColumn("p", F.when(F.col("decided"), F.col("p")).otherwise(drawn)).withColumn("decided", F.lit(True))
    return rows


def _step(acc: Column, new: Column) -> Column:
    still, done = _move(acc["open"], new)
    return F.struct(still.alias("open"), F.concat(acc["done"], F.array(done)).alias("done"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken and nth, the row's number among equal (id, source, size)."""
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"))
    keyed = written(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    sources = keyed.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("source_rows"))
    targets = written(source_targets(sources.select("source", "source_size"), weights, cap).withColumnRenamed("source", "s").join(sources.select(F.col("source").alias("s2"), "source_rows"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    one = keyed.join(targets, F.col("source").eqNullSafe(F.col("s"))).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "s")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    one = one.withColumn("whole", F.floor(p)).withColumn("p", p - F.floor(p)).withColumn("key", F.struct("id", "size", "nth"))
    count = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / block))
    todo = one.filter("p > 0 and size > 0").select("source", "key", "p", F.col("size").cast("double").alias("size"), "source_rows", F.pmod(F.xxhash64("key"), count).alias("block"))
    most = targets.agg(F.max("source_rows")).first()[0] or 1
    decided, level = [], 0
    while True:
        blocks = -(-most // block)
        rounded = written(_level(todo.drop("source_rows"), level, last=blocks <= 1), "rounded")
        decided.append(rounded.filter("decided").select("source", "key", F.col("p").cast("long").alias("extra")))
        if blocks <= 1:
            break
        # The next level: the residuals of a source, dealt anew into blocks.
        counts = targets.select(F.col("s"), F.greatest(F.lit(1), F.ceil(F.col("source_rows") / F.lit(float(block) ** (level + 2)))).alias("count"))
        left = rounded.filter("not decided").join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s", "decided")
        todo = left.select("source", "key", "p", "size", F.lit(0).alias("source_rows"), F.pmod(F.xxhash64("key", F.lit(level)), F.col("count")).alias("block"))
        most, level = blocks, level + 1
    extra = decided[0]
    for x in decided[1:]:
        extra = extra.unionByName(x)
    extra = extra.select(F.col("source").alias("es"), F.col("key").alias("ek"), "extra")
    joined = one.join(extra, (F.col("key") == F.col("ek")) & F.col("source").eqNullSafe(F.col("es")), "left")
    alone = F.when(F.col("size") == 0, (unit_hash(F.col("key"), F.lit("empty")) < F.col("p")).cast("long")).otherwise(F.lit(0).cast("long"))
    copies = F.col("whole") + F.coalesce(F.col("extra"), alone)
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "nth")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")
