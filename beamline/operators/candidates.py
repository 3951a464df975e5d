"""Candidate labels of a printed token, by ever looser rules; every join is on keys, never on all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.labels import LIKE_DIGITS, family_of, grams, normalised
from ..sources.scratch import written


def first_of(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, numbered as place."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def exact(printed: DataFrame, catalog: DataFrame) -> DataFrame:
    return printed.withColumn("norm", normalised(F.col("printed"))).join(catalog.select("label"), F.col("norm") == F.col("label"), "left").select("p_partkey", "printed", F.col("label").alias("section"))


def fitting(masks: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(*by, mask, label): labels (*by, text, label) whose text agrees with the mask (*by, mask) wherever that has no underscore; both are of one length where by agree.

    Each label is filed under its text with the places left open that some mask of its kind leaves open, so masks meet labels by equality.
    """
    masks = masks.select(*by, "mask").distinct()
    shapes = masks.select(*by, F.regexp_replace("mask", "[^_]", ".").alias("shape")).distinct()
    opened = F.array_join(F.zip_with(F.split("text", ""), F.split("shape", ""), lambda t, s: F.when(s == "_", s).otherwise(t)), "")
    return masks.join(labels.join(shapes, by).select(*by, "label", opened.alias("mask")), [*by, "mask"])


def first_of_asked(asked: DataFrame, best: DataFrame, on: list[str], most: int, key: str = "p_partkey") -> DataFrame:
    """asked (key, *on, ...) with the first labels of what it asks, best (*on, label, place); only a key that stands there more than once is ranked anew over all its rows."""
    met = asked.withColumn("many", F.count(F.lit(1)).over(W.partitionBy(key)) > 1).join(best, on)
    again = first_of(met.filter("many").drop("place"), [key], [F.col("label")], most)
    return met.filter("not many").unionByName(again).drop("many")


def wildcard(printed: DataFrame, catalog: DataFrame, most: int = 8) -> DataFrame:
    """Labels of the mask's family and length that agree wherever the mask has no wildcard; each distinct mask is searched once."""
    norm = F.col("norm")
    masks = printed.withColumn("norm", normalised(F.col("printed"))).filter("norm like '%*%'").select("p_partkey", "norm", family_of(norm).alias("family"), F.length(norm).alias("n"), F.translate(norm, "*", "_").alias("mask"))
    labels = catalog.select("label", "family", F.length("label").alias("n"), F.col("label").alias("text"))
    best = first_of(fitting(masks, labels, ["family", "n"]), ["family", "mask"], [F.col("label")], most).select("family", "mask", "label", "place")
    return first_of_asked(masks, best, ["family", "mask"], most).select("p_partkey", "norm", "label", "place")


def like_print(printed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Labels that print alike: both sides meet on one spelling of confusable characters."""
    spell = lambda c: F.translate(c, *LIKE_DIGITS)
    return printed.withColumn("key", spell(normalised(F.col("printed")))).join(catalog.select("label", spell(F.col("label")).alias("key")), "key").select("p_partkey", "printed", "label")


def completion(printed: DataFrame, catalog: DataFrame, most: int = 10) -> DataFrame:
    """Labels of the same family and first field whose last field begins with what is left of it."""
    read = "^(WT|HP|MC|W|M|C)([0-9]+)X([0-9]*)$"
    norm = normalised(F.col("printed"))
    cut = printed.select("p_partkey", F.regexp_extract(norm, read, 1).alias("family"), F.nullif(F.regexp_extract(norm, read, 2), F.lit("")).cast("long").alias("depth"), F.regexp_extract(norm, read, 3).alias("rest")).filter("depth is not null")
    hit = cut.join(catalog.select("family", "depth", "weight", "label"), ["family", "depth"]).filter(F.col("weight").cast("string").startswith(F.col("rest")))
    return first_of(hit, ["p_partkey"], [F.col("weight"), F.col("label")], most).select("p_partkey", "label", "place")


def nearest_fields(catalog: DataFrame, most: int = 3) -> DataFrame:
    """Of each label the nearest others of its family.

    Labels within one step of the first field meet first; where the last of them is as far as a label two
    steps away may be, the whole family is searched.
    """
    near = _within_a_step(catalog, most)
    far = 20  # the least distance at two steps
    closed = near.filter((F.col("place") == most) & (F.col("distance") < far)).select("label")
    near = near.join(closed, "label", "left_semi")
    other = catalog.select("family", F.col("depth").alias("d"), F.col("weight").alias("w"), F.col("label").alias("near"))
    both = catalog.join(closed, "label", "left_anti").join(other, "family").filter(F.col("label") != F.col("near")).withColumn("distance", 10 * F.abs(F.col("depth") - F.col("d")) + F.abs(F.col("weight") - F.col("w")))
    return near.unionByName(first_of(both, ["label"], [F.col("distance"), F.col("near")], most).select("label", "near", "distance", "place"))


def near_fields(catalog: DataFrame, within: int) -> DataFrame:
    """(label, near, distance): other labels of a family at most so far apart, by equality of fields at each of the steps that allows; 10 a step of the first field, 1 of the last."""
    steps = [(i, j) for i in range(-(within // 10), within // 10 + 1) for j in range(-within, within + 1) if 0 < 10 * abs(i) + abs(j) <= within]
    step = F.explode(F.array(*[F.struct((F.col("depth") + i).alias("depth"), (F.col("weight") + j).alias("weight"), F.lit(10 * abs(i) + abs(j)).cast("long").alias("distance")) for i, j in steps]))
    return catalog.select("label", "family", step.alias("s")).select("label", "family", "s.*").join(catalog.select("family", "depth", "weight", F.col("label").alias("near")), ["family", "depth", "weight"]).filter("label <> near").select("label", "near", "distance")


def _within_a_step(catalog: DataFrame, most: int) -> DataFrame:
    other = catalog.select("family", F.explode(F.array(F.col("depth") - 1, F.col("depth"), F.col("depth") + 1)).alias("depth"), F.col("depth").alias("d"), F.col("weight").alias("w"), F.col("label").alias("near"))
    both = catalog.join(other, ["family", "depth"]).filter(F.col("label") != F.col("near")).withColumn("distance", 10 * F.abs(F.col("depth") - F.col("d")) + F.abs(F.col("weight") - F.col("w")))
    return first_of(both, ["label"], [F.col("distance"), F.col("near")], most).select("label", "near", "distance", "place")


def _deletions(text: Column, most: int) -> Column:
    """The text with up to `most` characters left out, each result once."""
    without = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array(t))
    found = last = F.array(text)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, without)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def _within(tokens: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(norm, label, distance) of all pairs within an edit distance: such texts agree once so many characters are left out of both."""
    key = lambda c: F.explode(_deletions(F.col(c), most)).alias("key")
    met = tokens.select("norm", key("norm")).join(labels.select("label", key("label")), "key").select("norm", "label").distinct()
    return met.withColumn("distance", F.levenshtein("norm", "label")).filter(F.col("distance") <= most)


def edit_distance(printed: DataFrame, catalog: DataFrame, most: int = 3, limit: int = 2) -> DataFrame:
    """The nearest labels within an edit distance; tokens that have enough at a lesser one are searched no further."""
    named = printed.select("p_partkey", normalised(F.col("printed")).alias("norm"))
    labels, open_, found = catalog.select("label"), written(named.select("norm").distinct(), "tokens"), None
    for distance in range(1, limit + 1):
        near = first_of(_within(open_, labels, distance), ["norm"], [F.col("distance"), F.col("label")], most)
        near = written(near, "near-labels")
        full = near.filter(F.col("place") == most).select("norm")
        done = near.join(full, "norm", "left_semi") if distance < limit else near
        found = done if found is None else found.unionByName(done)
        open_ = open_.join(full, "norm", "left_anti")
    return named.join(found, "norm").select("p_partkey", "label", "distance", "place")


def _rare_first(rows: DataFrame, key: str, text: Column, seen: DataFrame, n: int) -> DataFrame:
    """(key, grams): the distinct n-grams of each text, those of the fewest labels first."""
    apart = rows.select(key, F.explode(grams(text, n)).alias("gram")).join(seen, "gram", "left")
    sorted_ = F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram")))
    return apart.groupBy(key).agg(F.transform(sorted_, lambda x: x["gram"]).alias("grams"))


def gram_similarity(printed: DataFrame, catalog: DataFrame, n: int = 3, most: int = 3) -> DataFrame:
    """Labels by the Jaccard similarity of character n-grams, through an inverted index of distinct tokens.

    Pairs of a similarity of at least t share one of the rarest n-grams of each, so only those are indexed,
    first for a high t; tokens that have enough labels there are searched no further.
    """
    named = printed.select("p_partkey", normalised(F.col("printed")).alias("norm"))
    seen = written(catalog.select(F.explode(grams(F.col("label"), n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("seen")), "grams")
    labels = written(_rare_first(catalog, "label", F.col("label"), seen, n).withColumnRenamed("grams", "others"), "label-grams")
    open_, found = written(_rare_first(named.select("norm").distinct(), "norm", F.col("norm"), seen, n), "token-grams"), None
    for least in (0.5, 0.25, 0.0):
        first = lambda c: F.explode(F.slice(c, 1, (F.size(c) - F.ceil(F.size(c) * least) + 1).cast("int"))).alias("gram")
        met = open_.select("norm", "grams", first("grams")).join(labels.select("label", "others", first("others")), "gram").dropDuplicates(["norm", "label"])
        common = F.size(F.array_intersect("grams", "others"))
        score = met.select("norm", "label", (common / (F.size("grams") + F.size("others") - common)).alias("score")).filter(F.col("score") >= least)
        near = written(first_of(score, ["norm"], [F.desc("score"), F.col("label")], most), "near-labels")
        full = near.filter(F.col("place") == most).select("norm")
        done = near.join(full, "norm", "left_semi") if least else near
        found = done if found is None else found.unionByName(done)
        open_ = open_.join(full, "norm", "left_anti")
    return named.join(found, "norm").select("p_partkey", "label", F.round("score", 6).alias("score"), "place")


def union_by_priority(strategies: list[tuple[str, DataFrame]], most: int = 25) -> DataFrame:
    """All strategies' (p_partkey, label, place); the first strategy that names a label keeps it."""
    parts = [d.select("p_partkey", "label", "place").withColumn("strategy", F.lit(name)).withColumn("priority", F.lit(i)) for i, (name, d) in enumerate(strategies)]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    once = first_of(rows.withColumnRenamed("place", "within"), ["p_partkey", "label"], [F.col("priority"), F.col("within")], 1).drop("place")
    return first_of(once, ["p_partkey"], [F.col("priority"), F.col("within"), F.col("label")], most).select("p_partkey", "label", "strategy", "place")


def rank_metrics(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """ranked (p_partkey, label, place) against truth (p_partkey, label): one row of rates."""
    hit = truth.join(ranked, ["p_partkey", "label"], "left").groupBy("p_partkey").agg(F.min("place").alias("place"))
    rate = lambda k: F.round(F.avg((F.coalesce("place", F.lit(10**6)) <= k).cast("double")), 6)
    return hit.agg(F.count(F.lit(1)).alias("n"), rate(1).alias("top1"), rate(3).alias("top3"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))
