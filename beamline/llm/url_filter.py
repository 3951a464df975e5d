"""URL filtering: explicit host and path rules first, then association rules mined from labels.

Each labelled URL is a set of tokens (scheme, words of the host, words of the path, query keys) with its
label as one more item; Spark's FP-growth finds the frequent sets, and those with a label become rules,
kept by support, confidence and significance: as many of the label as chance gives by its share of all
labelled URLs make no rule. A URL has 2^k sets of k tokens, so of a labelled URL with more than ITEMS
frequent tokens FP-growth combines those whose labels lie furthest from chance. Sets that hold a token left out
somewhere are counted anew over all tokens, and those that FP-growth missed are grown from that token, step by step, over
whole rows; only a set in as many rows as one of its subsets is left out, since the subset's rule counts the same and
fits wherever the set's would. So no rule that could decide is lost. A rule is filed in an inverted index under the rarest token of its left
side; a URL looks its tokens up there, and the rule of greatest confidence, then support, that it holds
whole decides. A URL that no rule fits is allowed.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no rule and is allowed;
repeated rows are judged alike, and labelled rows count as often as they stand there; without labels nothing is mined; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: Labelled URLs that a rule needs behind it in any case.
MIN_COUNT = 5
#: Standard deviations that the label's count must lie above chance.
MIN_DEVIATIONS = 3.0
#: Rules up to this number go to all tasks (some 10 MB); more are joined by a shuffle.
BROADCAST_RULES = 50_000
#: Frequent tokens of one labelled URL that FP-growth combines, so 2^ITEMS sets at most; sets that hold any of the others are grown apart.
ITEMS = 12
_LABEL = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL: words between dots, dashes and slashes; runs of digits are one sign."""
    host, path = host_and_path(url)
    of = lambda name, text, cut: F.transform(F.filter(F.split(text, cut), lambda s: s != ""), lambda s: F.concat(F.lit(f"{name}="), s))
    words = of("host", F.regexp_replace(host, "[0-9]+", "#"), "[.\\-_:@]+")
    segments = of("path", lower_ascii(F.regexp_replace(path, "[0-9]+", "#")), "[/.\\-_]+")
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, "\\?([^#]*)", 1), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key="), F.split(s, "=")[0]))
    scheme = F.array(F.concat(F.lit("scheme="), lower_ascii(F.regexp_extract(url, "^[^:]*", 0))), F.when(F.contains(url, F.lit("#")), F.lit("fragment")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.concat(words, segments, keys, scheme))))


def _transactions(rows: DataFrame, n: int, support: float) -> DataFrame:
    """(r, items, cut): each labelled row's label and frequent tokens; of more than ITEMS tokens, those whose labels lie furthest from chance, and the others in cut."""
    prior = rows.groupBy("verdict").agg((F.count(F.lit(1)) / F.lit(float(max(1, n)))).alias("prior"))
    by_label = rows.select("verdict", F.explode("tokens").alias("token")).groupBy("token", "verdict").agg(F.count(F.lit(1)).alias("hits")).join(F.broadcast(prior), "verdict")
    times = by_label.groupBy("token").agg(F.sum("hits").alias("times"), F.collect_list(F.struct("hits", "prior")).alias("labels")).filter(F.col("times") >= F.lit(support * n))
    far = F.array_max(F.transform("labels", lambda x: F.abs(x["hits"] - F.col("times") * x["prior"]) / F.sqrt(F.greatest(F.lit(1e-9), F.col("times") * x["prior"] * (1 - x["prior"])))))
    # As many tokens are frequent as a labelled row has on average, divided by the least support.
    frequent = written(times.select("token", far.alias("far")), "frequent")
    held = rows.select("r", F.explode("tokens").alias("token")).join(F.broadcast(frequent), "token").groupBy("r").agg(F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("near"), "token"))).alias("all"))
    tokens = F.transform("all", lambda x: x["token"])
    label = F.array(F.concat(F.lit(_LABEL), "verdict"))
    mined = rows.select("r", "verdict").join(held, "r", "left").withColumn("all", F.coalesce(tokens, F.array().cast("array<string>")))
    return mined.select("r", F.concat(F.slice("all", 1, ITEMS), label).alias("items"), F.slice("all", ITEMS + 1, 2**31 - 1).alias("cut"))


def _recounted(found: DataFrame, rows: DataFrame, items: DataFrame, need: int) -> DataFrame:
    """found (items, freq), with those that hold a token which was cut somewhere counted anew over all tokens of rows, and those that the cut hid."""
    cut = written(items.select(F.explode("cut").alias("token")).distinct(), "cut")
    if not cut.limit(1).count():
        return found
    touched = found.withColumn("token", F.explode("items")).join(F.broadcast(cut), "token", "left_semi").select("items").distinct()
    # Sets without a label are counted with their label's set too: both sides of a confidence are whole.
    sets = written(touched.withColumn("key", F.element_at(F.filter("items", lambda x: ~x.startswith(_LABEL)), 1)), "touched")
    all_ = rows.select("r", F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("all"))
    counts = all_.withColumn("key", F.explode("all")).join(sets, "key").filter(F.size(F.array_except("items", "all")) == 0).groupBy("items").agg(F.count(F.lit(1)).alias("times"))
    known = written(found.join(counts, "items", "left").select("items", F.coalesce("times", "freq").alias("freq")), "recounted")
    return known.unionByName(_grown(items, cut, need).join(known, "items", "left_anti"))


def _grown(items: DataFrame, cut: DataFrame, need: int) -> DataFrame:
    """(items, freq) of the sets that hold a cut token and have a label at least need times, counted in whole rows, alone and with their labels.

    A set grows by one token at a time, cut ones first, so each is met on one way. Its subsets lie in the round before, if each of them
    is in more rows than the set; otherwise the set says no more than a subset, and neither does what would grow from it.
    """
    cuts = cut.agg(F.sort_array(F.collect_set("token")).alias("cuts"))  # frequent tokens only
    whole = items.select(F.concat(F.slice("items", 1, F.size("items") - 1), "cut").alias("all"), F.element_at("items", -1).alias("label")).join(F.broadcast(cuts))
    first = F.array_intersect("cuts", "all")
    alike = whole.select(F.concat(first, F.sort_array(F.array_except("all", "cuts"))).alias("line"), F.size(first).alias("firsts"), "label").filter("firsts > 0").groupBy("line", "firsts", "label").agg(F.count(F.lit(1)).alias("n"))
    lines = written(alike.withColumn("g", F.monotonically_increasing_id()), "whole-rows")
    sets = lines.select("g", "n", "label", F.explode(F.sequence(F.lit(1), "firsts")).alias("at"), F.array(F.element_at("line", F.col("at"))).alias("set"))
    before, done = None, []
    while True:
        sets = written(sets, "grown-sets")
        hits = sets.groupBy("set", "label").agg(F.sum("n").alias("hits"))
        counts = hits.groupBy("set").agg(F.sum("hits").alias("times"), F.collect_list(F.struct("label", "hits")).alias("labels")).filter(F.array_max(F.transform("labels", lambda x: x["hits"])) >= need)
        if before is not None:
            less = F.transform(F.sequence(F.lit(2), F.size("set")), lambda i: F.concat(F.slice("set", F.lit(1), i - 1), F.slice("set", i + 1, F.size("set"))))
            more = counts.select("set", "times", F.explode(less).alias("less")).join(before.select(F.col("set").alias("less"), F.col("times").alias("most")), "less").filter("times < most")
            counts = counts.join(more.groupBy("set").agg(F.count(F.lit(1)).alias("k")), "set").filter(F.col("k") == F.size("set") - 1).drop("k")
        before = written(counts, "grown-counts")
        if not before.limit(1).count():
            break
        done.append(before)
        open_ = sets.join(before.select("set"), "set", "left_semi").join(lines.select("g", "line"), "g").filter(F.col("at") < F.size("line"))
        step = open_.select("g", "n", "label", "set", "line", F.explode(F.sequence(F.col("at") + 1, F.size("line"))).alias("at"))
        sets = step.select("g", "n", "label", "at", F.concat("set", F.array(F.element_at("line", F.col("at")))).alias("set"))
    found = before
    for counts in done:
        found = found.unionByName(counts)
    labelled = found.select("set", F.explode("labels").alias("x")).filter(F.col("x.hits") >= need).select(F.concat("set", F.array("x.label")).alias("items"), F.col("x.hits").alias("freq"))
    return found.select(F.col("set").alias("items"), F.col("times").alias("freq")).unionByName(labelled).select(F.sort_array("items").alias("items"), "freq")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_deviations: float = MIN_DEVIATIONS) -> DataFrame:
    """labelled (tokens, verdict) -> (key, left, verdict, confidence, support): significant rules, each under its rarest token."""
    rows = written(labelled.select(F.array_distinct("tokens").alias("tokens"), "verdict").withColumn("r", F.monotonically_increasing_id()), "labelled")
    n = rows.count()
    support = min(1.0, max(min_support, min_count / max(1, n)))
    items = written(_transactions(rows, n, support), "transactions")
    found = written(FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items.select("items")).freqItemsets.select(F.sort_array("items").alias("items"), "freq"), "itemsets")
    found = _recounted(found, rows, items, ceil(support * n))
    label = F.filter("items", lambda x: x.startswith(_LABEL))
    both = found.filter((F.size(label) == 1) & (F.size("items") > 1)).select(F.filter("items", lambda x: ~x.startswith(_LABEL)).alias("left"), F.substring(F.get(label, F.lit(0)), len(_LABEL) + 1, 100).alias("verdict"), F.col("freq").alias("hits"))
    alone = found.select(F.col("items").alias("left"), F.col("freq").alias("times"))
    prior = found.filter((F.size("items") == 1) & (F.size(label) == 1)).select(F.substring(F.get("items", F.lit(0)), len(_LABEL) + 1, 100).alias("verdict"), (F.col("freq") / F.lit(float(max(1, n)))).alias("prior"))
    rules = both.join(alone, "left").join(prior, "verdict").withColumn("confidence", F.col("hits") / F.col("times")).withColumn("support", F.col("hits") / F.lit(float(max(1, n))))
    chance = F.col("times") * F.col("prior")
    rules = rules.filter((F.col("confidence") >= min_confidence) & (F.col("hits") - chance > min_deviations * F.sqrt(chance * (1 - F.col("prior")))))
    single = found.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), F.col("freq").alias("seen"))
    rarest = rules.select("left", "verdict", F.explode("left").alias("token")).join(single, "token").groupBy("left", "verdict").agg(F.min(F.struct("seen", "token")).alias("m"))
    return rules.join(rarest, ["left", "verdict"]).select(F.col("m.token").alias("key"), "left", "verdict", "confidence", "support")


def judge(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, confidence (of the mined rule, where one decides)."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("u"), host.alias("host"), path.alias("path"))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    mined = written(mined, "rules")
    few = mined.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    open_ = rows.filter("rule is null and u is not null").select("u").distinct().withColumn("tokens", url_tokens(F.col("u")))
    looked = open_.select("u", "tokens", F.explode("tokens").alias("key")).join(F.broadcast(mined) if few else mined, "key").filter(F.size(F.array_except("left", "tokens")) == 0)
    best = looked.groupBy("u").agg(F.max(F.struct("confidence", "support", "verdict", "left")).alias("best")).select(F.col("u").alias("v"), "best.verdict", "best.confidence")
    out = rows.join(best, F.col("u") == F.col("v"), "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruled", "verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Labels of a page are those of its id: blocked if toxic or of low quality."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("block")).otherwise(F.lit("allow"))
    labelled = pages.filter("url is not null").join(labels, pages["page_id"] == labels["doc_id"]).select(url_tokens(F.col("url")).alias("tokens"), bad.alias("verdict")).filter(F.size("tokens") > 0)
    return judge(pages, mine_rules(labelled))
