"""Patterns learned from the tokens of a group, and the table of patterns that is updated as tokens come.

Tokens of one make-up (runs of letters, numbers, single other characters) are generalised place by place. The
lists of fragments that come of it are the paths of a trie. It is folded from its deepest level upwards, one
grouping a level: branches that go on alike become one branch with a choice of heads, and what is under a
node becomes its tail. Groups are only ever reduced by key, so partial tries merge in any order.

Defined cases: null and blank tokens teach nothing; tokens are read in upper case, without spaces at their
ends; repeated tokens count once; a group without tokens has no pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

RUN = "([A-Z]+|[0-9]+(?:\\.[0-9]+)?|[^A-Z0-9])"
#: So many letter runs at a place are listed, more become any letters.
LISTED, ANY_LETTERS = 4, "[A-Z]+"
WHOLE, DECIMAL, EITHER = "\\d+", "\\d+\\.\\d+", "\\d+(?:\\.\\d+)?"
#: Fixed values of how specific a pattern is: start, each literal and how many of them count, a wildcard, letters of any kind with so many literals at most.
SPECIFIC_START, LITERAL, LITERALS, WILD, LOOSE, LOOSE_LITERALS = 0.60, 0.05, 8, 0.40, 0.15, 1
#: Fixed values of how readable a pattern is: the length that reads easily, what longer ones lose a character and at most, groups and choices likewise, the least.
EASY, A_CHARACTER, AT_LENGTH, A_GROUP, AT_GROUPS, A_CHOICE, AT_CHOICES, LEAST_READABLE = 24, 1 / 64, 0.55, 0.04, 0.30, 0.03, 0.20, 0.05
#: Weights of coverage, specificity, readability and support, the support that is enough, the most.
COVERAGE, SPECIFICITY, READABILITY, SUPPORT, ENOUGH, MOST = 0.50, 0.20, 0.20, 0.10, 8, 0.97


def read(token: Column) -> Column:
    return F.upper(F.trim(token))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\.^$|?*+()\\[\\]{}])", "\\\\$1")


def fits(token: Column, pattern: Column) -> Column:
    """Whether the whole token is of the pattern."""
    return F.rlike(read(token), F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


def choice(parts: Column) -> Column:
    return F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat(F.lit("(?:"), F.array_join(parts, "|"), F.lit(")")))


def fragment_lists(tokens: DataFrame, group: str, token: str) -> DataFrame:
    """(group, fragments): of each make-up of a group's tokens, one fragment for each of its places."""
    runs = F.regexp_extract_all(read(F.col(token)), F.lit(RUN), F.lit(1))
    kind = lambda r: F.when(r.rlike("^[A-Z]"), F.lit("A")).when(r.rlike("^[0-9]"), F.lit("N")).otherwise(F.concat(F.lit("S"), r))
    rows = tokens.select(F.col(group).alias("g"), runs.alias("runs")).filter("size(runs) > 0").distinct().withColumn("made", F.transform("runs", kind))
    places = rows.select("g", "made", F.posexplode("runs").alias("place", "run")).distinct()
    at = ["g", "made", "place"]
    decimal = F.contains("run", F.lit(".")).cast("int")
    numbers = places.filter("run rlike '^[0-9]'").groupBy(*at).agg(F.min(decimal).alias("all"), F.max(decimal).alias("any"))
    numbers = numbers.select(*at, F.when(F.col("all") == 1, F.lit(DECIMAL)).when(F.col("any") == 1, F.lit(EITHER)).otherwise(F.lit(WHOLE)).alias("fragment"))
    first = places.filter("not run rlike '^[0-9]'").withColumn("nth", F.row_number().over(W.partitionBy(*at).orderBy("run"))).filter(F.col("nth") <= LISTED + 1)
    texts = first.groupBy(*at).agg(F.sort_array(F.collect_list(escaped(F.col("run")))).alias("seen")).select(*at, F.when(F.size("seen") > LISTED, F.lit(ANY_LETTERS)).otherwise(choice(F.col("seen"))).alias("fragment"))
    lists = numbers.unionByName(texts).groupBy("g", "made").agg(F.sort_array(F.collect_list(F.struct("place", "fragment"))).alias("f"))
    return lists.select("g", F.transform("f", lambda x: x["fragment"]).alias("fragments"))


def merged(lists: DataFrame) -> DataFrame:
    """(g, pattern): one pattern for each group, that fits what any of its fragment lists fits."""
    lists = written(lists.distinct(), "fragment-lists")
    deepest = lists.agg(F.max(F.size("fragments"))).first()[0] or 0
    ends = lists.select("g", F.col("fragments").alias("path"), F.lit(True).alias("ends"))
    at = lambda d: ends.filter(F.size("path") == d)
    nodes = at(deepest).select("g", "path", F.lit("").alias("tail"))
    for d in range(deepest, 0, -1):
        parent = F.slice("path", 1, d - 1) if d > 1 else F.array().cast("array<string>")
        alike = nodes.select("g", parent.alias("path"), F.col("path")[d - 1].alias("head"), "tail").groupBy("g", "path", "tail").agg(F.sort_array(F.collect_set("head")).alias("heads"))
        branches = alike.groupBy("g", "path").agg(F.sort_array(F.collect_list(F.concat(choice(F.col("heads")), "tail"))).alias("branches"))
        both = branches.join(at(d - 1), ["g", "path"], "full").withColumn("body", choice(F.col("branches")))
        tail = F.when(F.col("branches").isNull(), F.lit("")).when(F.col("ends"), F.concat(F.lit("(?:"), "body", F.lit(")?"))).otherwise(F.col("body"))
        nodes = written(both.select("g", "path", tail.alias("tail")), "trie-level")
    return nodes.select("g", F.col("tail").alias("pattern"))


def simplified(patterns: DataFrame) -> DataFrame:
    """(g, pattern) with each pattern rewritten until no rule applies: plain groups opened, a choice's repeats and empty options dropped, slashes plain."""
    now = written(patterns, "patterns")
    while True:
        p = F.regexp_replace("pattern", "\\(\\?:((?:[A-Za-z0-9]|\\\\[A-Za-z0-9])+)\\)(?![?*+{])", "$1")
        p = F.regexp_replace(p, "(?<=\\(\\?:|\\|)((?:[^()|\\\\]|\\\\.)+)\\|(?=(?:(?:[^()|\\\\]|\\\\.)+\\|)*\\1[|)])", "")
        p = F.replace(F.replace(p, F.lit("(?:)?"), F.lit("")), F.lit("\\/"), F.lit("/"))
        after = written(now.select("g", F.col("pattern").alias("was"), p.alias("pattern")), "simplified")
        if not after.filter("was <> pattern").limit(1).count():
            return after.select("g", "pattern")
        now = after.select("g", "pattern")


def learned(tokens: DataFrame, group: str, token: str) -> DataFrame:
    """(g, pattern) that fits every token of its group."""
    return simplified(merged(fragment_lists(tokens, group, token)))


def specificity(pattern: Column) -> Column:
    """In 0 to 1: literals are specific, wildcards and letters of any kind are not."""
    literals = F.length(F.regexp_replace(pattern, "[^A-Za-z0-9]", ""))
    wild = F.when(F.contains(pattern, F.lit(".*")) | F.contains(pattern, F.lit(".+")), WILD).otherwise(0.0)
    loose = F.when(F.contains(pattern, F.lit(ANY_LETTERS)) & (literals <= LOOSE_LITERALS), LOOSE).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), SPECIFIC_START + LITERAL * F.least(literals, F.lit(LITERALS)) - wild - loose))


def readability(pattern: Column) -> Column:
    """In 0.05 to 1: length, groups and choices make a pattern hard to read."""
    times = lambda x: (F.length(pattern) - F.length(F.replace(pattern, F.lit(x), F.lit("")))) / len(x)
    long_ = F.least(F.lit(AT_LENGTH), F.greatest(F.lit(0), F.length(pattern) - EASY) * A_CHARACTER)
    return F.greatest(F.lit(LEAST_READABLE), 1 - long_ - F.least(F.lit(AT_GROUPS), A_GROUP * times("(?:")) - F.least(F.lit(AT_CHOICES), A_CHOICE * times("|")))


def trust(share: Column, pattern: Column, total: Column) -> Column:
    """Confidence in a pattern that fits this share of a group's tokens."""
    return F.least(F.lit(MOST), COVERAGE * share + SPECIFICITY * specificity(pattern) + READABILITY * readability(pattern) + SUPPORT * F.least(F.lit(1.0), total / ENOUGH))


def judged(patterns: DataFrame, tokens: DataFrame) -> DataFrame:
    """(g, pattern, total, matched, confidence) of patterns (g, pattern) over tokens (g, token)."""
    counts = tokens.join(patterns, "g").groupBy("g", "pattern").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(fits(F.col("token"), F.col("pattern")), 1)).alias("matched"))
    return counts.withColumn("confidence", F.round(trust(F.col("matched") / F.col("total"), F.col("pattern"), F.col("total")), 6))


def learn_or_reuse(known: DataFrame, examples: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates known (g, pattern, version) and examples (g, token) by tokens (g, token).

    A token that its group's pattern fits teaches nothing. The others join the group's examples; a pattern is learned
    from them all and taken if there was none, or if its confidence over them is not less. known comes back with status:
    reused (all tokens fitted, or none came), created, reinforced (the same pattern), updated or kept_previous.
    """
    news = tokens.select("g", read(F.col("token")).alias("token")).filter("token <> ''").distinct()
    old = known.select("g", F.col("pattern").alias("old"), "version")
    open_ = written(news.join(old, "g", "left").filter(F.col("old").isNull() | ~fits(F.col("token"), F.col("old"))).select("g", "token"), "open-tokens")
    examples = written(examples.select("g", "token").union(open_).distinct(), "examples")
    touched = examples.join(open_.select("g").distinct(), "g", "left_semi")
    fresh = judged(learned(touched, "g", "token"), touched).select("g", F.col("pattern").alias("new"), F.col("confidence").alias("new_trust"))
    before = judged(known.select("g", "pattern"), touched).select("g", F.col("confidence").alias("old_trust"))
    met = old.join(fresh, "g", "full").join(before, "g", "left")
    status = F.when(F.col("new").isNull(), "reused").when(F.col("old").isNull(), "created").when(F.col("new") == F.col("old"), "reinforced").when(F.col("new_trust") >= F.col("old_trust"), "updated").otherwise("kept_previous")
    rows = met.withColumn("status", status).withColumn("taken", F.col("status").isin("created", "updated"))
    rows = rows.select("g", F.when(F.col("taken"), F.col("new")).otherwise(F.col("old")).alias("pattern"), (F.coalesce("version", F.lit(0)) + F.col("taken").cast("int")).alias("version"), "status")
    return written(rows, "known-patterns"), examples
