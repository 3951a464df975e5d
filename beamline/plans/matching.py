"""Catalog forms, looser field joins, and similarity of printed tokens to labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import normalised
from ..operators import candidates, fuzzy
from ..registry import query
from ..sources.tables import PARTS_SQL, catalog, labelled_parts
from .catalog import _NORM

#: Spellings of a label in running text, by part: a multiplication sign and a comma, an inch mark, a cut length, none.
_SPELLED = """CASE p_partkey % 4 WHEN 0 THEN lower(replace(label, 'X', ' × ')) || ',' WHEN 1 THEN label || '"' WHEN 2 THEN label || 'X12''-6"' ELSE label END"""
_CLEAN = r"""regexp_replace(regexp_replace(upper(replace(replace(raw, ' ', ''), '×', 'X')), '[,;:]+$', ''), '"$', '')"""
_CUT = r"""regexp_replace(regexp_replace(regexp_replace(upper(replace(replace(raw, ' ', ''), '×', 'X')), '[,;:]+$', ''), 'X[0-9]+''(-[0-9]+"?)?$', ''), '"$', '')"""


@query(
    "catalog_form",
    f"""WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_SPELLED} AS raw FROM parts), f AS (SELECT *, {_CLEAN} AS clean, {_CUT} AS cut FROM s)
SELECT p_partkey, raw, coalesce(a.label, b.label, '') AS form FROM f LEFT JOIN catalog a ON a.label = clean LEFT JOIN catalog b ON b.label = cut""",
)
def catalog_form(spark, sf_dir):
    """The catalog's spelling of a token: as it is, then without its cut length; empty if neither is a label."""
    raw = F.expr(_SPELLED.replace("''", "\\'"))
    spelled = labelled_parts(spark, sf_dir).select("p_partkey", raw.alias("raw"))
    plain = F.regexp_replace(F.upper(F.replace(F.replace("raw", F.lit(" "), F.lit("")), F.lit("×"), F.lit("X"))), "[,;:]+$", "")
    ends = lambda c: F.regexp_replace(c, '"$', "")
    forms = F.array(ends(plain), ends(F.regexp_replace(plain, "X[0-9]+'(-[0-9]+\"?)?$", "")))
    tried = spelled.select("p_partkey", "raw", F.posexplode(forms).alias("turn", "form"))
    hit = tried.join(catalog(spark, sf_dir).select("label"), F.col("form") == F.col("label"), "left")
    first = F.min(F.when(F.col("label").isNotNull(), F.struct("turn", "label")))
    return hit.groupBy("p_partkey", "raw").agg(first.alias("f")).select("p_partkey", "raw", F.coalesce("f.label", F.lit("")).alias("form"))


_ASKED = """CASE p_partkey % 3 WHEN 0 THEN '*' WHEN 1 THEN CAST(depth AS VARCHAR(9)) ELSE CAST(depth AS VARCHAR(9)) END AS a, CASE p_partkey % 3 WHEN 1 THEN '' ELSE CAST(weight AS VARCHAR(9)) END AS b"""


@query(
    "field_any",
    f"""WITH {PARTS_SQL}, q AS (SELECT p_partkey, family, {_ASKED} FROM parts),
j AS (SELECT q.p_partkey, c.label, CAST(row_number() OVER (PARTITION BY q.p_partkey ORDER BY c.label) AS INTEGER) AS place FROM q JOIN catalog c ON c.family = q.family AND (q.a IN ('*', '') OR q.a = CAST(c.depth AS VARCHAR)) AND (q.b IN ('*', '') OR q.b = CAST(c.weight AS VARCHAR)))
SELECT * FROM j WHERE place <= 8""",
)
def field_any(spark, sf_dir):
    """A field of wildcards alone, or none, fits any value; each case is a join on the fields that are given, of each distinct request once."""
    asked = labelled_parts(spark, sf_dir).select("p_partkey", "family", F.expr(_ASKED.split(" AS a, ")[0]).alias("a"), F.expr(_ASKED.split(" AS a, ")[1].removesuffix(" AS b")).alias("b"))
    labels = catalog(spark, sf_dir).select("family", F.col("depth").cast("string").alias("a"), F.col("weight").cast("string").alias("b"), "label")
    any_ = lambda c: F.col(c).isin("*", "")
    once = asked.select("family", "a", "b").distinct()
    both = once.filter(~any_("a") & ~any_("b")).join(labels, ["family", "a", "b"])
    first = once.filter(~any_("a") & any_("b")).join(labels.drop("b"), ["family", "a"])
    second = once.filter(any_("a") & ~any_("b")).join(labels.drop("a"), ["family", "b"])
    rows = both.unionByName(first).unionByName(second)
    best = candidates.first_of(rows, ["family", "a", "b"], [F.col("label")], 8).select("family", "a", "b", "label", "place")
    return candidates.first_of_asked(asked, best, ["family", "a", "b"], 8).select("p_partkey", "label", "place")


@query("fuzzy_ratio")
def fuzzy_ratio(spark, sf_dir):
    """The three best labels of each printed token by matching blocks; distinct tokens are compared once."""
    printed = labelled_parts(spark, sf_dir).select("p_partkey", normalised(F.col("printed")).alias("norm"))
    best = fuzzy.ratio_search(printed, catalog(spark, sf_dir))
    return printed.join(best, "norm").select("p_partkey", "norm", "label", "ratio")


@query("weighted_edits")
def weighted_edits(spark, sf_dir):
    """How far each print is from its label, where characters that print alike cost half."""
    printed = labelled_parts(spark, sf_dir).select(normalised(F.col("printed")).alias("norm"), "label").groupBy("norm", "label").agg(F.count(F.lit(1)).alias("n"))
    return printed.select("norm", "label", "n", fuzzy.weighted_edits(F.col("norm"), F.col("label")).alias("distance"))


_AFFIX = """len(list_filter(range(1, least(length(norm), length(label)) + 1), lambda i: {f}))"""


@query(
    "affix_lengths",
    f"""WITH {PARTS_SQL}, p AS (SELECT p_partkey, {_NORM} AS norm, label FROM printed)
SELECT p_partkey, {_AFFIX.format(f="norm[1:i] = label[1:i]")} AS prefix, {_AFFIX.format(f="right(norm, i) = right(label, i)")} AS suffix, {_AFFIX.format(f="norm[i] = label[i]")} AS positional FROM p""",
)
def affix_lengths(spark, sf_dir):
    """Lengths of the common beginning and end of print and label, and characters that agree in place."""
    p = labelled_parts(spark, sf_dir).select("p_partkey", normalised(F.col("printed")).alias("norm"), "label").withColumn("n", F.least(F.length("norm"), F.length("label")))
    hits = lambda fits: F.size(F.filter(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")), fits)).cast("long")
    left = lambda c, i: F.substring(F.col(c), F.lit(1), i)
    right = lambda c, i: F.substring(F.col(c), F.length(c) - i + 1, i)
    at = lambda c, i: F.substring(F.col(c), i, F.lit(1))
    same = lambda g: hits(lambda i: g("norm", i) == g("label", i))
    return p.select("p_partkey", same(left).alias("prefix"), same(right).alias("suffix"), same(at).alias("positional"))


@query(
    "normalise_steps",
    f"""WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_SPELLED} AS raw FROM parts)
SELECT p_partkey, {_CLEAN} AS value, array_to_string(list_filter([CASE WHEN raw <> upper(raw) THEN 'upper' END, CASE WHEN contains(raw, ' ') THEN 'spaces' END, CASE WHEN contains(raw, '×') THEN 'times' END,
  CASE WHEN regexp_matches(raw, '[,;:]+$') THEN 'separators' END, CASE WHEN regexp_matches(raw, '"$') THEN 'inch' END], lambda x: x IS NOT NULL), '+') AS steps FROM s""",
)
def normalise_steps(spark, sf_dir):
    """The cleaned token, and which steps changed it."""
    raw = F.col("raw")
    value = F.regexp_replace(F.regexp_replace(F.upper(F.replace(F.replace(raw, F.lit(" "), F.lit("")), F.lit("×"), F.lit("X"))), "[,;:]+$", ""), '"$', "")
    steps = F.array_compact(F.array(F.when(raw != F.upper(raw), F.lit("upper")), F.when(raw.contains(" "), F.lit("spaces")), F.when(raw.contains("×"), F.lit("times")), F.when(raw.rlike("[,;:]+$"), F.lit("separators")), F.when(raw.rlike('"$'), F.lit("inch"))))
    spelled = labelled_parts(spark, sf_dir).select("p_partkey", F.expr(_SPELLED.replace("''", "\\'")).alias("raw"))
    return spelled.select("p_partkey", value.alias("value"), F.array_join(steps, "+").alias("steps"))
