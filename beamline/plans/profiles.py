"""Feature rows of tokens, pairs, pages and nodes, and the scores and gates computed of them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.labels import family_of, grams, normalised
from ..operators import layout as g
from ..operators.patterns import COVERAGE, ENOUGH, MOST, READABILITY, SPECIFICITY, SUPPORT, specificity
from ..registry import query
from ..sources.tables import PARTS_SQL, PREDICTIONS_SQL, catalog, labelled_parts, predictions, table
from .catalog import _NORM
from .layout import _BOXES, _PAIRS, _boxes, _pairs
from .readings import _CALLOUT, _found, _found_sql


def _n():
    return F.count(F.lit(1)).alias("n")


@query(
    "token_profile",
    f"""WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_CALLOUT} AS raw FROM parts), t AS (SELECT *, replace(upper(raw), ' ', '') AS n FROM s)
SELECT p_partkey, raw, n AS normalized_token, coalesce(nullif(regexp_extract(n, '[A-Z]+'), ''), 'NONE') AS prefix, coalesce(nullif(regexp_extract(n, '[A-Z]+$'), ''), 'NONE') AS suffix, length(n) AS token_length, length(regexp_replace(n, '[^A-Z]', '', 'g')) AS alpha_count,
  length(regexp_replace(n, '[^0-9]', '', 'g')) AS digit_count, length(regexp_replace(n, '[A-Z0-9]', '', 'g')) AS special_char_count, length(n) - length(replace(n, 'X', '')) AS x_count, regexp_matches(n, '[0-9]+/[0-9]+') AS contains_fraction, regexp_matches(n, '[0-9]+[.][0-9]+') AS contains_decimal,
  contains(n, '-') AS contains_dash, contains(n, '/') AS contains_slash, contains(raw, ' ') AS contains_space, regexp_matches(n, '^[A-Z]') AS starts_with_letter, regexp_matches(n, '^[0-9]') AS starts_with_digit, regexp_matches(n, '[0-9]$') AS ends_with_digit, regexp_matches(n, '[A-Z]$') AS ends_with_letter,
  len(regexp_extract_all(n, '[0-9]+')) AS numeric_groups, len(regexp_extract_all(n, '[A-Z]+')) AS alphabetic_groups, regexp_extract(n, '^(WT|HP|MC|W|M|C)', 1) AS shape_family, regexp_replace(regexp_replace(n, '[A-Z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS regex_signature FROM t""",
)
def token_profile(spark, sf_dir):
    """Lengths, counts, flags, first and last letters, family and signature of a token."""
    t = labelled_parts(spark, sf_dir).select("p_partkey", F.expr(_CALLOUT).alias("raw")).withColumn("n", normalised(F.col("raw")))
    n, raw = F.col("n"), F.col("raw")
    count = lambda drop: F.length(F.regexp_replace(n, drop, "")).cast("long")
    letters = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(n, pattern, 0), F.lit("")), F.lit("NONE"))
    groups = lambda pattern: F.size(F.regexp_extract_all(n, F.lit(pattern), F.lit(0))).cast("long")
    flags = {"contains_fraction": "[0-9]+/[0-9]+", "contains_decimal": "[0-9]+[.][0-9]+", "contains_dash": "-", "contains_slash": "/", "starts_with_letter": "^[A-Z]", "starts_with_digit": "^[0-9]", "ends_with_digit": "[0-9]$", "ends_with_letter": "[A-Z]$"}
    return t.select(
        "p_partkey", "raw", n.alias("normalized_token"), letters("[A-Z]+").alias("prefix"), letters("[A-Z]+$").alias("suffix"), F.length(n).cast("long").alias("token_length"),
        count("[^A-Z]").alias("alpha_count"), count("[^0-9]").alias("digit_count"), count("[A-Z0-9]").alias("special_char_count"), count("[^X]").alias("x_count"), raw.contains(" ").alias("contains_space"),
        *[n.rlike(pattern).alias(name) for name, pattern in flags.items()],
        groups("[0-9]+").alias("numeric_groups"), groups("[A-Z]+").alias("alphabetic_groups"), family_of(n).alias("shape_family"), F.regexp_replace(F.regexp_replace(n, "[A-Z]+", "A"), "[0-9]+", "9").alias("regex_signature"),
    )


def _grams_sql(text: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(2, length({text}) - {n - 2})), lambda i: substr({text}, CAST(i AS BIGINT), {n})))"


def _jaccard_sql(n: int) -> str:
    a, b = _grams_sql("a", n), _grams_sql("b", n)
    return f"round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE, 6)"


_AGREE = "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: {}))"
_READ = "TRY_CAST(regexp_extract({}, '^(?:WT|HP|MC|W|M|C)([0-9]+)X([0-9]*)$', {}) AS BIGINT)"


@query(
    "pair_vector",
    f"""WITH {PARTS_SQL}, f AS (SELECT family, count(*) AS members FROM catalog GROUP BY family), p AS (SELECT p.p_partkey, {_NORM} AS a, c.label AS b, c.family, c.depth, c.weight FROM printed p JOIN parts c ON c.p_partkey = p.p_partkey + 1 - 2 * (p.p_partkey % 2)),
d AS (SELECT *, {_READ.format("a", 1)} AS d0, {_READ.format("a", 2)} AS d1, regexp_extract(a, '^(WT|HP|MC|W|M|C)', 1) AS fam, levenshtein(a, b) AS e, greatest(length(a), length(b), 1)::DOUBLE AS longest FROM p)
SELECT p_partkey, b AS candidate, length(a) AS query_len, length(b) AS candidate_len, abs(length(a) - length(b)) AS len_diff_abs, e AS edit_distance, round(e / longest, 6) AS edit_distance_norm, {_jaccard_sql(2)} AS bigram_jaccard, {_jaccard_sql(3)} AS trigram_jaccard,
  {_AGREE.format("substr(a, 1, CAST(i AS BIGINT)) = substr(b, 1, CAST(i AS BIGINT))")} AS common_prefix_len, {_AGREE.format("right(a, CAST(i AS BIGINT)) = right(b, CAST(i AS BIGINT))")} AS common_suffix_len, {_AGREE.format("substr(a, CAST(i AS BIGINT), 1) = substr(b, CAST(i AS BIGINT), 1)")} AS positional_match_count,
  round({_AGREE.format("substr(a, CAST(i AS BIGINT), 1) = substr(b, CAST(i AS BIGINT), 1)")} / longest, 6) AS positional_match_ratio, fam <> '' AND starts_with(b, fam) AS family_match, fam <> '' AS query_family_known,
  CAST(coalesce(d0 = depth, FALSE) AS INTEGER) + CAST(coalesce(d1 = weight, FALSE) AS INTEGER) AS known_fields_matched, CAST(coalesce(d0 <> depth, FALSE) AS INTEGER) + CAST(coalesce(d1 <> weight, FALSE) AS INTEGER) AS known_fields_violated,
  round(abs(d0 - depth) / greatest(d0, depth, 1)::DOUBLE, 6) AS field0_diff_norm, round(abs(d1 - weight) / greatest(d1, weight, 1)::DOUBLE, 6) AS field1_diff_norm, round(ln(1 + members), 6) AS candidate_family_size_log1p FROM d JOIN f USING (family)""",
)
def pair_vector(spark, sf_dir):
    """The features of a print and a candidate label that a ranker learns from."""
    parts, c = labelled_parts(spark, sf_dir), F.col
    family = catalog(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("members"))  # six rows
    other = parts.select(c("p_partkey").alias("other"), c("label").alias("b"), "family", "depth", "weight").join(F.broadcast(family), "family")
    asked = parts.select("p_partkey", normalised(c("printed")).alias("a"), (c("p_partkey") + 1 - 2 * (c("p_partkey") % 2)).alias("other"))
    a, b = c("a"), c("b")
    read = lambda k: F.nullif(F.regexp_extract(a, "^(?:WT|HP|MC|W|M|C)([0-9]+)X([0-9]*)$", k), F.lit("")).cast("long")
    d = asked.join(other, "other").withColumns({"d0": read(1), "d1": read(2), "fam": family_of(a), "e": F.levenshtein(a, b), "longest": F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")})
    jaccard = lambda n: F.round(F.size(F.array_intersect(grams(a, n), grams(b, n))) / F.size(F.array_union(grams(a, n), grams(b, n))), 6)
    agree = lambda held: F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), held)).cast("long")
    same = agree(lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    one = lambda held: F.coalesce(held, F.lit(False)).cast("int")
    apart = lambda x, y: F.round(F.abs(c(x) - c(y)) / F.greatest(c(x), c(y), F.lit(1)), 6)
    return d.select(
        "p_partkey", b.alias("candidate"), F.length(a).cast("long").alias("query_len"), F.length(b).cast("long").alias("candidate_len"), F.abs(F.length(a) - F.length(b)).cast("long").alias("len_diff_abs"), c("e").cast("long").alias("edit_distance"), F.round(c("e") / c("longest"), 6).alias("edit_distance_norm"),
        jaccard(2).alias("bigram_jaccard"), jaccard(3).alias("trigram_jaccard"), agree(lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)).alias("common_prefix_len"), agree(lambda i: F.right(a, i) == F.right(b, i)).alias("common_suffix_len"), same.alias("positional_match_count"), F.round(same / c("longest"), 6).alias("positional_match_ratio"),
        ((c("fam") != "") & F.startswith(b, c("fam"))).alias("family_match"), (c("fam") != "").alias("query_family_known"), (one(c("d0") == c("depth")) + one(c("d1") == c("weight"))).alias("known_fields_matched"), (one(c("d0") != c("depth")) + one(c("d1") != c("weight"))).alias("known_fields_violated"),
        apart("d0", "depth").alias("field0_diff_norm"), apart("d1", "weight").alias("field1_diff_norm"), F.round(F.log1p("members"), 6).alias("candidate_family_size_log1p"),
    )


_STRUCTURAL = "(x0 <= x1_b AND x0_b <= x1 AND y0 <= y1_b AND y0_b <= y1) OR d2 <= 900"


@query(
    "graph_lookup",
    f"""WITH {_PAIRS}, e AS (SELECT page, box, count(*) AS degree, count(*) FILTER ({_STRUCTURAL}) AS links, min(d2) AS near FROM pairs GROUP BY page, box)
SELECT b.page, b.box, coalesce(degree, 0) AS degree, coalesce(links, 0) AS structural_links, round(coalesce(sqrt(near) / 2, 999), 6) AS min_distance, round(least(1.0::DOUBLE, 0.35::DOUBLE + 0.09::DOUBLE * coalesce(links, 0)), 4) AS consistency, degree IS NOT NULL AS graph_available FROM b LEFT JOIN e ON e.page = b.page AND e.box = b.box""",
)
def graph_lookup(spark, sf_dir):
    """Degree, structural links, nearest distance and consistency of every box; defaults where the graph has none."""
    e = _pairs(spark, sf_dir).groupBy("page", *g.CELLS, "box").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.expr(_STRUCTURAL), 1)).alias("links"), F.min("d2").alias("near"))
    rows, zero = _boxes(spark, sf_dir).select("page", "box").join(e.drop(*g.CELLS), ["page", "box"], "left"), F.lit(0).cast("long")
    consistency = F.least(F.lit(1.0), 0.35 + 0.09 * F.coalesce("links", zero))
    return rows.select("page", "box", F.coalesce("k", zero).alias("degree"), F.coalesce("links", zero).alias("structural_links"), F.round(F.coalesce(F.sqrt("near") / 2, F.lit(999.0)), 6).alias("min_distance"), F.round(consistency, 4).alias("consistency"), F.col("k").isNotNull().alias("graph_available"))


_FLAT, _FLAT_B = "x1 - x0 >= y1 - y0", "x1_b - x0_b >= y1_b - y0_b"
_MEETS = "(x0 <= x1_b AND x0_b <= x1 AND y0 <= y1_b AND y0_b <= y1)"
_CLOSE = "(x0 - 2 <= x1_b AND x0_b <= x1 + 2 AND y0 - 2 <= y1_b AND y0_b <= y1 + 2)"
_ALL_RELATIONS = {
    "contains": "x0 <= x0_b AND y0 <= y0_b AND x1 >= x1_b AND y1 >= y1_b", "intersects": _MEETS, "touches": f"{_CLOSE} AND NOT {_MEETS}", "left_of": "x1 < x0_b", "right_of": "x0 > x1_b", "above": "y1 < y0_b", "below": "y0 > y1_b",
    "parallel": f"({_FLAT}) = ({_FLAT_B})", "perpendicular": f"({_FLAT}) <> ({_FLAT_B})", "supports": f"{_CLOSE} AND ({_FLAT_B}) AND NOT ({_FLAT}) AND y0 >= y0_b",
}


@query("full_relations", f"WITH {_PAIRS} SELECT page, box, box_b, array_to_string({_found_sql(_ALL_RELATIONS)}, ',') AS relations FROM pairs WHERE box < box_b")
def full_relations(spark, sf_dir):
    """All relations that hold between two near boxes."""
    found = _found({k: F.expr(v) for k, v in _ALL_RELATIONS.items()})
    return _pairs(spark, sf_dir).filter("box < box_b").select("page", "box", "box_b", F.array_join(found, ",").alias("relations"))


@query(
    "page_islands",
    f"""WITH {_BOXES}, w AS (SELECT page, greatest(160, 0.24::DOUBLE * (max(x1) - min(x0))) AS gap FROM b GROUP BY page), s AS (SELECT b.*, CASE WHEN cx - lag(cx) OVER (PARTITION BY b.page ORDER BY cx, box) > gap THEN 1 ELSE 0 END AS brk FROM b JOIN w ON w.page = b.page),
i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY page ORDER BY cx, box ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s) SELECT page, island, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM i GROUP BY page, island""",
)
def page_islands(spark, sf_dir):
    """Regions of a page by gaps of 80 points or 12 % of its width, whichever is more."""
    b = _boxes(spark, sf_dir)
    width = b.groupBy("page").agg(F.greatest(F.lit(160.0), 0.24 * (F.max("x1") - F.min("x0"))).alias("gap"))
    w = W.partitionBy("page").orderBy("cx", "box")
    rows = g.islands(b.join(width, "page"), ["page"], [F.col("cx"), F.col("box")], F.col("cx") - F.lag("cx").over(w) > F.col("gap"))
    return rows.groupBy("page", "island").agg(_n(), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


_SPOT = "CAST(1 + (part * 31 + {turn}) % greatest(1, length({x})) AS INT)"
_DAMAGE = {
    "char_deletion": "substr({x}, 1, {s} - 1) || substr({x}, {s} + 1)", "char_insertion": "substr({x}, 1, {s}) || substr('0123456789', 1 + CAST(part % 10 AS INT), 1) || substr({x}, {s} + 1)", "unknown_char": "substr({x}, 1, {s} - 1) || '?' || substr({x}, {s} + 1)",
    "ocr_substitution": "translate({x}, '015', 'OIS')", "separator": "replace({x}, 'X', ' x ')", "added_noise": "'(' || {x} || ')'", "missing_prefix": "regexp_replace({x}, '^[A-Z]+', '')",
}


def _damaged(turn: int, x: str) -> dict[str, str]:
    return {k: v.format(x=x, s=_SPOT.format(turn=turn, x=x)) for k, v in _DAMAGE.items()}


def _chosen(turn: int, x: str) -> str:
    return f"CASE (part + {turn}) % 7 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_damaged(turn, x).values())) + " END"


@query(
    "corruption_chains",
    f"""WITH {PARTS_SQL}, one AS (SELECT label, part, unnest([{", ".join(f"'{k}'" for k in _DAMAGE)}]) AS kind, unnest([{", ".join(_damaged(0, "label").values())}]) AS first FROM catalog), two AS (SELECT *, {_chosen(1, "first")} AS second FROM one)
SELECT label, kind, first, second, {_chosen(3, "second")} AS third FROM two""",
)
def corruption_chains(spark, sf_dir):
    """Seven kinds of damage to each label, and chains of two and three; the part's key decides place and order."""
    one = catalog(spark, sf_dir).select("label", "part", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(v).alias("first")) for k, v in _damaged(0, "label").items()])).alias("d")).select("label", "part", "d.*")
    two = one.withColumn("second", F.expr(_chosen(1, "first")))
    return two.select("label", "kind", "first", "second", F.expr(_chosen(3, "second")).alias("third"))


@query(
    "promotion_f1",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT page % 10 AS model, page % 2 AS candidate, l_partkey % 3 = 0 AS actual, confidence >= 0.5 + 0.01 * (page % 2) AS predicted FROM predictions), k AS (SELECT model, count(*) AS n, count(*) FILTER (actual = predicted) AS hits, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (actual <> predicted) AS bad FROM r GROUP BY model),
m AS (SELECT model // 2 AS pair, model % 2 AS candidate, hits / n AS accuracy, 2 * tp / nullif(2 * tp + bad, 0) AS f1 FROM k)
SELECT a.pair, round(a.accuracy, 6) AS active_accuracy, round(c.accuracy, 6) AS accuracy, round(a.f1, 6) AS active_f1, round(c.f1, 6) AS f1, c.accuracy + 0.02 >= a.accuracy AND c.f1 + 0.02 >= a.f1 AS promoted FROM m a JOIN m c ON a.pair = c.pair AND a.candidate = 0 AND c.candidate = 1""",
)
def promotion_f1(spark, sf_dir):
    """A candidate replaces the active model unless accuracy or F1 falls by more than 0.02."""
    c = F.col
    r = predictions(spark, sf_dir).select((c("page") % 10).alias("model"), (c("l_partkey") % 3 == 0).alias("actual"), (c("confidence") >= 0.5 + 0.01 * (c("page") % 2)).alias("predicted"))
    count = lambda held: F.count(F.when(held, 1))
    k = r.groupBy("model").agg(_n(), count(c("actual") == c("predicted")).alias("hits"), count(c("actual") & c("predicted")).alias("tp"), count(c("actual") != c("predicted")).alias("bad"))
    m = k.select(F.floor(c("model") / 2).alias("pair"), (c("model") % 2).alias("candidate"), (c("hits") / c("n")).alias("accuracy"), F.try_divide(2 * c("tp"), 2 * c("tp") + c("bad")).alias("f1"))
    active = m.filter("candidate = 0").select("pair", c("accuracy").alias("aa"), c("f1").alias("af"))
    both = active.join(m.filter("candidate = 1"), "pair")
    rounded = lambda x, name: F.round(x, 6).alias(name)
    return both.select("pair", rounded(c("aa"), "active_accuracy"), rounded(c("accuracy"), "accuracy"), rounded(c("af"), "active_f1"), rounded(c("f1"), "f1"), ((c("accuracy") + 0.02 >= c("aa")) & (c("f1") + 0.02 >= c("af"))).alias("promoted"))


@query(
    "page_scales",
    f"""WITH {PREDICTIONS_SQL}, t AS (SELECT page, 100 + l_partkey % 3 AS ratio, CASE source WHEN 'FUSION' THEN 3 WHEN 'CORRECTION' THEN 2 ELSE 1 END AS trust, l_partkey % 50 = 1 AND page % 3 <> 0 AS printed, l_partkey % 40 = 2 AS nts FROM predictions),
k AS (SELECT page, max(CASE WHEN printed THEN trust * 1000 - ratio END) AS best, bool_or(nts) AS nts FROM t GROUP BY page)
SELECT page, CASE WHEN best IS NOT NULL THEN 1000 * ((best + 999) // 1000) - best END AS scale, nts, CASE WHEN best IS NOT NULL THEN 'page_scale' WHEN nts THEN 'nts' ELSE 'unknown' END AS reason FROM k""",
)
def page_scales(spark, sf_dir):
    """The scale that a page itself prints, from its most trusted source; never another page's, and none for pages not to scale."""
    c = F.col
    trust = F.when(c("source") == "FUSION", 3).when(c("source") == "CORRECTION", 2).otherwise(1)
    printed = (c("l_partkey") % 50 == 1) & (c("page") % 3 != 0)
    ratio = 100 + c("l_partkey") % 3
    k = predictions(spark, sf_dir).groupBy("page").agg(F.max(F.when(printed, F.struct(trust.alias("trust"), (-ratio).alias("less")))).alias("best"), F.bool_or(c("l_partkey") % 40 == 2).alias("nts"))
    return k.select("page", (-c("best.less")).alias("scale"), "nts", F.when(c("best").isNotNull(), "page_scale").when(c("nts"), "nts").otherwise("unknown").alias("reason"))


#: What makes a page a legend, and by how much.
_LEGEND = {"abbreviation": 3.0, "legend": 3.0, "general notes": 2.5, "see ": 0.5, "typ": 1.0}


@query(
    "legend_scores",
    f"""WITH s AS (SELECT doc_id, {" + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {v}::DOUBLE ELSE 0 END" for k, v in _LEGEND.items())} + CASE WHEN len(regexp_extract_all(text, '[A-Z]+ = [A-Z]')) >= 2 THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN contains(lower(text), 'plan') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN doc_id <= 3 THEN 0.5::DOUBLE ELSE 0 END AS score FROM documents)
SELECT doc_id, greatest(0, score) AS score, score >= 1 AS legend FROM s""",
)
def legend_scores(spark, sf_dir):
    """The weight of the words that make a page a legend, less those of a plan, never under 0."""
    text = F.lower("text")
    score = sum((F.when(text.contains(k), v).otherwise(0.0) for k, v in _LEGEND.items()), F.lit(0.0))
    pairs = F.size(F.regexp_extract_all("text", F.lit("[A-Z]+ = [A-Z]"), F.lit(0))) >= 2
    score = score + F.when(pairs, 1.5).otherwise(0.0) - F.when(text.contains("plan"), 3.0).otherwise(0.0) + F.when(F.col("doc_id") <= 3, 0.5).otherwise(0.0)
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(0.0), score).alias("score"), (score >= 1).alias("legend"))


#: The weights of the evidence, over those at hand.
_EVIDENCE = {"text": ("confidence", 0.38), "similarity": ("CASE WHEN section IS NOT NULL THEN quantity / 50.0{d} END", 0.22), "geometry": ("CASE WHEN source = 'GEOMETRY' THEN 0.8{d} END", 0.15), "graph": ("CASE WHEN page % 3 <> 0 THEN 0.35{d} + 0.09{d} * (page % 4) END", 0.12), "context": ("CASE WHEN eligible THEN 1.0{d} END", 0.08), "history": ("CASE WHEN source = 'CORRECTION' THEN 1.0{d} END", 0.05)}


def _evidence(d: str) -> str:
    total = " + ".join(f"coalesce({v.format(d=d)} * {w}{d}, 0.0{d})" for v, w in _EVIDENCE.values())
    weight = " + ".join(f"CASE WHEN {v.format(d=d)} IS NOT NULL THEN {w}{d} ELSE 0.0{d} END" for v, w in _EVIDENCE.values())
    return f"({total}) / ({weight})"


@query("weighted_evidence", f"WITH {PREDICTIONS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round({_evidence('::DOUBLE')}, 6) AS score FROM predictions")
def weighted_evidence(spark, sf_dir):
    """Six kinds of evidence by weight, over the weights of those at hand."""
    return predictions(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.expr(_evidence("D")), 6).alias("score"))


_SHAPES = {"W[0-9]+X[0-9]+": 0.90, "[A-Z]+[0-9]+X[0-9]+": 0.75, "[A-Z]+.*": 0.60}


_SPECIFIC_SQL = """greatest(0, least(1, 0.6::DOUBLE + 0.05::DOUBLE * least(len(regexp_extract_all(pattern, '[[:alnum:]]')), 8) - if(instr(pattern, '.*') + instr(pattern, '.+') > 0, 0.4::DOUBLE, 0::DOUBLE)
  - if(instr(pattern, '[A-Z]+') > 0 AND len(regexp_extract_all(pattern, '[[:alnum:]]')) <= 1, 0.15::DOUBLE, 0::DOUBLE)))"""


@query(
    "fullmatch_coverage",
    f"""WITH {PARTS_SQL}, t AS ({" UNION ALL ".join(f"SELECT family, '{p}' AS pattern, {r}::DOUBLE AS readable, count(*) AS total, count(*) FILTER (regexp_full_match({_NORM}, '{p}')) AS matched FROM printed GROUP BY family" for p, r in _SHAPES.items())}),
s AS (SELECT *, round({_SPECIFIC_SQL}, 6) AS specificity FROM t)
SELECT family, pattern, total, matched, round(matched / total, 6) AS coverage, specificity, round(greatest(0, least(0.97::DOUBLE, 0.5::DOUBLE * matched / total + 0.2::DOUBLE * specificity + 0.2::DOUBLE * readable + 0.1::DOUBLE * least(1.0::DOUBLE, total / 8))), 6) AS confidence FROM s""",
)
def fullmatch_coverage(spark, sf_dir):
    """How much of each family's prints a pattern fits whole, how specific it is, and the confidence of both, its readability and support."""
    norm, c = normalised(F.col("printed")), F.col
    tried = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.round(specificity(F.lit(p)), 6).alias("specificity"), F.lit(r).alias("readable"), norm.rlike(f"^(?:{p})$").alias("fits")) for p, r in _SHAPES.items()]))
    k = labelled_parts(spark, sf_dir).select("family", tried.alias("t")).select("family", "t.*").groupBy("family", "pattern", "specificity", "readable").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(c("fits"), 1)).alias("matched"))
    score = COVERAGE * c("matched") / c("total") + SPECIFICITY * c("specificity") + READABILITY * c("readable") + SUPPORT * F.least(F.lit(1.0), c("total") / ENOUGH)
    return k.select("family", "pattern", "total", "matched", F.round(c("matched") / c("total"), 6).alias("coverage"), "specificity", F.round(F.greatest(F.lit(0.0), F.least(F.lit(MOST), score)), 6).alias("confidence"))
