"""Printed tokens against the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import normalised, parsed
from ..operators import candidates as c
from ..registry import query
from ..sources.tables import PARTS_SQL, catalog, labelled_parts

_NORM = "upper(replace(printed, ' ', ''))"
_GRAMMAR = "'^(WT|HP|MC|W|M|C)([0-9]+)X([0-9]+)$'"


def _printed(spark, sf_dir):
    return labelled_parts(spark, sf_dir).select("p_partkey", "printed")


@query(
    "designation_parse",
    f"WITH {PARTS_SQL} SELECT p_partkey, {_NORM} AS norm, nullif(regexp_extract({_NORM}, {_GRAMMAR}, 1), '') AS family, TRY_CAST(regexp_extract({_NORM}, {_GRAMMAR}, 2) AS BIGINT) AS depth, TRY_CAST(regexp_extract({_NORM}, {_GRAMMAR}, 3) AS BIGINT) AS weight FROM printed",
)
def designation_parse(spark, sf_dir):
    norm = normalised(F.col("printed"))
    return _printed(spark, sf_dir).select("p_partkey", norm.alias("norm"), *[v.alias(k) for k, v in parsed(norm).items()])


@query("catalog_exact", f"WITH {PARTS_SQL} SELECT p_partkey, printed, c.label AS section FROM printed p LEFT JOIN catalog c ON c.label = {_NORM}")
def catalog_exact(spark, sf_dir):
    return c.exact(_printed(spark, sf_dir), catalog(spark, sf_dir))


@query(
    "wildcard_mask",
    f"""WITH {PARTS_SQL}, m AS (SELECT p_partkey, {_NORM} AS norm FROM printed), j AS (SELECT m.p_partkey, m.norm, c.label, CAST(row_number() OVER (PARTITION BY m.p_partkey ORDER BY c.label) AS INTEGER) AS place
  FROM m JOIN catalog c ON c.family = regexp_extract(m.norm, '^(WT|HP|MC|W|M|C)', 1) AND length(c.label) = length(m.norm) AND c.label LIKE replace(m.norm, '*', '_') WHERE m.norm LIKE '%*%') SELECT * FROM j WHERE place <= 8""",
)
def wildcard_mask(spark, sf_dir):
    return c.wildcard(_printed(spark, sf_dir), catalog(spark, sf_dir))


@query("ocr_flex", f"WITH {PARTS_SQL} SELECT p_partkey, printed, c.label FROM printed p JOIN catalog c ON translate(c.label, 'OIL', '011') = translate({_NORM}, 'OIL', '011')")
def ocr_flex(spark, sf_dir):
    return c.like_print(_printed(spark, sf_dir), catalog(spark, sf_dir))


_COMPLETION = f"""cut AS (SELECT p_partkey, regexp_extract({_NORM}, '^(WT|HP|MC|W|M|C)([0-9]+)X([0-9]*)$', 1) AS family, TRY_CAST(regexp_extract({_NORM}, '^(WT|HP|MC|W|M|C)([0-9]+)X([0-9]*)$', 2) AS BIGINT) AS depth,
  regexp_extract({_NORM}, '^(WT|HP|MC|W|M|C)([0-9]+)X([0-9]*)$', 3) AS rest FROM printed),
completed AS (SELECT cut.p_partkey, c.label, CAST(row_number() OVER (PARTITION BY cut.p_partkey ORDER BY c.weight, c.label) AS INTEGER) AS place FROM cut JOIN catalog c ON c.family = cut.family AND c.depth = cut.depth AND starts_with(CAST(c.weight AS VARCHAR), cut.rest))"""


@query("completion", f"WITH {PARTS_SQL}, {_COMPLETION} SELECT * FROM completed WHERE place <= 10")
def completion(spark, sf_dir):
    return c.completion(_printed(spark, sf_dir), catalog(spark, sf_dir))


@query(
    "nearest_fields",
    f"""WITH {PARTS_SQL}, j AS (SELECT a.label, b.label AS near, 10 * abs(a.depth - b.depth) + abs(a.weight - b.weight) AS distance FROM catalog a JOIN catalog b ON a.family = b.family AND a.label <> b.label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY distance, near) AS INTEGER) AS place FROM j) SELECT * FROM r WHERE place <= 3""",
)
def nearest_fields(spark, sf_dir):
    return c.nearest_fields(catalog(spark, sf_dir))


_EDIT = f"""edits AS (SELECT p.p_partkey, c.label, CAST(levenshtein({_NORM}, c.label) AS INTEGER) AS distance FROM printed p JOIN catalog c ON abs(length({_NORM}) - length(c.label)) <= 2 AND levenshtein({_NORM}, c.label) <= 2),
edited AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY distance, label) AS INTEGER) AS place FROM edits)"""


@query("levenshtein_topk", f"WITH {PARTS_SQL}, {_EDIT} SELECT * FROM edited WHERE place <= 3")
def levenshtein_topk(spark, sf_dir):
    return c.edit_distance(_printed(spark, sf_dir), catalog(spark, sf_dir))


@query(
    "ngram_jaccard_topk",
    f"""WITH {PARTS_SQL}, p AS (SELECT p_partkey, {_NORM} AS t FROM printed), a AS (SELECT DISTINCT p_partkey, substr(t, CAST(i AS BIGINT), 3) AS gram FROM p, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS u(i)),
b AS (SELECT DISTINCT label, substr(label, CAST(i AS BIGINT), 3) AS gram FROM catalog, unnest(range(1, greatest(length(label) - 2, 1) + 1)) AS u(i)),
na AS (SELECT p_partkey, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT label, count(*) AS n FROM b GROUP BY 1),
x AS (SELECT a.p_partkey, b.label, count(*) AS c FROM a JOIN b ON a.gram = b.gram GROUP BY 1, 2),
s AS (SELECT x.p_partkey, x.label, round(x.c / (na.n + nb.n - x.c), 6) AS score FROM x JOIN na ON na.p_partkey = x.p_partkey JOIN nb ON nb.label = x.label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, label) AS INTEGER) AS place FROM s) SELECT * FROM r WHERE place <= 3""",
)
def ngram_jaccard_topk(spark, sf_dir):
    return c.gram_similarity(_printed(spark, sf_dir), catalog(spark, sf_dir))


_UNION = f"""{_COMPLETION}, {_EDIT},
every AS (SELECT p_partkey, c.label, 1 AS place, 'exact' AS strategy, 0 AS priority FROM printed p JOIN catalog c ON c.label = {_NORM}
  UNION ALL SELECT p_partkey, label, place, 'completion', 1 FROM completed WHERE place <= 10 UNION ALL SELECT p_partkey, label, place, 'edit', 2 FROM edited WHERE place <= 3),
once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY p_partkey, label ORDER BY priority, place) = 1),
united AS (SELECT p_partkey, label, strategy, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY priority, place, label) AS INTEGER) AS place FROM once)"""


def _union(spark, sf_dir):
    printed, labels = _printed(spark, sf_dir), catalog(spark, sf_dir)
    same = c.exact(printed, labels).filter("section is not null").select("p_partkey", F.col("section").alias("label"), F.lit(1).alias("place"))
    return c.union_by_priority([("exact", same), ("completion", c.completion(printed, labels)), ("edit", c.edit_distance(printed, labels))])


@query("candidate_union", f"WITH {PARTS_SQL}, {_UNION} SELECT * FROM united WHERE place <= 25")
def candidate_union(spark, sf_dir):
    return _union(spark, sf_dir)


@query(
    "rank_metrics",
    f"""WITH {PARTS_SQL}, {_UNION}, h AS (SELECT p.p_partkey, min(u.place) AS place FROM parts p LEFT JOIN united u ON u.p_partkey = p.p_partkey AND u.label = p.label AND u.place <= 25 GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN place <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN place <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr FROM h""",
)
def rank_metrics(spark, sf_dir):
    return c.rank_metrics(_union(spark, sf_dir), labelled_parts(spark, sf_dir).select("p_partkey", "label"))


@query("catalog_conflicts", f"WITH {PARTS_SQL} SELECT label, count(*) AS n, count(DISTINCT p_brand) AS brands, min(p_partkey) AS first, max(p_partkey) AS last FROM parts GROUP BY label HAVING count(*) > 1")
def catalog_conflicts(spark, sf_dir):
    return labelled_parts(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("brands"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last")).filter("n > 1")
