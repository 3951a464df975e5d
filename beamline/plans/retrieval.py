"""Retrieval of sections by an index of spellings: of the catalog, of pairs, of reviews and of corrections, without what is held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import LIKE_DIGITS, normalised
from ..operators import retrieval
from ..registry import query
from ..sources.scratch import written
from ..sources.tables import PARTS_SQL, catalog, labelled_parts

#: Labels whose prints are held out: no pair, review or correction of them is learned, nor any token spelled alike.
_HELD_SQL = "CAST('0x' || substr(sha256(label), 1, 4) AS BIGINT) % 5 = 0"
_NORM_SQL = "upper(replace({}, ' ', ''))"

_ANCHORS = f"""{PARTS_SQL}, held AS (SELECT DISTINCT {_NORM_SQL.format("printed")} AS norm FROM printed WHERE {_HELD_SQL}),
sources AS (SELECT 0 AS priority, 'catalog' AS source, trim(unnest([label, translate(label, '0', 'O'), translate(label, '1', 'I'), replace(label, 'X', ' X '), lower(label)])) AS token, label AS target FROM catalog
  UNION ALL SELECT 1, 'pair', trim(printed), label FROM printed WHERE {_NORM_SQL.format("printed")} = label AND NOT {_HELD_SQL}
  UNION ALL SELECT CASE p_partkey % 7 WHEN 5 THEN 3 ELSE 2 END, CASE p_partkey % 7 WHEN 5 THEN 'correction' ELSE 'approved' END, trim(printed), label FROM printed
    WHERE {_NORM_SQL.format("printed")} NOT IN (SELECT norm FROM held)),
anchors AS (SELECT upper(token) || '|' || target AS anchor, arg_min(token, (priority, token)) AS token, target, arg_min(source, (priority, token)) AS source FROM sources WHERE token <> '' GROUP BY upper(token), target)"""
_GRAMS = "SELECT {key}, unnest(flatten(list_transform(range({a}, {b}), lambda n: list_transform(range(1, length({text}) - n + 2), lambda i: {text}[i:i + n - 1])))) AS gram FROM {rows}"
_COUNTED = lambda key, text, rows: f"SELECT {key}, gram, count(*) AS n FROM ({_GRAMS.format(key=key, text=text, rows=rows, a=retrieval.SHORTEST, b=retrieval.LONGEST + 1)}) GROUP BY ALL"
_INDEX = f"""{_ANCHORS}, counted AS ({_COUNTED("anchor", "token", "anchors")}), idf AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM anchors)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM counted GROUP BY gram),
postings AS (SELECT anchor, gram, w / sqrt(sum(w * w) OVER (PARTITION BY anchor)) AS weight FROM (SELECT anchor, gram, (1 + ln(n)) * idf AS w FROM counted JOIN idf USING (gram)))"""


def _anchors(spark, sf_dir):
    parts, labels = labelled_parts(spark, sf_dir), catalog(spark, sf_dir)
    held = F.conv(F.substring(F.sha2("label", 256), 1, 4), 16, 10).cast("long") % 5 == 0
    prints = parts.select("p_partkey", "printed", "label", normalised(F.col("printed")).alias("norm"), held.alias("held"))
    label = F.col("label")
    zero, one = LIKE_DIGITS[0][0], LIKE_DIGITS[0][1]
    spelled = F.explode(F.array(label, F.translate(label, "0", zero), F.translate(label, "1", one), F.replace(label, F.lit("X"), F.lit(" X ")), F.lower(label)))
    reviewed = prints.join(prints.filter("held").select("norm").distinct(), "norm", "left_anti")
    named = lambda rows: rows.select(F.col("printed").alias("token"), F.col("label").alias("target"))
    sources = [
        ("catalog", labels.select(spelled.alias("token"), label.alias("target"))),
        ("pair", named(prints.filter((F.col("norm") == label) & ~F.col("held")))),
        ("approved", named(reviewed.filter("p_partkey % 7 <> 5"))),
        ("correction", named(reviewed.filter("p_partkey % 7 = 5"))),
    ]
    return retrieval.first_source(sources)


@query("retrieval_anchors", f"WITH {_ANCHORS} SELECT token, target, source FROM anchors")
def retrieval_anchors(spark, sf_dir):
    """What the index learns from: the first source of each spelling of a section, without what is held out."""
    return _anchors(spark, sf_dir).select("token", "target", "source")


@query("retrieval_index", f"WITH {_INDEX} SELECT gram, any_value(df) AS df, round(any_value(idf), 6) AS idf, round(max(weight), 6) AS top, round(sum(weight), 6) AS whole FROM postings JOIN idf USING (gram) GROUP BY gram")
def retrieval_index(spark, sf_dir):
    """The lists of the index: their anchors, idf, greatest weight and sum."""
    index = retrieval.build(_anchors(spark, sf_dir))
    whole = index.postings.groupBy("gram").agg(F.round(F.sum("weight"), 6).alias("whole"))
    return index.grams.join(whole, "gram").select("gram", "df", F.round("idf", 6).alias("idf"), F.round("top", 6).alias("top"), "whole")


@query(
    "retrieval_pool",
    f"""WITH {_INDEX}, t AS (SELECT DISTINCT {_NORM_SQL.format("printed")} AS norm FROM printed WHERE printed IS NOT NULL),
q AS (SELECT norm, gram, w / sqrt(sum(w * w) OVER (PARTITION BY norm)) AS weight FROM (SELECT norm, gram, (1 + ln(n)) * idf AS w FROM ({_COUNTED("norm", "norm", "t")}) JOIN idf USING (gram))),
s AS (SELECT norm, anchor, round(sum(q.weight * p.weight), 9) AS score FROM q JOIN postings p USING (gram) GROUP BY ALL),
pool AS (SELECT norm, target, score FROM s JOIN anchors USING (anchor) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY score DESC, anchor) <= {retrieval.POOL}),
best AS (SELECT norm, target AS section, max(score) AS score FROM (SELECT * FROM pool UNION ALL SELECT DISTINCT norm, norm, 1.0::DOUBLE FROM pool WHERE norm IN (SELECT target FROM anchors)) GROUP BY ALL)
SELECT norm, section, score FROM best""",
)
def retrieval_pool(spark, sf_dir):
    """The sections of each distinct print: of its 80 most similar spellings, the best of each section; a section as it is scores 1."""
    index = retrieval.build(_anchors(spark, sf_dir))
    tokens = labelled_parts(spark, sf_dir).select(normalised(F.col("printed")).alias("norm"))
    best = retrieval.best_targets(index, written(retrieval.search(index, tokens), "pool"))
    return best.select("norm", "section", "score")
