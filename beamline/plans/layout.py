"""Words, lines and boxes in order and in space."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import layout as g
from ..registry import query
from ..sources.tables import BOXES_SQL, PREDICTIONS_SQL, boxes, predictions, table

#: Of boxes that share id and page the least by its sides.
_ONE = "unique_boxes AS (SELECT * FROM boxes QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, page ORDER BY x0, y0, x1, y1) = 1)"
_BOXES = f"{BOXES_SQL}, {_ONE}, b AS (SELECT l_orderkey || '-' || l_partkey AS box, page, x0, y0, x1, y1, x0 + x1 AS cx, y0 + y1 AS cy FROM unique_boxes)"
_PAIRS = f"""{_BOXES}, pairs AS (SELECT a.*, b.box AS box_b, b.x0 AS x0_b, b.y0 AS y0_b, b.x1 AS x1_b, b.y1 AS y1_b, b.cx AS cx_b, b.cy AS cy_b, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d2
  FROM b a JOIN b ON a.page = b.page AND a.box <> b.box WHERE (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 4 * 30 * 30)"""
RADIUS = 30
#: Rows of a page, or of pages that share one of so many buckets, up to which one task takes it whole.
PAGE_ROWS, PAGE_BUCKETS = 500_000, 1 << 16


def _once(dealt):
    """Of rows that are dealt by id and page, or by page, one an id and page: the least by its sides."""
    first = F.row_number().over(W.partitionBy("page", "l_orderkey", "l_partkey").orderBy("x0", "y0", "x1", "y1"))
    return dealt.withColumn("nth", first).filter("nth = 1").drop("nth")


def _unique(spark, sf_dir, kept=None):
    """Boxes once an id and page, first in the one order that each task makes of its ids; kept tells the boxes that are wanted."""
    n = table(spark, sf_dir, "lineitem").count()
    rows = boxes(spark, sf_dir)
    return _once(g.dealt(rows if kept is None else rows.filter(kept), n, "l_orderkey", "l_partkey", "page"))


def _boxes(spark, sf_dir):
    return g.with_centres(_unique(spark, sf_dir))


def _paged(spark, sf_dir):
    """Boxes in one frame or two: those of pages that a task can hold, dealt by page in one exchange that also finds an id's boxes, and those of crowded pages, if any, dealt by id.

    A bucket of pages is counted, not a page, so that counts are few wherever a page's rows lie.
    """
    rows = boxes(spark, sf_dir)
    bucket = F.pmod(F.xxhash64("page"), F.lit(PAGE_BUCKETS))
    crowded = [r.bucket for r in rows.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > PAGE_ROWS).collect()]  # one for so many rows at most
    whole = lambda kept: _once(g.dealt(kept, table(spark, sf_dir, "lineitem").count(), "page"))
    if not crowded:
        return [g.with_centres(whole(rows))]
    return [g.with_centres(whole(rows.filter(~bucket.isin(crowded)))), g.with_centres(_unique(spark, sf_dir, bucket.isin(crowded)))]


def _each(frames, f):
    """f of each frame, as one: no page is in two of them."""
    return reduce(DataFrame.unionByName, [f(x) for x in frames])


def _pairs(spark, sf_dir, radius=RADIUS):
    """Near pairs; boxes meet by their keys and are named once they have met."""
    keys = F.struct("l_orderkey", "l_partkey")
    once = _unique(spark, sf_dir).select(keys.alias("box"), "page", "x0", "y0", (F.col("x0") + F.col("x1")).alias("cx"), (F.col("y0") + F.col("y1")).alias("cy"))
    name = lambda b: g.box_name(f"{b}.l_orderkey", f"{b}.l_partkey")
    return g.near_pairs(once, radius).withColumns({b: name(b) for b in ("box", "box_b")})


@query(
    "word_windows",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM documents), g AS (SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, unnest(range(1, len(ws) - 1)) AS u(i))
SELECT doc_id, count(*) AS windows, count(DISTINCT gram) AS distinct_windows FROM g GROUP BY doc_id""",
)
def word_windows(spark, sf_dir):
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws")).filter(F.size("ws") >= 3)
    windows = F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.array_join(F.slice("ws", i, F.lit(3)), " "))
    return rows.select("doc_id", windows.alias("g")).select("doc_id", F.size("g").cast("long").alias("windows"), F.size(F.array_distinct("g")).cast("long").alias("distinct_windows"))


@query(
    "line_neighbours",
    """WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, length(string_split(text, chr(10))[i]) AS n FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i))
SELECT doc_id, pos, n, lag(n) OVER w AS before, lead(n) OVER w AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
)
def line_neighbours(spark, sf_dir):
    w = W.partitionBy("doc_id").orderBy("pos")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("n", F.length("line").cast("long"))
    return lines.select("doc_id", "pos", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))


@query(
    "region_islands",
    f"""WITH {_BOXES}, s AS (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY page ORDER BY cx, box) > 50 THEN 1 ELSE 0 END AS brk FROM b), i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY page ORDER BY cx, box ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s)
SELECT page, island, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM i GROUP BY page, island""",
)
def region_islands(spark, sf_dir):
    w = W.partitionBy("page").orderBy("cx", "box")
    rows = g.islands(_boxes(spark, sf_dir), ["page"], [F.col("cx"), F.col("box")], F.col("cx") - F.lag("cx").over(w) > 50)
    return rows.groupBy("page", "island").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(
    "fragment_islands",
    """WITH s AS (SELECT conv_id, turn, role, CASE WHEN length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, length(text)) > 100 THEN 1 ELSE 0 END AS brk, length(text) AS n FROM conversations),
i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY conv_id ORDER BY turn, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s) SELECT conv_id, island, count(*) AS turns, CAST(sum(n) AS BIGINT) AS chars FROM i GROUP BY conv_id, island""",
)
def fragment_islands(spark, sf_dir):
    """Turns run on until one is over 100 characters longer than the one before."""
    w = W.partitionBy("conv_id").orderBy("turn", "n")
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    rows = g.islands(turns, ["conv_id"], [F.col("turn"), F.col("n")], F.col("n") - F.lag("n").over(w) > 100)
    return rows.groupBy("conv_id", "island").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("chars"))


@query("reading_order", f"WITH {_BOXES} SELECT page, box, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, box) AS INTEGER) AS place FROM b")
def reading_order(spark, sf_dir):
    return _boxes(spark, sf_dir).select("page", "box", F.row_number().over(W.partitionBy("page").orderBy("y0", "x0", "box")).alias("place"))


@query(
    "rank_near_tie",
    f"""WITH {PREDICTIONS_SQL}, k AS (SELECT section, max(confidence) AS best, page FROM predictions WHERE section IS NOT NULL GROUP BY page, section), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY best DESC, section) AS place, lead(best) OVER (PARTITION BY page ORDER BY best DESC, section) AS second FROM k)
SELECT page, section, best, second, best > 0 AND best - second < 0.04 AS near_tie FROM r WHERE place = 1""",
)
def rank_near_tie(spark, sf_dir):
    w = W.partitionBy("page").orderBy(F.desc("best"), "section")
    best = predictions(spark, sf_dir).filter("section is not null").groupBy("page", "section").agg(F.max("confidence").alias("best"))
    return best.select("page", "section", "best", F.lead("best").over(w).alias("second"), F.row_number().over(w).alias("place")).filter("place = 1").select("page", "section", "best", "second", ((F.col("best") > 0) & (F.col("best") - F.col("second") < 0.04)).alias("near_tie"))


@query("radius_pairs", f"WITH {_PAIRS} SELECT page, box, box_b, d2 FROM pairs WHERE box < box_b")
def radius_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).filter(F.col("box") < F.col("box_b")).select("page", "box", "box_b", "d2")


_WIDE = _PAIRS.replace("4 * 30 * 30", "4 * 120 * 120")


@query("knn_grid", f"WITH {_WIDE}, r AS (SELECT page, box, box_b, d2, CAST(row_number() OVER (PARTITION BY page, box ORDER BY d2, box_b) AS INTEGER) AS place FROM pairs) SELECT * FROM r WHERE place <= 5")
def knn_grid(spark, sf_dir):
    """The five nearest boxes within 120."""
    place = F.row_number().over(W.partitionBy("page", *g.CELLS, "box").orderBy("d2", "box_b"))
    return _pairs(spark, sf_dir, 120).select("page", "box", "box_b", "d2", place.alias("place")).filter("place <= 5")


_RELATION = """CASE WHEN x0 <= x0_b AND y0 <= y0_b AND x1 >= x1_b AND y1 >= y1_b THEN 'contains' WHEN x0 <= x1_b AND x0_b <= x1 AND y0 <= y1_b AND y0_b <= y1 THEN 'intersects'
  WHEN abs(cx_b - cx) >= abs(cy_b - cy) AND cx_b > cx THEN 'left_of' WHEN abs(cx_b - cx) >= abs(cy_b - cy) THEN 'right_of' WHEN cy_b > cy THEN 'above' ELSE 'below' END"""


@query("spatial_relations", f"WITH {_PAIRS} SELECT page, box, box_b, {_RELATION} AS relation FROM pairs")
def spatial_relations(spark, sf_dir):
    return _pairs(spark, sf_dir).select("page", "box", "box_b", g.relation().alias("relation"))


@query("node_features", f"WITH {_PAIRS} SELECT page, box, count(*) AS degree, count(*) FILTER ({_RELATION} IN ('contains', 'intersects')) AS touching, min(d2) AS nearest FROM pairs GROUP BY page, box")
def node_features(spark, sf_dir):
    touching = F.count(F.when(g.relation().isin("contains", "intersects"), 1))
    return _pairs(spark, sf_dir).groupBy("page", *g.CELLS, "box").agg(F.count(F.lit(1)).alias("degree"), touching.alias("touching"), F.min("d2").alias("nearest")).drop(*g.CELLS)


@query("point_in_region", f"WITH {_BOXES} SELECT page, cx // 500 AS gx, cy // 500 AS gy, count(*) AS n, count(DISTINCT box) AS boxes FROM b GROUP BY 1, 2, 3")
def point_in_region(spark, sf_dir):
    cell = lambda c: F.floor(F.col(c) / 500)
    return _boxes(spark, sf_dir).groupBy("page", cell("cx").alias("gx"), cell("cy").alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("box").alias("boxes"))
