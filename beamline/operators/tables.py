"""Tables read from their rulings: regions, the grid of rows and columns between lines, the words in each cell, headings and rows.

Words find their row and column in one ordered pass over a region's lines and words: the lines before a word number
its place. Overlapping regions are joined until none overlaps another.

Defined cases: words outside the first and last line, or outside all regions, are in no cell; copies of a word
laid over each other count once; a region without two lines each way has no cells; without a heading row there are
no rows; null words are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .graph import components

#: Headings of mark and size columns, and the rows among which a heading row is looked for.
MARK_HEADINGS, SIZE_HEADINGS = ("MARK", "TYPE", "NO.", "TAG"), ("SIZE", "SECTION", "SHAPE", "COLUMN SIZE", "BEAM SIZE")
HEADING_ROWS = 4
#: Lines this near are one; a line bounds a region if it runs along this share of its side; regions meet through cells this wide.
SAME_LINE, ALONG, CELL = 2, 0.5, 250
_SIDES = ("x0", "y0", "x1", "y1")


def merged_regions(regions: DataFrame) -> DataFrame:
    """regions (page, x0, y0, x1, y1) with those that overlap as one, until no two overlap; region is the number of the smallest corner in its page."""
    now = written(regions.select("page", *_SIDES).distinct(), "regions")
    while True:
        named = now.withColumn("name", F.concat_ws(":", "page", *_SIDES))
        cells = named.withColumn("gx", F.explode(F.sequence(F.floor(F.col("x0") / CELL), F.floor(F.col("x1") / CELL)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("y0") / CELL), F.floor(F.col("y1") / CELL))))
        other = cells.select("page", "gx", "gy", *[F.col(c).alias(f"{c}_b") for c in (*_SIDES, "name")])
        meets = (F.col("x0") < F.col("x1_b")) & (F.col("x0_b") < F.col("x1")) & (F.col("y0") < F.col("y1_b")) & (F.col("y0_b") < F.col("y1"))
        pairs = written(cells.join(other, ["page", "gx", "gy"]).filter(F.col("name") < F.col("name_b")).filter(meets).select("name", "name_b").distinct(), "overlaps")
        if not pairs.limit(1).count():
            return now.withColumn("region", F.row_number().over(W.partitionBy("page").orderBy("y0", "x0")))
        roots = components(pairs, "name", "name_b").withColumnRenamed("node", "name")
        joined = named.join(roots, "name", "left").groupBy("page", F.coalesce("root", "name").alias("root"))
        now = written(joined.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("root"), "regions")


def _lines(regions: DataFrame, lines: DataFrame, share: float) -> DataFrame:
    """(page, region, way, at): the lines that bound rows (way y) and columns (way x) of each region, near ones as the first of them."""
    met = regions.join(lines, "page")
    flat = F.col("orientation") == "horizontal"
    lo, hi = F.when(flat, F.col("x0")).otherwise(F.col("y0")), F.when(flat, F.col("x1")).otherwise(F.col("y1"))
    first, last = F.when(flat, F.col("y0")).otherwise(F.col("x0")), F.when(flat, F.col("y1")).otherwise(F.col("x1"))
    along = F.least(F.col("hi"), hi) - F.greatest(F.col("lo"), lo) >= share * (hi - lo)
    held = met.filter(along & F.col("at").between(first - SAME_LINE, last + SAME_LINE)).select("page", "region", F.when(flat, "y").otherwise("x").alias("way"), F.col("at").cast("double").alias("at")).distinct()
    before = F.lag("at").over(W.partitionBy("page", "region", "way").orderBy("at"))
    return held.withColumn("before", before).filter(F.col("before").isNull() | (F.col("at") - F.col("before") > SAME_LINE)).drop("before")


def cells(regions: DataFrame, lines: DataFrame, words: DataFrame, along: float = ALONG) -> DataFrame:
    """(page, region, row, col, text, words): what is printed between two lines each way, in reading order.

    regions (page, region, x0, y0, x1, y1), lines (page, orientation, at, lo, hi), words (page, word, text, px, py). All steps are by
    page, so what is dealt by page already is not dealt again.
    """
    inside = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    held = words.filter("text is not null").join(regions, "page").filter(inside).select("page", "region", "word", "text", *[F.col(c).cast("double").alias(c) for c in ("px", "py")])
    copy = F.row_number().over(W.partitionBy("page", "region", "text", "px", "py").orderBy("word"))
    placed = held.withColumn("copy", copy).filter("copy = 1").drop("copy")
    # Lines stand among words by the one place that they have.
    of = lambda way: F.when(F.col("way") == way, F.col("at"))
    none = F.lit(None).cast("string")
    bounds = _lines(regions, lines, along).select("page", "region", of("x").alias("px"), of("y").alias("py"), "way")
    both = placed.withColumn("way", none).unionByName(bounds, allowMissingColumns=True)
    page = W.partitionBy("page", "region")
    for name, way in (("row", "y"), ("col", "x")):
        line = F.count(F.when(F.col("way") == way, 1))
        both = both.withColumn(name, line.over(page.orderBy(f"p{way}").rangeBetween(W.unboundedPreceding, 0))).withColumn(f"last_{name}", line.over(page))
    # A word behind the last line lies outside the table.
    at = both.filter("way is null and row > 0 and row < last_row and col > 0 and col < last_col")
    read = F.sort_array(F.collect_list(F.struct("py", "px", "word", "text")))
    out = at.groupBy("page", "region", "row", "col").agg(read.alias("r"))
    return out.select("page", "region", "row", "col", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"), F.size("r").alias("words"))


def headings(table: DataFrame) -> DataFrame:
    """(page, region, head, col, heading, path, role): the heading row of each region, and each column's heading under the headings above it."""
    label = F.upper(F.trim(F.regexp_replace("text", "\\s+", " ")))
    top = table.filter(F.col("row") <= HEADING_ROWS).withColumn("label", label).filter("label <> ''")
    known = F.count(F.when(F.col("label").isin(*MARK_HEADINGS, *SIZE_HEADINGS), 1))
    head = top.groupBy("page", "region", "row").agg(F.count(F.lit(1)).alias("n"), known.alias("known")).filter("n >= 2 and known >= 1").groupBy("page", "region").agg(F.min("row").alias("head"))
    heads = top.join(head, ["page", "region"]).filter("row <= head")
    columns = heads.filter("row = head").select("page", "region", "head", "col", F.col("label").alias("heading"))
    # A heading above stands over its column and those to its right, up to the next heading of its row.
    above = heads.filter("row < head").select("page", "region", "row", "label", F.col("col").alias("from"), F.coalesce(F.lead("col").over(W.partitionBy("page", "region", "row").orderBy("col")), F.lit(1 << 30)).alias("to"))
    over = columns.join(above, ["page", "region"]).filter("from <= col and col < to").groupBy("page", "region", "col").agg(F.sort_array(F.collect_list(F.struct("row", "label"))).alias("o"))
    path = F.concat_ws(" > ", F.transform("o", lambda x: x["label"]), "heading")
    role = F.when(F.col("heading").isin(*MARK_HEADINGS) | F.col("heading").endswith(" MARK"), "mark").when(F.col("heading").isin(*SIZE_HEADINGS), "size").otherwise("other")
    return columns.join(over, ["page", "region", "col"], "left").select("page", "region", "head", "col", "heading", path.alias("path"), role.alias("role"))


def grid_rows(table: DataFrame) -> DataFrame:
    """(page, region, row, mark, size, status): the rows under each heading row; of several mark or size columns the first counts."""
    table = written(table, "cells")
    heads = written(headings(table), "headings")
    first = heads.filter("role <> 'other'").groupBy("page", "region", "head", "role").agg(F.min("col").alias("col"))
    body = table.join(heads.select("page", "region", "head").distinct(), ["page", "region"]).filter("row > head")
    named = body.join(first, ["page", "region", "head", "col"], "left")
    of = lambda role: F.max(F.when(F.col("role") == role, F.nullif(F.trim("text"), F.lit(""))))
    rows = named.groupBy("page", "region", "row").agg(of("mark").alias("mark"), of("size").alias("size"))
    status = F.when(F.col("mark").isNull() & F.col("size").isNull(), "empty").when(F.col("mark").isNull(), "no_mark").when(F.col("size").isNull(), "no_size").otherwise("read")
    return rows.withColumn("status", status)
