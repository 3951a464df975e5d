"""Pieces of text joined along a baseline, the edge of a block of lines, and records matched by place.

A page may hold any share of the rows: pieces of such pages are numbered by range over the whole table, and marks are
carried from block to block of numbers; pieces of pages that a task can hold are read page by page. Positions are
summed by cell before they are walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import numbered, written

#: Size of a font that is not known, gaps over which a line goes on and that print as a space, offset of a baseline (in font sizes), and turn in degrees.
FONT, LINE_GAP, SPACE_GAP, BASELINE, TURN = 10.0, 1.5, 0.2, 0.4, 1.0
#: Fixed value: a tag in brackets.
TAG = r"^\[([^\[\]]+)\]$"
#: Numbers that a mark is carried over within one group.
BLOCK = 1 << 16


def last_marked(rows: DataFrame, place: str, mark: Column, name: str, own: bool) -> DataFrame:
    """Adds the last place before each row's (own: up to it) where mark holds, null where there is none: running within blocks, then from block to block."""
    at = rows.withColumn("_block", F.floor(F.col(place) / BLOCK)).withColumn("_mark", F.when(mark, F.col(place)))
    ends = at.groupBy("_block").agg(F.max("_mark").alias("_end"))
    before = ends.select("_block", F.max("_end").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))  # one row a block
    running = F.max("_mark").over(W.partitionBy("_block").orderBy(place).rowsBetween(W.unboundedPreceding, 0 if own else -1))
    return at.withColumn(name, running).join(before, "_block").withColumn(name, F.coalesce(name, "_before")).drop("_block", "_mark", "_before")


def _read_on(met: DataFrame) -> DataFrame:
    """Pieces with what was before them, was (page, x1, font, rotation, mid), as goes_on, tag and spaced."""
    gap = F.col("x0") - F.col("was.x1")
    level = (F.abs(F.col("rotation") - F.col("was.rotation")) <= TURN) & (F.abs(_mid() - F.col("was.mid")) <= BASELINE * F.greatest("font", "was.font"))
    goes_on = F.coalesce((F.col("page") == F.col("was.page")) & level & (gap >= 0) & (gap <= LINE_GAP * F.col("was.font")), F.lit(False))
    return met.withColumn("goes_on", goes_on).withColumn("tag", F.regexp_extract(F.trim("text"), TAG, 1)).withColumn("spaced", F.col("goes_on") & (gap > SPACE_GAP * F.col("was.font"))).drop("was")


def _mid() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def _is_tag() -> Column:
    return F.col("tag") != ""


def _numbered_over_tables(known: DataFrame, order: list[Column]) -> DataFrame:
    """Pieces in the table's order with begins, modifier and head, the place of the annotation's first: marks are carried from block to block."""
    placed = numbered(known, [F.col("page"), *order], "place", "long")
    before = placed.select((F.col("place") + 1).alias("place"), F.struct("page", "x1", "font", "rotation", _mid().alias("mid")).alias("was"))
    met = _read_on(placed.join(before, "place", "left"))
    turns = last_marked(met, "place", ~(_is_tag() & F.col("goes_on")), "sure", own=False)
    begun = written(_begun(turns), "pieces")
    return last_marked(begun, "place", F.col("begins"), "head", own=True)


def _numbered_on_pages(known: DataFrame, order: list[Column]) -> DataFrame:
    """The same in each page's order, for pages that a task can hold: all windows are those of the page."""
    w = W.partitionBy("page").orderBy(*order)
    placed = known.withColumn("place", F.row_number().over(w).cast("long")).withColumn("was", F.lag(F.struct("page", "x1", "font", "rotation", _mid().alias("mid"))).over(w))
    marked = lambda c, end: F.max(F.when(c, F.col("place"))).over(w.rowsBetween(W.unboundedPreceding, end))
    turns = _read_on(placed).withColumn("sure", marked(~(_is_tag() & F.col("goes_on")), -1))
    return _begun(turns).withColumn("head", marked(F.col("begins"), 0))


def _begun(turns: DataFrame) -> DataFrame:
    # Behind the last piece that surely is no modifier, tags that go on are modifiers and beginnings in turn.
    begins = ~F.col("goes_on") | ((F.col("place") - F.col("sure")) % 2 == 0)
    return turns.withColumn("begins", begins).withColumn("modifier", _is_tag() & ~F.col("begins"))


def baseline_groups(pieces: DataFrame, whole_pages: bool = False) -> DataFrame:
    """One row per annotation of pieces (page, piece, text, x0, y0, x1, y1, font, rotation), read by line and then from the left.

    A piece goes on from the one before it where both share page, turn and baseline and the gap is neither negative nor wide. A tag in brackets that goes
    on from an annotation becomes its modifier and ends it; a second one begins an annotation of its own, to which others may be joined.
    A null or zero font counts as FONT, null text as empty, null rotation as 0; pieces without page or sides take no part. Labels that go on in the line below are not joined.
    With whole_pages a task takes a page whole, which needs one exchange by page, or none where pieces are dealt by page; else a page may hold any share of the rows.
    """
    known = pieces.dropna(subset=["page", "x0", "y0", "x1", "y1"]).select(
        "page", "piece", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")],
        F.coalesce(F.nullif(F.col("font").cast("double"), F.lit(0.0)), F.lit(FONT)).alias("font"), F.coalesce(F.col("rotation").cast("double"), F.lit(0.0)).alias("rotation"),
    )
    headed = (_numbered_on_pages if whole_pages else _numbered_over_tables)(known, [F.round("y0", 1), F.col("x0"), F.col("piece")])
    printed = F.concat(F.when(F.col("spaced") & ~F.col("begins"), " ").otherwise(""), F.col("text"))
    grouped = headed.groupBy("page", "head").agg(
        F.min_by("piece", "place").alias("piece"), F.count(F.lit(1)).alias("n"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
        F.sort_array(F.collect_list(F.when(~F.col("modifier"), F.struct("place", "text", printed.alias("printed"))))).alias("chain"),
        F.max(F.when(F.col("modifier"), F.col("tag"))).alias("modifier"), F.max(F.when(F.col("modifier"), F.col("text"))).alias("raw"),
    )
    line = lambda c: F.array_join(F.transform("chain", lambda x: x[c]), "")
    original = F.trim(F.concat(line("printed"), F.coalesce(F.concat(F.lit(" "), "raw"), F.lit(""))))
    reasons = F.concat_ws(",", F.when(F.size("chain") > 1, "same_baseline_merge"), F.when(F.col("raw").isNotNull(), "bracket_modifier_attachment"))
    return grouped.select("page", "piece", "n", F.trim(line("text")).alias("label"), original.alias("original"), "modifier", reasons.alias("reasons"), "x0", "y0", "x1", "y1")


def contiguous_edge(points: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """(by, edge) of points (by, value): the farthest position below the anchor that is reached without a gap wider than the group's.

    anchors holds (by, anchor, gap), one row a group, gap > 0; a null anchor means the group's largest position. Positions above
    the anchor are left out; a group without anchor and positions has no row. Positions are summed by cells as wide as the gap first, so a walk
    is over as many rows as gaps fit in the group's extent.
    """
    from_ = points.join(anchors, by).dropna(subset=["value"])
    top = from_.groupBy(by).agg(F.max("value").alias("top"))
    start = anchors.join(top, by, "left").select(by, F.coalesce("anchor", "top").cast("double").alias("start"), "gap").filter("start is not null")
    all_ = points.dropna(subset=["value"]).select(by, F.col("value").cast("double").alias("value")).unionByName(start.select(by, F.col("start").alias("value")))
    cells = all_.join(start, by).filter("value <= start").groupBy(by, "gap", F.floor((F.col("start") - F.col("value")) / F.col("gap")).alias("cell")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = W.partitionBy(by).orderBy("cell")
    wide = F.coalesce((F.lag("lo").over(w) - F.col("hi") > F.col("gap")).cast("int"), F.lit(0))
    walked = cells.withColumn("wide", wide).withColumn("gaps", F.sum("wide").over(w))
    return walked.filter("gaps = 0").groupBy(by).agg(F.min("lo").alias("edge"))


def nearest_record(annotations: DataFrame, records: DataFrame, radius: int) -> DataFrame:
    """(annotation, record, kind, d2) of annotations (page, annotation, cx, cy) and records (page, record, kind, turn, cx, cy): the nearest record of the page within radius.

    Centres are doubled whole numbers, d2 four times the squared distance; of equally near ones the lesser turn, then the lesser record.
    Records are filed under the cells around their own, so a page meets by cells; annotations without one near are left out.
    """
    cell = 2 * radius
    gx, gy = F.floor(F.col("cx") / cell), F.floor(F.col("cy") / cell)
    around = F.explode(F.array(*[F.struct((gx + i).alias("gx"), (gy + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("g")
    filed = records.select("page", around, "record", "kind", "turn", F.col("cx").alias("rx"), F.col("cy").alias("ry")).select("page", "g.*", "record", "kind", "turn", "rx", "ry")
    dx, dy = F.col("cx") - F.col("rx"), F.col("cy") - F.col("ry")
    near = annotations.withColumn("gx", gx).withColumn("gy", gy).join(filed, ["page", "gx", "gy"]).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= 4 * radius * radius)
    return near.groupBy("annotation").agg(F.min(F.struct("d2", "turn", "record", "kind")).alias("best")).select("annotation", "best.record", "best.kind", "best.d2")
