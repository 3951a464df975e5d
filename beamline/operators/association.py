"""Labels and the members they name: by the tip of a leader first, then by what lies near the label itself.

Points meet segments through grid cells of CELL reaches, an equi-join. Where a member may be claimed once
only, the labels of a page go in order, as a stream. A second pass looks farther for labels that were left over,
among members that are.

Defined cases: labels without a place, and pages without members, resolve to nothing and say why; two members that
are near to equally far are told apart by nobody, and the label abstains; repeated rows are to be made one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: How far a label reaches, how far a leader's tip reaches, and the lead that the nearest member needs.
REACH, TIP_REACH, MARGIN = 100.0, 80.0, 8.0
#: The least and the most confidence.
LEAST, MOST = 0.35, 0.95
#: Widths of a cell in reaches: a short segment is filed under some two cells, where cells of one reach take nine.
CELL = 4
#: The second pass reaches so many times as far.
FARTHER = 2


def to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The distance of a point from the nearest point of a segment; a segment without length is a point."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / n)))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def near(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """points (page, px, py, ...) and segments (page, x0, y0, x1, y1, ...) at most reach apart, with d; each pair meets in the point's cell."""
    low, high = lambda a, b: F.floor((F.least(a, b) - reach) / (CELL * reach)), lambda a, b: F.floor((F.greatest(a, b) + reach) / (CELL * reach))
    cells = segments.withColumn("gx", F.explode(F.sequence(low("x0", "x1"), high("x0", "x1")))).withColumn("gy", F.explode(F.sequence(low("y0", "y1"), high("y0", "y1"))))
    at = points.withColumn("gx", F.floor(F.col("px") / (CELL * reach))).withColumn("gy", F.floor(F.col("py") / (CELL * reach)))
    met = at.join(cells, ["page", "gx", "gy"]).withColumn("d", to_segment(*[F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")]))
    return met.filter(F.col("d") <= reach).drop("gx", "gy", "x0", "y0", "x1", "y1")


def candidates(labels: DataFrame, members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(page, label, method, member, length, d): what each label may name.

    labels (page, label, px, py), members (page, member, length, x0, y0, x1, y1), leaders (page, leader, x0, y0, x1, y1). The ends of
    the nearest leader look for members first; a label whose leader finds none looks from where it stands.
    """
    of_leader = near(labels, leaders, REACH).groupBy("page", "label").agg(F.min(F.struct("d", "leader")).alias("m")).select("page", "label", "m.leader")
    ends = of_leader.join(leaders, ["page", "leader"]).select("page", "label", F.explode(F.array(F.struct(F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")))).alias("e")).select("page", "label", "e.*")
    by_tip = written(near(ends, members, TIP_REACH).groupBy("page", "label", "member", "length").agg(F.min("d").alias("d")).withColumn("method", F.lit("leader_tip_to_stroke")), "by-tip")
    rest = labels.join(by_tip.select("page", "label").distinct(), ["page", "label"], "left_anti")
    by_place = near(rest, members, REACH).withColumn("method", F.lit("proximity_stroke"))
    columns = ["page", "label", "method", "member", "length", "d"]
    return by_tip.select(*columns).unionByName(by_place.select(*columns))


def nearest(found: DataFrame) -> DataFrame:
    """(page, label, method, member, d, second): of each label the nearest member, the longer of two as near, and the next one's distance."""
    by = W.partitionBy("page", "label").orderBy("d", F.desc("length"), "member")
    ranked = found.withColumn("nth", F.row_number().over(by)).filter("nth <= 2")
    one = lambda n, c: F.max(F.when(F.col("nth") == n, F.col(c)))
    return ranked.groupBy("page", "label").agg(one(1, "method").alias("method"), one(1, "member").alias("member"), one(1, "d").alias("d"), one(2, "d").alias("second"))


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates that stand in order, page after page: each label with the member it claims or the reason why none."""
    label = None
    taken: set[str] = set()
    free: list[tuple] = []

    def claim() -> tuple:
        if not free:
            return (*label, None, None, None, "member_already_claimed")
        if len(free) > 1 and free[1][2] - free[0][2] <= MARGIN:
            return (*label, None, None, None, "ambiguous_members")
        method, member, d = free[0]
        taken.add(member)
        return (*label, method, member, d, None)

    columns = ["page", "label", "method", "member", "d", "reason"]
    for batch in batches:
        out = []
        for page, name, *member in zip(*[batch[c].tolist() for c in ("page", "label", "method", "member", "d")]):
            if (page, name) != label:
                if label is not None:
                    out.append(claim())
                    if page != label[0]:
                        taken.clear()
                label, free = (page, name), []
            # The first two that are free decide.
            if len(free) < 2 and member[1] not in taken:
                free.append(tuple(member))
        yield pd.DataFrame(out, columns=columns)
    if label is not None:
        yield pd.DataFrame([claim()], columns=columns)


def claimed(found: DataFrame, places: DataFrame) -> DataFrame:
    """(page, label, method, member, d, reason): labels claim members in the order of places (page, label, place), each member once."""
    met = found.join(places, ["page", "label"]).select("page", "label", "place", "method", "member", "length", "d")
    # Members are claimed within a page. A task streams its pages in order and holds the claimed members of one page alone.
    ordered = met.repartition("page").sortWithinPartitions("page", F.col("place").asc_nulls_last(), "label", "d", F.desc("length"), "member")
    return ordered.mapInPandas(_claims, "page long, label string, method string, member string, d double, reason string")


def associated(labels: DataFrame, members: DataFrame, leaders: DataFrame) -> DataFrame:
    """One row per label (page, label, px, py, place): page, label, stage, method, member, distance, confidence, reason; a member is claimed once.

    Labels that found none in reach, or only claimed ones, look FARTHER among the members that are left.
    """
    labels, members = written(labels, "labels"), written(members, "members")
    places, at = labels.select("page", "label", "place"), labels.filter("px is not null and py is not null").select("page", "label", "px", "py")
    first = written(claimed(written(candidates(at, members, leaders), "candidates"), places), "claims")
    left = labels.select("page", "label").join(first.filter("reason is null or reason = 'ambiguous_members'").select("page", "label"), ["page", "label"], "left_anti")
    free = members.join(first.filter("member is not null").select("page", "member"), ["page", "member"], "left_anti")
    wider = near(at.join(left, ["page", "label"], "left_semi"), free, FARTHER * REACH).withColumn("method", F.lit("proximity_stroke"))
    second = written(claimed(written(wider.select("page", "label", "method", "member", "length", "d"), "wider"), places), "second-claims")
    taken = lambda rows, stage: rows.filter("member is not null").select("page", "label", F.lit(stage).alias("stage"), "method", "member", "d")
    got = taken(first, "primary").unionByName(taken(second, "recovery"))
    why = first.filter("member is null").select("page", "label", F.col("reason").alias("first_why")).join(second.filter("member is null").select("page", "label", F.col("reason").alias("second_why")), ["page", "label"], "full")
    some = members.select("page").distinct().withColumn("held", F.lit(True))
    out = labels.select("page", "label", F.col("px").isNull().alias("nowhere")).join(got, ["page", "label"], "left").join(why, ["page", "label"], "left").join(some, "page", "left")
    reason = F.when(F.col("member").isNull(), F.when(F.col("nowhere"), "missing_text_bbox").when(F.col("held").isNull(), "no_member_candidates").otherwise(F.coalesce("second_why", "first_why", F.lit("no_stroke_in_range"))))
    sure = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), 1 - F.col("d") / REACH))
    return out.select("page", "label", "stage", "method", "member", F.round("d", 3).alias("distance"), F.round(F.when(F.col("member").isNotNull(), sure), 4).alias("confidence"), reason.alias("reason"))
