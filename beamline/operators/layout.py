"""Order, neighbourhood and spatial relations of words and boxes.

Boxes meet through grid cells, an equi-join: every box is filed under all cells within reach, and meets those that
are filed in the cell of its own centre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Widths of a cell in reaches: a box is filed under (1 + 2 / CELL)^2 cells on average, where cells of one reach take nine.
CELL = 8
#: Columns of a box's own cell: with them in a key, what is counted of a page's box stays where its pairs were made.
CELLS = ("gx", "gy")
#: Rows that one task sorts; tables of more are dealt to more tasks, so that a task's memory does not grow with them.
ROWS_A_TASK = 500_000


def islands(rows: DataFrame, by: list[str], order: list[Column], breaks: Column) -> DataFrame:
    """Numbers runs of rows from 0: a new one begins where breaks holds."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def with_centres(boxes: DataFrame) -> DataFrame:
    """Adds twice the centre, in whole numbers, and an id of the whole box."""
    return boxes.withColumn("cx", F.col("x0") + F.col("x1")).withColumn("cy", F.col("y0") + F.col("y1")).select(box_name("l_orderkey", "l_partkey").alias("box"), "page", "x0", "y0", "x1", "y1", "cx", "cy")


def box_name(*keys: str) -> Column:
    return F.concat_ws("-", *keys)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, n or so of them, by keys to as many tasks as they need; the number for few rows is left to Spark."""
    tasks = n // ROWS_A_TASK + 1
    return rows.repartition(tasks, *keys) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(*keys)


def near_pairs(boxes: DataFrame, radius: int) -> DataFrame:
    """Ordered pairs of different boxes on a page whose centres are at most radius apart; d2 is 4 times the squared distance, and CELLS the first box's cell, by which pairs are dealt.

    Boxes are filed and dealt by cells once: both sides of the join have the same columns and no filter of their own, so that they are one
    exchange. A cell is CELL times as wide as the reach, so that a box stands in few cells besides its own; far sides follow from centres after the join.
    """
    reach = 2 * radius
    cell = CELL * reach
    cells = lambda c: F.sequence(F.floor((F.col(c) - reach) / cell), F.floor((F.col(c) + reach) / cell))
    kept, own = ("box", "x0", "y0", "cx", "cy"), lambda c: F.floor(F.col(c) / cell)
    at = boxes.select("page", *kept).withColumn("gx", F.explode(cells("cx"))).withColumn("gy", F.explode(cells("cy"))).repartition("page", "gx", "gy")
    other = at.select("page", "gx", "gy", *[F.col(c).alias(f"{c}_b") for c in kept])
    d2 = (F.col("cx") - F.col("cx_b")) * (F.col("cx") - F.col("cx_b")) + (F.col("cy") - F.col("cy_b")) * (F.col("cy") - F.col("cy_b"))
    at_home = (own("cx") == F.col("gx")) & (own("cy") == F.col("gy"))
    met = at.join(other, ["page", "gx", "gy"]).filter(F.when(at_home, d2) <= reach * reach).filter(F.col("box") != F.col("box_b")).withColumn("d2", d2)
    whole = lambda b: [F.col(f"box{b}"), F.col(f"x0{b}"), F.col(f"y0{b}"), (F.col(f"cx{b}") - F.col(f"x0{b}")).alias(f"x1{b}"), (F.col(f"cy{b}") - F.col(f"y0{b}")).alias(f"y1{b}"), F.col(f"cx{b}"), F.col(f"cy{b}")]
    return met.select("page", *CELLS, *whole(""), *whole("_b"), "d2")


def relation() -> Column:
    """How box a lies to box b; the first that holds."""
    contains = (F.col("x0") <= F.col("x0_b")) & (F.col("y0") <= F.col("y0_b")) & (F.col("x1") >= F.col("x1_b")) & (F.col("y1") >= F.col("y1_b"))
    meets = (F.col("x0") <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1")) & (F.col("y0") <= F.col("y1_b")) & (F.col("y0_b") <= F.col("y1"))
    dx, dy = F.col("cx_b") - F.col("cx"), F.col("cy_b") - F.col("cy")
    flat = F.abs(dx) >= F.abs(dy)
    return F.when(contains, "contains").when(meets, "intersects").when(flat & (dx > 0), "left_of").when(flat, "right_of").when(dy > 0, "above").otherwise("below")
