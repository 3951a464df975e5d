"""Removal of repeated runs of lines, by a suffix array over the sequences of line ids.

Only lines that occur more than once can be part of a repeated run; every other line ends a run. The
suffixes that begin at such lines are sorted by prefix doubling: each round ranks pairs of ranks, the
distinct pairs sorted by range over all tasks, until no rank splits any more. Neighbours in suffix order
whose longest common prefix reaches the least length form an interval, a repeated run of lines: its
first occurrence stays and that many lines of later ones are deleted. Suffixes that begin with a line of
more than LONG_LINE_WORDS words do so from a common prefix of one line on. The common prefixes come from
the ranks of the rounds, counted no further than decides this. A reported run is a stretch of neighbouring
deleted lines, as in OP9_SQL, also where they were copied from several places.

The order of occurrences is by document id (null first), then by a hash of the text, then by line. Defined
cases: a null text stays null and has no lines; an empty text has one empty line; lines are compared byte
by byte through 64-bit hashes; rows that repeat an id are documents of their own; an empty table gives no
rows; other columns are kept by drop_repeated_lines and ignored by the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import fresh, partitions, written

#: A run of at least this many lines counts as repeated.
LEAST_LINES = 2
#: A single line of more words than this counts by itself.
LONG_LINE_WORDS = 50


def _ranked(table: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """table's distinct keys with their dense rank in key order, from 1, and the number of ranks.

    The keys are sorted by range; each range is numbered alone, and the ranges' sizes, one row a
    partition, give its first rank.
    """
    ranged = table.select(*keys).distinct().repartitionByRange(partitions(table.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = written(ranged.withColumn("nth", F.monotonically_increasing_id()), name)
    # The id holds the partition in its upper bits and the place within it in its lower 33.
    placed = placed.withColumn("range", F.shiftright("nth", 33)).withColumn("place", F.col("nth").bitwiseAND((1 << 33) - 1))
    ranges = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    first = ranges.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("first"))
    count = ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return placed.join(F.broadcast(first), "range").select(*keys, (F.col("first") + F.col("place") + 1).alias("rank")), count


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, pos, line, long): the hash of each line and whether it is long; row tells apart rows that repeat an id."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.split(text_col, "\n", -1).alias("lines"))
    long_ = lambda x: (F.length(x) > 2 * LONG_LINE_WORDS) & (F.regexp_count(x, F.lit("[^\\x20\\x09-\\x0D]+")) > LONG_LINE_WORDS)
    return rows.select("id", "row", F.posexplode(F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line"), long_(x).alias("long")))).alias("pos", "x")).select("id", "row", "pos", "x.line", "x.long")


def suffix_order(sequence: DataFrame, least: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(suffixes with their rank in suffix order, [(length, suffixes ranked by that many symbols)] for the lengths up to `least`).

    sequence: (doc, pos, run, size, line); suffixes end with their run, the stretch of neighbouring positions, size lines on.
    """
    ranks, count = _ranked(sequence, ["line"], "line-ranks")
    now = written(sequence.join(ranks, "line").select("doc", "run", "pos", "size", F.col("rank").alias("r")), "suffixes")
    levels, length = [(1, now)], 1
    while True:
        ahead = W.partitionBy("doc", "run").orderBy("pos")
        pairs = now.withColumn("s", F.coalesce(F.lead("r", length).over(ahead), F.lit(0).cast("long")))
        pairs = written(pairs, "rank-pairs")
        ranks, found = _ranked(pairs, ["r", "s"], "pair-ranks")
        now = written(pairs.join(ranks, ["r", "s"]).select("doc", "run", "pos", "size", F.col("rank").alias("r")), "suffixes")
        if found == count:
            return now, levels
        length *= 2
        if length <= least:
            levels.append((length, now))
        count = found


def neighbour_prefixes(order: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """(r, lcp): the longest common prefix of the suffixes of each rank with those of the rank before, counted up to the sum of the levels' lengths."""
    of_rank = order.groupBy("r").agg(F.min(F.struct("doc", "run", "pos", "size")).alias("a"))
    of_rank = written(of_rank, "rank-suffixes")
    pairs = of_rank.join(of_rank.select((F.col("r") + 1).alias("r"), F.col("a").alias("b")), "r", "left").withColumn("lcp", F.lit(0).cast("long"))
    for length, level in reversed(levels):
        for side in "ab":
            at = level.select(F.col("doc").alias("d"), F.col("run").alias("u"), F.col("pos").alias("q"), F.col("r").alias(f"r{side}"))
            pairs = pairs.join(at, (F.col(f"{side}.doc") == F.col("d")) & (F.col(f"{side}.run") == F.col("u")) & (F.col(f"{side}.pos") + F.col("lcp") == F.col("q")), "left").drop("d", "u", "q")
        # Suffixes that end within the length have equal ranks where they are the same to their ends.
        more = F.least(F.col("lcp") + length, F.col("a.size"), F.col("b.size"))
        pairs = pairs.withColumn("lcp", F.when(F.col("ra") == F.col("rb"), more).otherwise(F.col("lcp"))).drop("ra", "rb")
    return pairs.select("r", "lcp")


def _beginnings(least: int):
    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), 0
        for batch in batches:
            r = batch["r"].to_numpy(np.int64)
            starts = np.maximum.accumulate(np.append(last, np.where(batch["lcp"].to_numpy() < least, r, 0)))[1:]
            last = int(starts[-1]) if len(starts) else last
            yield pd.DataFrame({"range": np.full(len(r), part), "r": r, "start": starts})

    return begin


def prefix_intervals(prefixes: DataFrame, least: int) -> DataFrame:
    """(r, i): ranks with the first rank of their interval, in which every neighbours' common prefix is `least` or longer.

    Ranks are dealt by range and cut in order; one row a range carries an interval on into the next.
    """
    ranged = prefixes.repartitionByRange(partitions(prefixes.sparkSession), "r").sortWithinPartitions("r")
    placed = written(ranged.mapInPandas(_beginnings(least), "range long, r long, start long"), "interval-starts")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = placed.groupBy("range").agg(F.max("start").alias("last")).select("range", F.max("last").over(before).alias("carried"))
    return placed.join(F.broadcast(carried), "range").select("r", F.when(F.col("start") > 0, F.col("start")).otherwise(F.col("carried")).alias("i"))


def _later(suffixes: DataFrame, prefixes: DataFrame, least: int) -> DataFrame:
    """(doc, pos) of the first `least` lines of suffixes that share them with an earlier one."""
    of_rank = written(prefix_intervals(prefixes, least), "rank-intervals")
    begin = written(suffixes.join(of_rank, "r").select("doc", "pos", "i"), "beginnings")
    intervals = written(begin.groupBy("i").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("i").alias("j"), "first"), "intervals")
    later = begin.join(intervals, F.col("i") == F.col("j")).filter(F.struct("doc", "pos") > F.col("first"))
    return later.select("doc", F.explode(F.sequence(F.col("pos"), F.col("pos") + least - 1)).alias("pos"))


def repeated_lines(docs: DataFrame, least: int = LEAST_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, nth, pos, run_lines): the lines to delete, with the length of the stretch of deleted lines that each is in."""
    lines = written(line_table(docs, id_col, text_col), "lines")
    # Rows that are equal throughout are told apart by number.
    numbered = lines.withColumn("nth", F.row_number().over(W.partitionBy("id", "row", "pos").orderBy("line")))
    # Sums are written before they are joined: then both sides of a join are plain exchanges, and a hot line's can be split.
    many = written(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("line").alias("l")), "repeated")
    doc = F.struct("id", "row", "nth").alias("doc")
    shared = numbered.join(many, F.col("line") == F.col("l")).select(doc, "pos", "line", "long")
    island = F.col("pos") - F.row_number().over(W.partitionBy("doc").orderBy("pos"))
    size = F.max("pos").over(W.partitionBy("doc", "run")) - F.col("pos") + 1
    sequence = written(shared.withColumn("run", island).withColumn("size", size), "sequence")
    order, levels = suffix_order(sequence, least)
    prefixes = written(neighbour_prefixes(order, levels), "prefixes")
    # A suffix that is shorter than `least` shares its rank with its likes alone.
    gone = _later(order.filter(F.col("size") >= least), prefixes, least)
    if least > 1:
        lone = sequence.filter("long").select(F.col("doc").alias("d"), F.col("pos").alias("p"))
        gone = gone.union(_later(order.join(lone, (F.col("doc") == F.col("d")) & (F.col("pos") == F.col("p")), "left_semi"), prefixes, 1))
    gone = gone.distinct()
    run = F.col("pos") - F.row_number().over(W.partitionBy("doc").orderBy("pos"))
    marked = gone.withColumn("island", run)
    return marked.withColumn("run_lines", F.count(F.lit(1)).over(W.partitionBy("doc", "island"))).select("doc.*", "pos", "run_lines")


def line_report(docs: DataFrame, least: int = LEAST_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, n_runs, longest_run (of deleted lines)."""
    cut = repeated_lines(docs, least, id_col, text_col).groupBy("id", "row", "nth").agg(F.count(F.lit(1)).alias("n_removed"), F.sum(F.lit(1.0) / F.col("run_lines")).alias("runs"), F.max("run_lines").alias("longest_run"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n", -1))).cast("long").alias("n_lines"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("id", "row").orderBy("n_lines")))
    cut = cut.select(F.col("id").alias("i"), F.col("row").alias("w"), F.col("nth").alias("k"), "n_removed", "runs", "longest_run")
    out = rows.join(cut, F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("w")) & (F.col("nth") == F.col("k")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_lines", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce(F.round("runs").cast("long"), zero).alias("n_runs"), F.coalesce("longest_run", zero).alias("longest_run"))


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies of repeated runs of lines taken out of their texts; columns may have any names."""
    cut = repeated_lines(docs.select(id_col, text_col), least, id_col, text_col).groupBy("id", "row", "nth").agg(F.collect_set("pos").alias("gone"))  # a document's lines at most
    name = fresh(docs.columns, "cut")
    nth = fresh([*docs.columns, name], "nth")
    cut = cut.select(F.struct("id", "row", "nth", "gone").alias(name))
    rows = docs.withColumn(nth, F.row_number().over(W.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(1))))
    of = cut[name]
    joined = rows.join(cut, rows[id_col].cast("long").eqNullSafe(of["id"]) & (F.xxhash64(rows[text_col]) == of["row"]) & (rows[nth] == of["nth"]), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda line, k: ~F.array_contains(F.col(name)["gone"], k)), "\n")
    return joined.withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH l AS (SELECT doc_id, s.pos, string_split(text, chr(10))[s.pos + 1] AS line FROM documents, unnest(range(len(string_split(text, chr(10))))) AS s(pos) WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS k FROM w WHERE next IS NOT NULL),
s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM l WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 50),
c AS (SELECT doc_id, pos + d AS pos FROM r, (VALUES (0), (1)) AS t(d) WHERE k > 1 UNION SELECT doc_id, pos FROM s WHERE k > 1),
i AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
g AS (SELECT doc_id, run, count(*) AS n FROM i GROUP BY doc_id, run),
a AS (SELECT doc_id, sum(n) AS n_removed, count(*) AS n_runs, max(n) AS longest_run FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed, coalesce(a.n_runs, 0) AS n_runs, coalesce(a.longest_run, 0) AS longest_run
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""
