"""The trie of conversations by their turns: one node for each distinct sequence of first turns, by prefix doubling.

Turns get dense names. Two neighbouring blocks of a power of two turns make one of twice the length, named by the
pair of their names: one round of joins for each power, over half as many blocks each time. A prefix of d turns is
composed along the binary digits of d, longest block first: the prefix named so far and the block that follows it
make a pair, and the pair's name is the prefix's; again one round for each power. Names then stand for nodes.

A conversation owns the nodes of which it is the smallest member. They are the end of its path, so what a subtree
sums up comes from members alone: of a member that owns the node, what it owns from there on; of any other, all that it
owns. Each turn so is counted once for each of its conversation's nodes, however deep the trie is.

Names that a large share of rows bear go to all tasks, four for each shuffle partition at most; positions and sums along a
conversation come from range partitions with what lies before each, so one conversation, turn or node may hold any
share of the rows. Members that end at a node are joined into texts of CHUNK_BYTES before one task hashes them in order.

Defined cases: rows without a conversation id take no part; null roles and texts are empty; a null turn comes first;
rows of one turn are ordered by the SHA-256 of role and text, repeated rows are turns of their own; a conversation may
be turnless; without conversations there are no nodes, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import CRC_TABLE_SQL, crc_sql, joined, numbered, partitions, written

#: Conversations that share a base, and the number of kinds of heads taken from it.
FAMILY, HEADS = 100, 6
CHUNK_BYTES = 65_536


def running(rows: DataFrame, order: str, more: list[str], value: str, name: str) -> DataFrame:
    """rows, written, with the sum of value over the rows of their c up to them, in the order of order and more."""
    by = ["c", order, *more]
    at = written(rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    sums = at.groupBy("_part", "c").agg(F.sum(value).alias("_sum"))
    # Only the first conversation of a range can have begun in an earlier one: a row for each range at most.
    carried = sums.withColumn("_carried", F.sum("_sum").over(W.partitionBy("c").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).filter("_carried is not null").drop("_sum")
    own = at.withColumn("_own", F.sum(value).over(W.partitionBy("_part", "c").orderBy("_at")))
    return own.join(F.broadcast(carried), ["_part", "c"], "left").withColumn("up_to", F.col("_own") + F.coalesce("_carried", F.lit(0))).drop("_at", "_part", "_own", "_carried")


def named(rows: DataFrame, keys: list[str], often: int, name: str) -> DataFrame:
    """rows, a written table, with name: a dense number of their keys."""
    keyed = numbered(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")), f"{name}-names", "name")
    return joined(rows, written(keyed, f"{name}-keys"), keys, F.col("times") > often).drop("times")


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, key, chars): the turns of each conversation in order, from 0; key stands for role and text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), key.alias("key"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    return running(rows, "turn", ["key"], "one", "turns").select("c", (F.col("up_to") - 1).alias("pos"), "key", "chars")


def rebuilt(turns: DataFrame, often: int) -> tuple[DataFrame, DataFrame]:
    """Turns (c, pos, key, chars) and lengths (c, len) once the first turns of each conversation come from its family's first."""
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("own")).withColumn("h", F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEADS))).withColumn("base", F.col("c") - F.col("c") % FAMILY)
    convs = written(convs, "conversations")
    of_base = convs.select(F.col("c").alias("base"), F.col("own").alias("base_own"))
    convs = written(convs.join(of_base, "base", "left").withColumn("k", F.least("h", F.coalesce("base_own", F.lit(0)))), "heads")
    first = turns.filter((F.col("c") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("c", "base")
    heads = convs.filter("k > 0").select("c", "base", "k").join(first, "base").filter("pos < k").select("c", "pos", "key", "chars")
    later = joined(turns, convs.select("c", "h", "k", F.col("own").alias("times")), ["c"], F.col("times") > often).filter("pos >= h")
    rest = later.select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "chars")
    return written(heads.unionByName(rest), "rebuilt"), convs.select("c", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))


def blocks_of(turns: DataFrame, longest: int, often: int) -> list[DataFrame]:
    """At place j the blocks (c, i, name) of 2^j turns that begin at turn i * 2^j; equal blocks have one name."""
    blocks = [written(named(turns.select("c", F.col("pos").alias("i"), "key", "chars"), ["key"], often, "block").select("c", "i", "name", "chars"), "block-0")]
    for j in range(1, max(1, longest).bit_length()):
        half = blocks[-1].groupBy("c", F.shiftright("i", 1).alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b"))
        pairs = written(half.filter("a is not null and b is not null"), "pairs")
        blocks.append(written(named(pairs, ["a", "b"], often, "block").select("c", "i", "name"), f"block-{j}"))
    return blocks


def prefixes_of(blocks: list[DataFrame], lengths: DataFrame, often: int) -> DataFrame:
    """(c, d, name) for each conversation's first d turns, from 0 to its length; equal prefixes have one name."""
    have = lengths.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"))
    for j in reversed(range(len(blocks))):
        follow = blocks[j].filter(F.col("i") % 2 == 0).select("c", F.shiftleft("i", j).alias("d"), F.col("name").alias("b"))
        pairs = written(have.join(follow, ["c", "d"]).select("c", "d", F.col("name").alias("a"), "b"), "steps")
        new = written(named(pairs, ["d", "a", "b"], often, "prefix").select("c", (F.col("d") + (1 << j)).alias("d"), "name"), f"prefix-{j}")
        have = have.unionByName(new)
    return have


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (rep, d, c) in order -> (rep, d, part, seq, ids): the ids of a node's rows in texts of CHUNK_BYTES."""
    part, seq, node, ids, size = TaskContext.get().partitionId(), 0, None, [], 0
    for batch in batches:
        out = []
        for rep, d, c in zip(batch["rep"].tolist(), batch["d"].tolist(), batch["c"].tolist()):
            if ids and (node != (rep, d) or size > CHUNK_BYTES):
                out.append((*node, part, seq, ",".join(ids)))
                seq, ids, size = seq + 1, [], 0
            node = (rep, d)
            ids.append(str(c))
            size += len(ids[-1]) + 1
        yield pd.DataFrame(out, columns=["rep", "d", "part", "seq", "ids"])
    if ids:
        yield pd.DataFrame([(*node, part, seq, ",".join(ids))], columns=["rep", "d", "part", "seq", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks in order -> (c, d, sha): the hash of each node's ids, one chunk at a time."""
    node, sha = None, None
    for batch in batches:
        out = []
        for rep, d, ids in zip(batch["rep"].tolist(), batch["d"].tolist(), batch["ids"].tolist()):
            if node != (rep, d):
                if sha:
                    out.append((*node, sha.hexdigest()))
                node, sha = (rep, d), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["c", "d", "sha"])
    if sha:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=["c", "d", "sha"])


def ends_of(members: DataFrame) -> DataFrame:
    """(c, d, sha) of members (rep, d, c) that end at the node (rep, d)."""
    n = partitions(members.sparkSession)
    chunks = members.repartitionByRange(n, "rep", "d", "c").sortWithinPartitions("rep", "d", "c").mapInPandas(_chunks, "rep long, d long, part long, seq long, ids string")
    return chunks.repartition(n, "rep", "d").sortWithinPartitions("rep", "d", "part", "seq").mapInPandas(_digests, "c long, d long, sha string")


def trie_nodes(turns: DataFrame, lengths: DataFrame, often: int) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of turns (c, pos, key, chars)."""
    longest = lengths.agg(F.max("len")).first()[0] or 0
    blocks = blocks_of(turns, longest, often)
    parts = ["c", "d", "name", "chars", "end"]
    row = lambda frame, **given: frame.select("c", "d", *[given.get(x, F.lit(None).cast("long")).alias(x) for x in parts[2:]])
    prefixes = row(prefixes_of(blocks, lengths, often), name=F.col("name"))
    texts = row(blocks[0].select("c", (F.col("i") + 1).alias("d"), "chars"), chars=F.col("chars"))
    ends = row(lengths.select("c", F.col("len").cast("long").alias("d")), end=F.lit(1).cast("long"))
    paths = written(prefixes.unionByName(texts).unionByName(ends).groupBy("c", "d").agg(*[F.max(x).alias(x) for x in parts[2:]]), "paths")
    nodes = written(paths.groupBy("d", "name").agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n")), "named-nodes")
    members = written(joined(paths, nodes, ["d", "name"], F.col("n") > often).select("c", "d", "rep", "n", F.coalesce("chars", F.lit(0)).alias("chars"), "end"), "members")
    parents = members.select("c", (F.col("d") + 1).alias("d"), F.col("rep").alias("parent"))
    owned = written(members.filter("c = rep").select("c", "d", "n", "chars").join(parents, ["c", "d"], "left"), "owned")
    children = owned.filter("parent is not null").groupBy(F.col("parent").alias("c"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("children"))
    owned = written(owned.join(children, ["c", "d"], "left").withColumn("children", F.coalesce("children", F.lit(0))), "nodes")
    shared = owned.filter("n > 1").select("c", "d", ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    from_here = running(shared.withColumn("up", -F.col("d")), "up", [], "saved", "saved").select("c", "d", F.col("up_to").alias("saved"), F.lit(0).cast("long").alias("leaf"))
    leaves = owned.filter("children = 0").select("c", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"))
    given = written(shared.select("c", "saved", F.lit(0).cast("long").alias("leaf")).union(leaves).groupBy("c").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).filter("saved > 0 or leaf > 0"), "given")
    given = written(given.join(members.groupBy("c").agg(F.count(F.lit(1)).alias("times")), "c"), "given-times")
    brought = joined(members.select("c", "d", "rep"), given, ["c"], F.col("times") > often)
    brought = brought.select(F.col("rep").alias("c"), "d", F.when(F.col("c") == F.col("rep"), F.lit(0)).otherwise(F.col("saved")).alias("saved"), "leaf")
    sums = brought.unionByName(from_here).groupBy("c", "d").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    out = owned.join(sums, ["c", "d"], "left").join(ends_of(members.filter("end = 1").select("rep", "d", "c")), ["c", "d"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        zero("leaf").alias("n_leaves"), zero("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, rebuild: bool = False, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of all conversations; rebuild: with first turns from the first conversation of each family."""
    turns = written(ordered_turns(conversations, id_col, turn_col, role_col, text_col), "ordered")
    often = max(1, turns.count() // (4 * partitions(conversations.sparkSession)))
    if rebuild:
        return trie_nodes(*rebuilt(turns, often), often)
    return trie_nodes(turns, written(turns.groupBy("c").agg(F.count(F.lit(1)).alias("len")), "lengths"), often)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)


OP12_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS t),
k AS (SELECT conv_id AS c, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (SELECT c, key, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM k),
v AS MATERIALIZED (SELECT c, {crc_sql("CAST(c AS VARCHAR)", "crc.t")} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM t), crc),
a AS (SELECT v.c, t.pos AS o, 0 AS late, key, chars FROM v JOIN t ON t.c = v.base AND t.pos < v.h UNION ALL SELECT c, pos, 1, key, chars FROM t JOIN v USING (c) WHERE pos >= h),
l AS (SELECT c, list(key ORDER BY late, o) AS keys, list(chars ORDER BY late, o) AS chars FROM a GROUP BY c),
s AS MATERIALIZED (SELECT v.c, coalesce(keys, []) AS keys, coalesce(chars, []) AS chars FROM v LEFT JOIN l USING (c)),
p AS MATERIALIZED (SELECT c, d, keys[1:d] AS seq, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(keys) AS last FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM s)),
n AS MATERIALIZED (SELECT d, seq, min(c) AS id, count(*) AS n, max(chars) AS chars, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last) AS ends FROM p GROUP BY d, seq),
w AS MATERIALIZED (SELECT x.*, y.id AS parent FROM n x LEFT JOIN n y ON x.d = y.d + 1 AND x.seq[1:y.d] = y.seq),
kids AS (SELECT parent AS id, d - 1 AS d, count(*) AS kids FROM w WHERE d > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT w.*, coalesce(kids, 0) AS kids FROM w LEFT JOIN kids USING (id, d)),
u AS (SELECT x.id, x.d, sum((y.n - 1) * y.chars) AS saved, count(*) FILTER (WHERE y.kids = 0) AS leaves FROM f x JOIN f y ON y.d >= x.d AND y.seq[1:x.d] = x.seq GROUP BY ALL)
SELECT id AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM f JOIN u USING (id, d)
"""
