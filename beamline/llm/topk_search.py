"""Exact top-k inner products: a ball tree per shard, searched branch and bound.

Shards are dealt by id hash and hold a bounded number of rows. A block of queries visits the shards in
waves of 1, 1, 2, 4, ... shards; the kth score that all waves so far have found goes with it, and a ball is
opened, the one of greatest upper bound first, only if the bound reaches the current kth score. Trees are
read once for each BLOCKS_TOGETHER blocks that come to their shard. Scores are inner products of
floor(256 * x); equal scores go to the smaller id.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor
do rows without an id; vectors of different lengths meet as if the shorter ended in zeros; rows that
repeat an id are candidates each, but never for a query of that id, and queries each, with k rows of
their own ranks; an empty table gives no rows; other columns are ignored. Where floating products of
scaled components could be inexact, integers are multiplied. A scaled component beyond a long counts as
the long's end, and so does a score: those beyond are equal, and go by id.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import written

#: Rows of a shard and queries of a block, on average; both are dealt by hash.
SHARD_ROWS = 16_384
BLOCK_ROWS = 256
BLOCKS_TOGETHER = 64
LEAF = 128
#: The ends of a long, at which greater components and scores are held.
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where inner products then stay exact, else as Python integers."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (points, queries)]
    kind = np.float64 if most[0] * most[1] * max(1, points.shape[1]) < 2**53 else object
    return points.astype(kind), queries.astype(kind)


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Row order, nodes (from, to, left, right; left < 0 in a leaf), centres and radii; halves are split across the widest direction."""
    order, nodes, centres, radii = np.arange(len(points)), [], [], []
    real = points.astype(np.float64)

    def add(lo: int, hi: int) -> int:
        rows = real[order[lo:hi]]
        centre = rows.mean(axis=0)
        me = len(nodes)
        nodes.append((lo, hi, -1, -1))
        centres.append(centre)
        radii.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())))
        if hi - lo > leaf:
            far = rows[((rows - centre) ** 2).sum(axis=1).argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argsort(rows @ (far - other), kind="stable")]
            nodes[me] = (lo, hi, add(lo, lo + mid), add(lo + mid, hi))
        return me

    if len(points):
        add(0, len(points))
    return order, nodes, np.array(centres), np.array(radii)


def search_tree(points: np.ndarray, ids: np.ndarray, nodes: list, ceilings: np.ndarray, query: np.ndarray, own: int, floor_: int | None, k: int) -> list[tuple[int, int]]:
    """The best (score, id) of one query among points, none under floor_; ceilings: of each node the highest score it may hold."""
    best: list[tuple[int, int]] = []
    low = floor_
    heap = [(-ceilings[0], 0)]
    while heap:
        ceiling, me = heapq.heappop(heap)
        if low is not None and -ceiling < low:
            break
        lo, hi, left, right = nodes[me]
        if left >= 0:
            for x in (left, right):
                if low is None or ceilings[x] >= low:
                    heapq.heappush(heap, (-ceilings[x], x))
            continue
        scores = points[lo:hi] @ query
        if scores.dtype == object:
            scores = np.array([min(max(x, LOWEST), HIGHEST) for x in scores], dtype=object)
        hit = np.flatnonzero((ids[lo:hi] != own) & ((scores >= low) if low is not None else True))
        if len(hit):
            best = sorted([*best, *zip(map(int, scores[hit]), ids[lo:hi][hit].tolist())], key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                low = best[-1][0] if low is None else max(low, best[-1][0])
    return best


def _pack(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(group["v"]), group["id"].to_numpy(np.int64)


def _tree_of(group: pd.DataFrame) -> pd.DataFrame:
    points, ids = _pack(group)
    order, nodes, centres, radii = build_tree(points)
    return pd.DataFrame({"shard": group["shard"][:1].to_numpy(), "rows": [len(ids)], "width": [points.shape[1]], "points": [points[order].tobytes()], "ids": [ids[order].tobytes()], "nodes": [np.array(nodes, dtype=np.int64).tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()]})


def _block_of(group: pd.DataFrame) -> pd.DataFrame:
    points, ids = _pack(group)
    return pd.DataFrame({"block": group["block"][:1].to_numpy(), "q_width": [points.shape[1]], "queries": [points.tobytes()], "q_ids": [ids.tobytes()], "rows": [group["row"].to_numpy(np.int64).tobytes()]})


FOUND = "block long, row long, query_id long, vec_id long, score long"


def _search(k: int):
    def search(blocks: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        """The best of one shard for each query of the blocks that visit it."""
        out = []
        tree = trees.iloc[0]
        all_points, ids = np.frombuffer(tree["points"], np.int64).reshape(tree["rows"], tree["width"]), np.frombuffer(tree["ids"], np.int64)
        nodes = np.frombuffer(tree["nodes"], np.int64).reshape(-1, 4).tolist()
        all_centres, radii = np.frombuffer(tree["centres"], np.float64).reshape(len(nodes), tree["width"]), np.frombuffer(tree["radii"], np.float64)
        for x in blocks.itertuples(index=False):
            queries = np.frombuffer(x.queries, np.int64).reshape(-1, x.q_width)
            width = min(tree["width"], x.q_width)
            real = queries[:, :width].astype(np.float64)
            ceilings = real @ all_centres[:, :width].T + np.sqrt((real**2).sum(axis=1))[:, None] * radii[None, :]
            ceilings = np.clip(ceilings + 1e-9 * np.abs(ceilings) + 1e-6, float(LOWEST), float(HIGHEST))
            points, queries = _exact(all_points[:, :width], queries[:, :width])
            floors = {} if x.floors is None else dict(x.floors)
            for row, q, v, c in zip(np.frombuffer(x.rows, np.int64).tolist(), np.frombuffer(x.q_ids, np.int64).tolist(), queries, ceilings):
                out += [(x.block, row, q, i, s) for s, i in search_tree(points, ids, nodes, c, v, q, floors.get(row), k)]
        return pd.DataFrame(out, columns=["block", "row", "query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by every, the k best other rows."""
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = vectors.filter(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    scaled = written(usable.withColumn("row", F.monotonically_increasing_id()), "scaled")
    n = scaled.count()
    shards = max(1, -(-n // shard_rows))
    trees = scaled.withColumn("shard", F.pmod(F.xxhash64("row", F.lit("shard")), F.lit(shards))).groupBy("shard").applyInPandas(_tree_of, "shard long, rows long, width long, points binary, ids binary, nodes binary, centres binary, radii binary")
    trees = written(trees, "trees")
    asked = scaled.filter(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // block_rows))
    packed = written(asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks))).groupBy("block").applyInPandas(_block_of, "block long, q_width long, queries binary, q_ids binary, rows binary"), "queries")
    found, done, wave = None, 0, 1
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    while done < shards:
        visits = packed.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(done), F.lit(min(shards, done + wave) - 1)), lambda i: (F.col("block") + i) % shards)))
        if found is None:
            visits = visits.withColumn("floors", F.lit(None).cast("map<long,long>"))
        else:
            # A query that has k rows carries the kth score; maps are of one block's queries.
            kth = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k)
            visits = visits.join(kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("row", "score"))).alias("floors")), "block", "left")
        visits = visits.withColumn("together", F.floor(F.col("block") / BLOCKS_TOGETHER))
        # Each tree goes once to the blocks that meet it together.
        meet = visits.select(F.col("shard").alias("s"), F.col("together").alias("g")).distinct().join(trees, F.col("s") == F.col("shard")).drop("shard")
        new = visits.groupBy("shard", "together").cogroup(meet.groupBy("s", "g")).applyInPandas(_search(k), FOUND)
        new = new if found is None else found.union(new)
        found = written(new.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).drop("nth"), "found")
        wave, done = (wave if not done else 2 * wave), done + wave
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
