"""The nearest vectors of a label by cosine: blocks of queries meet shards of vectors as matrices, and only the nearest become rows.

The search is exact. A product of matrices tells which pairs may be among the nearest once their cosines are rounded; the cosines
of these are summed anew component by component, as SQL sums them.

Defined cases: vectors that are null, hold a null or are all zeros take no part, nor do rows without an id or label; vectors of different lengths meet
as if the shorter ended in zeros; a cosine that is no number counts as the greatest; a row never meets its own id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Vectors of one shard and queries of one block, on average: what a task holds at once. Queries of one product, vectors of one group of which the greatest is taken, and pairs summed at once.
SHARD_ROWS, BLOCK_ROWS, TOGETHER, GROUP, SUMMED = 16_384, 16_384, 256, 128, 100_000
#: Fixed value: the decimals of a cosine.
DECIMALS = 4
#: More than a product of unit vectors may be off, and lengths below or, inverted, above which it may be off by more.
OFF, ODD = 1e-11, 1e-100


def _matrix(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, ended in zeros, and their lengths."""
    lengths, out = vectors.map(len).to_numpy(), np.zeros((len(vectors), width))
    if (lengths == width).all():
        return np.stack(vectors.to_list()).astype(np.float64), lengths
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out, lengths


def _nearest(most: int):
    def nearest(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        """(query_id, vec_id, cosine) of those vectors of one shard that may be among the most nearest of each query of one block."""
        columns = ["query_id", "vec_id", "cosine"]
        if asked.empty or there.empty:
            return pd.DataFrame(columns=columns)
        there = there.sort_values("vec_id", kind="stable")
        width = max(asked["q_e"].map(len).max(), there["e"].map(len).max())
        (q, q_length), (c, c_length) = _matrix(asked["q_e"], width), _matrix(there["e"], width)
        q_norm, c_norm, q_id, c_id = (x.to_numpy() for x in (asked["q_norm"], there["norm"], asked["q_vec_id"], there["vec_id"]))
        q_odd, c_odd = (~((norm > ODD) & (norm < 1 / ODD)) for norm in (q_norm, c_norm))

        def summed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """The cosines of pairs, summed in the order of components."""
            out = np.empty(len(i))
            for lo in range(0, len(i), SUMMED):
                a, b = i[lo : lo + SUMMED], j[lo : lo + SUMMED]
                products = q[a] * c[b]
                products[np.arange(width) >= np.minimum(q_length[a], c_length[b])[:, None]] = 0.0
                out[lo : lo + SUMMED] = np.cumsum(products, axis=1)[:, -1] / (q_norm[a] * c_norm[b])
            return out

        found = []
        with np.errstate(all="ignore"):
            q_unit, c_unit = (np.where(odd[:, None], 0.0, x / norm[:, None]) for x, norm, odd in ((q, q_norm, q_odd), (c, c_norm, c_odd)))
            for lo in range(0, len(q), TOGETHER):
                score = q_unit[lo : lo + TOGETHER] @ c_unit.T
                i, j = np.nonzero(q_odd[lo : lo + TOGETHER, None] | c_odd)
                score[i, j] = np.nan_to_num(summed(i + lo, j), nan=np.inf, posinf=np.inf, neginf=-np.inf)
                score[q_id[lo : lo + TOGETHER, None] == c_id] = np.nan
                # The greatest of each group: of these, the one at place most is a bound from below.
                groups = len(c) // GROUP
                if groups >= most:
                    best = np.fmax.reduce(score[:, : groups * GROUP].reshape(len(score), groups, GROUP), axis=2)
                    floor = np.partition(np.where(np.isnan(best), -np.inf, best), -most, axis=1)[:, -most] - 10.0**-DECIMALS - 2 * OFF
                else:
                    floor = np.full(len(score), -np.inf)
                i, j = np.nonzero(score >= floor[:, None])
                low, high = (np.rint((score[i, j] + off) * 10**DECIMALS) for off in (-OFF, OFF))
                # By rounded cosine, equal ones by id: what is behind the place most may follow only where its rounding is open.
                order = np.lexsort((j, -low, i))
                i, j, low, high = i[order], j[order], low[order], high[order]
                first = np.searchsorted(i, np.arange(len(score)))
                nth = np.arange(len(i)) - first[i]
                last = np.full(len(score), -np.inf)
                last[i[nth == most - 1]] = low[nth == most - 1]
                kept = (nth < most) | (high > low) & (high >= last[i])
                i, j = i[kept] + lo, j[kept]
                found.append(pd.DataFrame({"query_id": q_id[i], "vec_id": c_id[j], "cosine": summed(i, j)}))
        return pd.concat(found)

    return nearest


def nearest_of_label(vectors: DataFrame, every: int, most: int, shard: int = SHARD_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, vec_id, cosine, place) of vectors (vec_id, label, embedding): of each row whose id is divisible by every the most nearest other rows of its label, equal ones by id."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("e"), norm.alias("norm")).filter("norm > 0 and vec_id is not null and label is not null")
    asks = F.col("vec_id") % every == 0
    sizes = unit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asks, 1)).alias("asked"))
    # Labels of more rows than a shard or block holds: one for so many rows at most.
    large = sizes.filter((F.col("n") > shard) | (F.col("asked") > block)).select("label", F.ceil(F.col("n") / shard).alias("shards"), F.ceil(F.col("asked") / block).alias("blocks"))
    sized = unit.join(F.broadcast(large), "label", "left").withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("shards", "blocks")})
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.col(n))
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    there = sized.select("label", own("shards").alias("shard"), all_("blocks").alias("block"), "vec_id", "e", "norm")
    asked = sized.filter(asks).select(F.col("label").alias("of"), all_("shards").alias("at"), own("blocks").alias("part"), *[F.col(c).alias(f"q_{c}") for c in ("vec_id", "e", "norm")])
    found = asked.groupBy("of", "at", "part").cogroup(there.groupBy("label", "shard", "block")).applyInPandas(_nearest(most), "query_id long, vec_id long, cosine double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    # What is no number comes out of pandas as a null.
    return found.withColumn("cosine", F.coalesce(F.round("cosine", DECIMALS), F.lit(float("nan")))).withColumn("place", place).filter(F.col("place") <= most)
