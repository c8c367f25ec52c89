"""Exact top-k by inner product with MaxScore over blocks of vectors.

Every dimension is a term; a block of vectors holds for each term its values and their bounds. What a
term adds to a score is counted from the least that it can add, so no term takes anything away. Once
a query has ``k`` results, its terms of least weight whose bounds together cannot lift a vector over
the k-th score are non-essential. Only vectors in a posting of an essential term, where they add more
than the least, are traversed; the non-essential terms are probed, from the heaviest on, for those that
can still compete. The k-th score rises from step to step, so ever fewer terms are essential. The
shards' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.common import kept, small_batches

#: Vectors of a block, queries of a block, and vectors between two updates of a query's threshold.
BLOCK, QUERY_BLOCK, STEP = 8192, 2048, 1024
#: Non-essential terms that are probed between two tests of the vectors that are left.
PROBE = 8
LONG = np.iinfo(np.int64)


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as double; null where the vector is null or holds a null or
    non-finite component."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def essential_from(bounds: np.ndarray, room) -> int:
    """How many terms, of rising bounds with these running sums, are non-essential: together they add ``room`` at most."""
    return int(np.searchsorted(bounds, room, side="right"))


def maxscore(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and the ids and scores of its k best of the block, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    block, ids = block[order], ids[order]
    most = float(np.abs(block).max(initial=0).astype(float)) * float(np.abs(queries).max(initial=0).astype(float)) * max(1, block.shape[1])
    # doubles hold such integers exactly; scores that a long cannot hold are counted exactly and then held to its range
    kind = np.float64 if most < 2.0**52 else np.int64 if most < 2.0**62 else object
    block, queries = block.astype(kind), queries.astype(kind)
    low, high = block.min(axis=0, initial=LONG.max), block.max(axis=0, initial=LONG.min)
    for q, own in zip(queries, query_ids, strict=True):
        least, bound = np.minimum(q * low, q * high), np.abs(q * high - q * low)
        terms = np.argsort(bound, kind="stable")
        sums, base = np.cumsum(bound[terms]), least.sum()
        best_ids, best = np.zeros(0, dtype=ids.dtype), np.zeros(0, dtype=kind)
        for start in range(0, len(ids), STEP):
            at = np.arange(start, min(start + STEP, len(ids)))
            at = at[ids[at] != own]
            # an equal score can't enter any more: ids rise from step to step
            room = best.min() if len(best) == k else None
            done = 0 if room is None else essential_from(sums, room)
            essential = terms[done:]
            added = block[np.ix_(at, essential)] @ q[essential] - least[essential].sum()
            while room is not None:
                alive = added + (sums[done - 1] if done else 0) > room
                at, added = at[alive], added[alive]
                if not done or not len(at):
                    break
                take = terms[max(0, done - PROBE) : done]
                added = added + (block[np.ix_(at, take)] @ q[take] - least[take].sum())
                done -= len(take)
            best_ids, best = np.r_[best_ids, ids[at]], np.r_[best, added]
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        yield own, best_ids, np.clip(best + base, LONG.min, LONG.max).astype(np.int64) if kind is object else (best + base).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: each query's ``k`` highest inner products.

    ``is_query`` picks the queries. Vectors that are null or hold null or non-finite components, and
    rows without a key, take no part. Rows that repeat a key and vector count once; of one key's
    different vectors all are candidates and queries, and none meets another of its own key. Vectors
    of different lengths are filled up with zeros. Components and scores beyond a
    long's range are held to it.
    """
    small_batches(vectors.sparkSession)
    rows = kept(
        vectors.select(vectors[key].cast("long").alias("id"), quantised(vectors[vector]).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .filter("id is not null and v is not null").distinct()
    )
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0)).alias("q")).first()
    blocks, query_blocks = max(1, -(-size["n"] // BLOCK)), max(1, -(-size["q"] // QUERY_BLOCK))
    lane = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    pairs = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.filter("q").select("id", "v", lane(query_blocks, 1).alias("qb"), pairs(blocks).alias("vb"))
    right = rows.select("id", "v", lane(blocks, 2).alias("vb"), pairs(query_blocks).alias("qb"))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            width = max(queries["v"].map(len).max(), block["v"].map(len).max())
            q, b = matrix(queries["v"], width), matrix(block["v"], width)
            out = [pd.DataFrame({"query_id": own, "vec_id": i, "score": s}) for own, i, s in maxscore(q, queries["id"].to_numpy(), b, block["id"].to_numpy(), k)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
