"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Each component is a list sorted by value, read from the end that a query's sign asks for. At a depth, what a list has
shown counts as it is; what it has not is bounded by the value last read from above and by the list's end from below.
Queries and candidates meet in blocks; a cell reads all lists to growing depths at once, with both bounds of all its
pairs as matrix products, stops where few candidates can still qualify, and resolves those exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of each list that are read before the stop rule is tried; at the last one all is shown and bounds are scores.
DEPTHS = (0.125, 0.25, 0.5, 0.75, 0.9, 1.0)


def survivors(queries: np.ndarray, items: np.ndarray, own: np.ndarray, k: int, depths=DEPTHS, few: float = 0.05) -> np.ndarray:
    """Which pairs can still be among a query's k best when the reading stops; ``own`` pairs never are.

    Bounds are widened by what rounding can have cost them, so values of any size lose nothing.
    """
    n = len(items)
    queries, items = (x / 2.0 ** np.frexp(np.abs(x).max(initial=1.0))[1] for x in (queries, items))  # exact, and no product overflows
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    slack = 4 * (queries.shape[1] + 2) * np.finfo(float).eps * np.abs(queries).sum(1, keepdims=True)  # items are at most 1
    alive = ~own
    lists = np.sort(items, axis=0)
    low, high = lists[0], lists[-1]
    for depth in depths if n > k else ():
        at = max(1, int(n * depth))
        top, bottom = lists[n - at], lists[at - 1]
        upper = plus @ np.maximum(items, top).T + minus @ np.minimum(items, bottom).T
        lower = plus @ np.where(items >= top, items, low).T + minus @ np.where(items <= bottom, items, high).T
        lower[own] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k]
        alive &= upper + slack >= bar[:, None] - slack
        if alive.mean() <= few:
            break
    return alive


def _exact(items: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles or longs where they hold them, else in integers of any size."""
    most = np.abs(items).max(initial=0.0) * np.abs(query).sum()
    if most < 2.0**53:
        return (items @ query).astype(np.int64)
    if most < 2.0**62:
        return items.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(row, q)) for row in items], object)


def search(queries: np.ndarray, qid: np.ndarray, items: np.ndarray, vid: np.ndarray, k: int, depths=DEPTHS, few: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query id, item id, score, score as a double) of each query's k best items of one cell, ties to smaller ids, its own id apart."""
    order = np.argsort(vid, kind="stable")
    items, vid = items[order], vid[order]
    alive = survivors(queries, items, qid[:, None] == vid[None, :], k, depths, few)
    ends = np.iinfo(np.int64)
    out = [], [], [], []
    for q in range(len(queries)):
        left = np.flatnonzero(alive[q])
        score = _exact(items[left], queries[q])
        if len(left) > k and score.dtype != object:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            left, score = left[keep], score[keep]
        best = sorted(range(len(left)), key=lambda i: -int(score[i]))[:k]  # stable, and items are in order of their ids
        out[0].append(np.full(len(best), qid[q])), out[1].append(vid[left[best]]), out[2].append(np.array([min(max(int(score[i]), ends.min), ends.max) for i in best], np.int64)), out[3].append(np.array([float(score[i]) for i in best]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: int = 256, query_block: int = 1024, item_block: int = 4096) -> DataFrame:
    """Per query its k best rows of ``vectors``: query_id, rank (from 1), vec_id, score.

    Components become floor(``scale`` * x); the score is the integer inner product, ties go to the smaller id, rows
    with the query's own id are no candidates. Scores are exact; those that a long can't hold are shown as its ends
    and ranked by their size in double precision, components beyond 1e150 as 1e150. Vectors that are null, empty or hold null or non-finite components and
    rows with null ids take no part; a query meets vectors of its own length only. Repeated rows are candidates each.
    Fewer than k candidates give fewer rows; empty tables give none.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(column)
        fine = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(fine).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))

    a, b = whole(queries), whole(vectors)
    na, nb = a.count(), b.count()
    qs, cs = max(1, math.ceil(na / query_block)), max(1, math.ceil(nb / item_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = a.withColumn("dim", F.size("v")).withColumn("qb", block(qs)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cs - 1))))
    right = b.withColumn("dim", F.size("v")).withColumn("cb", block(cs)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))

    def matrix(t):
        v = t.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        return np.clip(np.floor(x * scale), -1e150, 1e150)  # so that no score exceeds a double

    def cell(left, right):
        if not left.num_rows or not right.num_rows:
            q, i, s, f = (np.zeros(0, np.int64),) * 4
        else:
            q, i, s, f = search(matrix(left), left.column("id").to_numpy(), matrix(right), right.column("id").to_numpy(), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64()), "size": pa.array(f, pa.float64())})

    keys = ["dim", "qb", "cb"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long, size double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
