"""The scoring algebra over stored vectors, all in expressions: queries are vectors of stored ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Modulation:
    """What a query asks for. Ids name stored vectors, arrays are vectors themselves; their number is what the caller writes, so it is small."""

    centroid: Sequence[int | np.ndarray] = ()
    blend: int | np.ndarray | None = None
    suppress: Sequence[int | np.ndarray] = ()
    toward: tuple[int | np.ndarray, int | np.ndarray] | None = None
    half_life: float | None = None
    as_of: str | None = None
    dims: int | None = None
    threshold: float | None = None
    diverse: bool = False
    pool: int = 500
    limit: int = 10
    extra: dict = field(default_factory=dict)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it: a lambda's body repeats what it is made of."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(v: Column) -> Column:
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    return once(v, lambda w: once(norm(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def dot(v: Column, q: np.ndarray) -> Column:
    lit = F.array(*(F.lit(float(x)) for x in q))
    return F.aggregate(F.zip_with(v, lit, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def _normal(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x / n if n else x


def by_ids(vectors: DataFrame, ids: Sequence[int], key: str, column: str, dims: int | None) -> dict[int, np.ndarray]:
    rows = vectors.where(F.col(key).isin(list(ids))).select(key, column).collect() if ids else []  # as many as the query names
    return {r[0]: _normal(np.array(r[1], float)[: dims or None]) for r in rows}


def vec_ops(vectors: DataFrame, m: Modulation, scope: Column | DataFrame | None = None, key: str = "vec_id", column: str = "embedding", ts: str | None = None) -> DataFrame:
    """key, score and z of the best rows of a scope (a condition, or a table of keys); the query's own ids need not be in it.

    Raw cosine first (its background mean and deviation give _z), then trajectory, decay, suppression, threshold, and
    the top ``limit``, or for ``diverse`` a pool of three times as many reranked by maximal marginal relevance.
    """
    want = [x for x in (*m.centroid, m.blend, *m.suppress, *(m.toward or ())) if isinstance(x, (int, np.integer))]
    known = by_ids(vectors, want, key, column, m.dims)
    of = lambda x: known.get(x) if isinstance(x, (int, np.integer)) else _normal(np.asarray(x, float)[: m.dims or None])
    if lost := [x for x in want if x not in known and x not in m.centroid] or ([] if any(of(x) is not None for x in m.centroid) else list(m.centroid)):
        raise KeyError(f"no stored vector has the id {', '.join(map(str, lost))}")
    q = _normal(np.mean([v for x in m.centroid if (v := of(x)) is not None], axis=0))
    if m.blend is not None:
        q = _normal(0.5 * q + 0.5 * of(m.blend))
    rows = vectors if scope is None else vectors.join(scope.select(F.col(scope.columns[0]).alias(key)), key, "left_semi") if isinstance(scope, DataFrame) else vectors.where(scope)
    v = F.transform(column, lambda x: x.cast("double"))
    rows = rows.withColumn("_v", unit(F.slice(v, 1, m.dims) if m.dims else v)).withColumn("_raw", dot(F.col("_v"), q))
    stats = rows.agg(F.avg("_raw").alias("_mean"), F.stddev_pop("_raw").alias("_std"))
    score = F.col("_raw")
    if m.toward:
        a, b = (of(x) for x in m.toward)
        score = 0.5 * score + 0.5 * dot(F.col("_v"), _normal(b - a))
    if m.half_life and ts:
        days = F.greatest((F.lit(m.as_of).cast("timestamp").cast("double") - F.coalesce(F.col(ts).cast("timestamp").cast("double"), F.lit(0.0))) / 86400, F.lit(0.0))
        score = score * F.pow(F.lit(2.0), -days / m.half_life)
    for x in m.suppress:
        score = score - 0.5 * dot(F.col("_v"), of(x))
    out = rows.select(key, "_raw", score.alias("score"), *(["_v"] if m.diverse else []))
    if m.threshold is not None:
        out = out.where(F.col("score") >= m.threshold)
    size = 3 * m.limit if m.diverse else min(m.limit, m.pool)
    best = out.orderBy(F.desc("score"), key).limit(size)
    best = best.crossJoin(F.broadcast(stats)).withColumn("_z", F.when(F.col("_std") > 1e-9, (F.col("_raw") - F.col("_mean")) / F.col("_std")))
    if m.diverse:
        best = mmr(best, m.limit, key)
    return best.select(key, F.round("score", 4).alias("score"), F.round("_z", 4).alias("z"))


def mmr(pool: DataFrame, limit: int, key: str, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over a pool of bounded size; the score stays the true relevance."""
    spark = pool.sparkSession
    rows = pool.collect()  # 3 * limit at most
    s = np.array([r["score"] for r in rows])
    v = np.array([r["_v"] for r in rows]).reshape(len(rows), -1)
    span = s.max() - s.min() if len(s) else 0
    rel = (s - s.min()) / span if span > 0 else np.ones(len(s))
    chosen: list[int] = []
    left = list(range(len(rows)))
    while left and len(chosen) < limit:
        near = (v[left] @ v[chosen].T).max(1) if chosen else np.zeros(len(left))
        left = [k for k, c in zip(left, near) if c < 0.999999]
        near = near[near < 0.999999]
        if not left:
            break
        pick = left[int(np.argmax(trade * rel[left] - (1 - trade) * near))]
        chosen.append(pick)
        left.remove(pick)
    keep = [rows[k][key] for k in chosen]
    return pool.where(F.col(key).isin(keep)) if keep else spark.createDataFrame([], pool.schema)


def mean_pool(vectors: DataFrame, group: str, column: str = "embedding", weight: Column | None = None) -> DataFrame:
    """(group, position, value) of each group's normalised weighted mean; partial sums travel, not vectors."""
    w = F.lit(1.0) if weight is None else weight
    each = vectors.select(group, w.alias("_w"), F.posexplode(column).alias("position", "x"))
    mean = each.groupBy(group, "position").agg((F.sum(F.col("_w") * F.col("x").cast("double")) / F.sum("_w")).alias("m"))
    norm = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, group).select(group, "position", F.round(F.col("m") / F.col("norm"), 6).alias("value"))


def scores(vectors: DataFrame, centroid: Sequence[int], wanted: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and score of just the ``wanted`` keys (a few): the semi-join comes before anything is computed, and nothing is sorted."""
    known = by_ids(vectors, centroid, key, column, None)
    q = _normal(np.mean([known[i] for i in centroid if i in known], axis=0))
    v = F.transform(column, lambda x: x.cast("double"))
    return vectors.join(wanted, key, "left_semi").select(key, F.round(dot(unit(v), q), 4).alias("score"))


def weighted_pool(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """(group, position, value) of means weighted by how far a vector is from the corpus: 1 - cosine to the centroid, from 0.05 to 2."""
    v = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.select(group, unit(v).alias("_v"))
    mean = rows.select(F.posexplode("_v").alias("position", "x")).groupBy("position").agg(F.avg("x").alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "m"))), lambda p: p["m"]).alias("_c"))  # one number a dimension
    rows = rows.crossJoin(F.broadcast(centre.select(unit(F.col("_c")).alias("_c"))))
    weight = F.least(F.greatest(1 - F.aggregate(F.zip_with("_v", "_c", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z), F.lit(0.05)), F.lit(2.0))
    return mean_pool(rows.withColumn("_weight", weight), group, "_v", F.col("_weight"))


def sources_by_rank(found: DataFrame, source: Column, key: str = "vec_id") -> DataFrame:
    """source, place (from 1) and score of the distinct sources of ranked rows, by their best row."""
    best = found.groupBy(source.alias("source")).agg(F.max("score").alias("score"), F.min(key).alias("_k"))
    return best.select("source", F.row_number().over(Window.orderBy(F.desc("score"), "source")).alias("place"), "score")  # a bounded pool


def source_vectors(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """(group, column) of each group's unit mean vector, for searches over sources rather than chunks; a number a dimension and group is gathered."""
    pooled = mean_pool(vectors.where(F.col(group).isNotNull()), group, column)
    return pooled.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias(column))
