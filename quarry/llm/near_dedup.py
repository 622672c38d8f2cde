"""Near duplicates among embeddings: iterative quantisation, multi-index Hamming tables, reranking by exact cosine.

Rotations that balance the variance over binary codes are learnt on a bounded sample; every vector is indexed. Codes
are cut into substrings, one table each; vectors of a label that share a substring of a table meet, and only pairs
whose cosine in double precision reaches the threshold link. Pairs are never written out: a bucket returns how many
links each vector has there, a pair counting in its first common table, and a spanning forest of them. Large buckets
are cut into blocks that meet pairwise in tasks of their own; equal vectors collapse into one before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, give_back, partitions
from quarry.llm.components import connected_components, hot_keys, look_up


def rotation(sample: np.ndarray, steps: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotated principal axes of unit vectors (rows), by alternating codes and the Procrustes rotation."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(len(centred), 1))
    p = centred @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(p.shape[1],) * 2))[0]
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
        r = (u @ w).T
    return mean, axes @ r


def tables_for(n: int, threshold: float, recall: float = 0.97) -> tuple[int, int]:
    """Bits of a substring, growing with the rows, and tables enough to meet ``recall`` for pairs at the threshold."""
    width = min(max(int(math.log2(max(n, 2))) - 8, 8), 24)
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(2, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", column: str = "embedding", label: str = "label", sample: int = 20_000, block: int = 1024) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Rows link if their labels are equal and not null and the cosine in double precision is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null
    key or vectors of unlike length. n_links counts the other rows linked directly, copies included; component_id is
    the smallest key reachable. ``sample`` bounds the rows on which the rotations are learnt, those of the most common
    length; vectors of other lengths get codes by random planes. Repeated rows count each; other columns are ignored.
    Empty in, empty out.
    """
    v = F.col(column)
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.when(usable, F.transform(v, lambda x: x.cast("double"))).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.unhex(F.md5(F.concat_ws("|", F.lit(""), F.col("label"), F.transform("v", lambda x: (x + 0.0).cast("string"))).cast("binary")))))
    distinct = cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("smallest")))
    n = distinct.count()
    few = distinct.withColumn("dim", F.size("v"))
    dim = few.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dims = [dim["dim"]] if dim else []
    width, tables = tables_for(n, threshold)
    models: dict[int, list] = {}
    for d in dims:
        got = few.where(F.col("dim") == d).orderBy(F.xxhash64("node"), "node").limit(sample).select("v").toPandas()
        x = np.array(got["v"].tolist()).reshape(len(got), d)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        models[d] = [rotation(x, seed=s) for s in range(math.ceil(tables * width / d))]

    def codes_of(x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if d not in models:  # vectors of a length that the sample did not have: random planes
            models[d] = [(np.zeros(d), np.random.default_rng(s).normal(size=(d, d))) for s in range(math.ceil(tables * width / d))]
        bits = np.concatenate([(x - m) @ a > 0 for m, a in models[d]], axis=1)[:, : tables * width].reshape(len(x), tables, width)
        return bits @ (1 << np.arange(width, dtype=np.int64))

    def encode(batches):
        for b in batches:
            t = b.column("v")
            size = np.diff(t.offsets.to_numpy())
            flat = t.flatten().to_numpy()
            start = np.cumsum(size) - size
            codes = np.zeros((len(t), tables), np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = flat[start[at][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)
                codes[at] = codes_of(x / np.linalg.norm(x, axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=[*b.schema.names, "codes"])
            give_back()

    coded = cut(distinct.select("node", "label", "v", "copies").mapInArrow(encode, "node binary, label string, v array<double>, copies long, codes array<long>"))
    keyed = coded.select("*", F.posexplode("codes").alias("t", "code")).withColumn("b", F.xxhash64("label", F.size("v"), "t", "code"))
    sizes = coded.select("label", F.size("v").alias("d"), F.posexplode("codes").alias("t", "code")).groupBy(F.xxhash64("label", "d", "t", "code").alias("b")).agg(F.count("*").alias("m")).where("m > 1")
    met = keyed.join(sizes, "b").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.select("node", "v", "copies", "codes", "t", "b", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    cells = max(partitions(vectors.sparkSession), math.ceil(n * tables / 20_000))
    met = met.withColumn("cell", F.pmod(F.xxhash64("b", "lo", "hi"), F.lit(cells)).cast("int"))

    def meet(table):
        count: dict[bytes, int] = {}
        ends: tuple[list, list] = [], []
        keys = np.column_stack([table.column(c).to_numpy() for c in ("b", "lo", "hi")])
        order = np.lexsort(keys.T[::-1])
        keys = keys[order]
        new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        nodes, weight = table.column("node").to_pylist(), table.column("copies").to_numpy()
        t, own = table.column("t").to_numpy(), table.column("own").to_numpy()
        codes = table.column("codes").combine_chunks()
        codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).flatten().to_numpy().reshape(len(nodes), -1)
        v = table.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        offsets, flat = v.offsets.to_numpy(), v.flatten().to_numpy()
        offsets = offsets - offsets[0]
        for a, z in zip(new, np.append(new[1:], len(order))):
            at = order[a:z]
            if len(at) < 2:
                continue
            d = offsets[at[0] + 1] - offsets[at[0]]
            x = flat[offsets[at][:, None] + np.arange(d)]
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            lo, hi = keys[a][1], keys[a][2]
            i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            if lo != hi:
                across = own[at[i]] != own[at[j]]
                i, j = i[across], j[across]
            if not len(i):
                continue
            level = int(t[at[0]])
            first = ~(codes[at[i], :level] == codes[at[j], :level]).any(1)
            got = np.bincount(i[first], weight[at[j[first]]], len(at)) + np.bincount(j[first], weight[at[i[first]]], len(at))
            for k in np.flatnonzero(got):
                count[nodes[at[k]]] = count.get(nodes[at[k]], 0) + int(got[k])
            tag = np.arange(len(at))
            while True:  # each takes the least tag among its neighbours
                before = tag.copy()
                np.minimum.at(tag, i, before[j])
                np.minimum.at(tag, j, before[i])
                tag = tag[tag]
                if (tag == before).all():
                    break
            for k in np.flatnonzero(tag != np.arange(len(at))):
                ends[0].append(nodes[at[k]]), ends[1].append(nodes[at[tag[k]]])
        a = [*count, *ends[0]]
        give_back()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array([None] * len(count) + ends[1], pa.binary()), "n": pa.array([*count.values(), *[0] * len(ends[0])], pa.int64())})

    found = cut(met.groupBy("cell").applyInArrow(meet, "a binary, b binary, n long"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = distinct.select("node", "copies", "smallest").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")).join(links, "node", "left")
    named = cut(named)
    least = cut(named.groupBy("label").agg(F.min("smallest").alias("component_id")))
    of = look_up(named, "label", least, hot_keys(named, "label", n)).select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    copied = hot_keys(distinct, "node", distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0], "copies")
    ids = rows.select("id", F.coalesce("node", F.unhex(F.hex(F.xxhash64("id")))).alias("node"))  # a key of its own, which finds nothing
    out = look_up(ids, "node", of, copied)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
