"""Density clusters (HDBSCAN) over a neighbour graph: core distances, spanning forest, condensed tree, stable clusters.

Points and edges stay distributed throughout. The spanning forest of mutual reachability comes from Boruvka rounds. An edge
is a split if both of its sides hold ``least`` points or more when all larger edges are gone; whether a side does is found
from the ``least`` smallest edges around each point, by as many steps of growing from it. Splits alone shape the condensed
tree: what other edges join is one leaf of it. Only that tree, which has at most one row for ``least`` points, is put
together per group in a task; points then look up where they leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.semantic import unit
from quarry.operators.state import stored

#: Distances below this count as this, so that copies don't get endless density.
NEAREST = 1e-9


def distances(cosine: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors; rounded before the root, so that the order of summing doesn't show."""
    return np.sqrt(np.round(np.maximum(2 - 2 * cosine, 0), 12))


def neighbour_graph(vectors: DataFrame, group: str, k: int = 15, key: str = "vec_id", column: str = "embedding", block: int = 2048) -> DataFrame:
    """(group, a, b, d): the ``k`` nearest of every vector inside its group, ties to the smaller key. Exact.

    Groups are cut into blocks that meet pairwise in tasks of their own; a meeting compares strips of one with the other,
    takes what is as near as the k-th without sorting the rest, and returns the k nearest of each row, never pairs. Null or empty vectors, null keys and null groups take no part. A caller with a cheaper graph passes its own to
    ``clusters``.
    """
    v = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(group).isNotNull() & (F.size(column) > 0)).select(F.col(group).alias("g"), F.col(key).cast("long").alias("id"), unit(v).alias("v"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def meet(table):
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids, side = table.column("id").to_numpy()[order], table.column("own").to_numpy()[order]
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.nonzero(side == lo)[0], np.nonzero(side == hi)[0]
        out = []
        for rows_, others in [(left, right)] if lo == hi else [(left, right), (right, left)]:
            for n in range(0, len(rows_), 512):
                mine = rows_[n : n + 512]
                d = distances(x[mine] @ x[others].T)
                d[mine[:, None] == others[None, :]] = np.inf
                far = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                i, j = np.nonzero((d <= far[:, None]) & np.isfinite(d))
                near = np.lexsort((j, d[i, j], i))  # equal distances in the order of ids
                i, j = i[near], j[near]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                out.append((ids[mine[i]], ids[others[j]], d[i, j]))
        a, b, w = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(a), table.schema.field("g").type), "a": a, "b": b, "d": w})

    schema = f"g {rows.schema['g'].dataType.simpleString()}, a bigint, b bigint, d double"
    met = rows.select("g", "id", "v", "own", "lo", "hi").groupBy("g", "lo", "hi").applyInArrow(meet, schema)
    place = F.row_number().over(Window.partitionBy("g", "a").orderBy("d", "b"))
    return met.withColumn("place", place).where(F.col("place") <= k).select(F.col("g").alias(group), "a", "b", "d")


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) of pointers (node, up) whose only loops are pairs and single nodes: a pair's smaller node is its root."""
    back = parent.select(F.col("node").alias("up"), F.col("up").alias("back"))
    at = stored(parent.join(back, "up", "left").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up")))
    while True:
        step = at.select(F.col("node").alias("up"), F.col("up").alias("next"))
        at = stored(at.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("next"), "up"))
        if at.where("next <> up").isEmpty():
            return at.select("node", F.col("up").alias("root"))
        at = at.select("node", F.col("next").alias("up"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(w, a, b) of the least spanning forest of edges (w, a, b), a < b; equal weights in the order of a and b.

    A round every part takes its least edge, and parts that are joined become one; of parallel edges the least is kept. The
    number of parts at least halves, so there are as many rounds as the logarithm of the nodes.
    """
    live = stored(edges.where("a < b").groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("p"), F.col("b").alias("q"), F.struct("w", "a", "b").alias("e")))
    found = None
    while not live.isEmpty():
        ends = live.select("p", "q", "e").unionByName(live.select(F.col("q").alias("p"), F.col("p").alias("q"), "e"))
        least = stored(ends.groupBy("p").agg(F.min(F.struct("e", "q")).alias("m")).select(F.col("p").alias("node"), "m.q", "m.e"))
        took = least.select("e").distinct()
        found = took if found is None else found.unionByName(took)
        root = _roots(least.select("node", F.col("q").alias("up")))
        for end in ("p", "q"):
            live = live.join(root.withColumnsRenamed({"node": end, "root": f"{end}_"}), end)
        live = live.where("p_ <> q_").groupBy(F.least("p_", "q_").alias("p"), F.greatest("p_", "q_").alias("q")).agg(F.min("e").alias("e"))
        live = stored(live)
    return edges.select("w", "a", "b").limit(0) if found is None else found.select("e.w", "e.a", "e.b")


def joined(edges: DataFrame) -> DataFrame:
    """(node, root) of the parts that edges (a, b) join, root the smallest node; nodes without edges have no row."""
    live = stored(edges.select("a", "b").where("a <> b").distinct())
    out = None
    while not live.isEmpty():
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        root = _roots(up)
        out = root if out is None else out.join(root.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        out = stored(out)
        for end in ("a", "b"):
            live = live.join(root.withColumnsRenamed({"node": end, "root": f"{end}_"}), end)
        live = stored(live.select(F.col("a_").alias("a"), F.col("b_").alias("b")).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0) if out is None else out


def grown(forest: DataFrame, least: int) -> DataFrame:
    """(p, t): the largest edge (w, a, b) among the least ones by which p's part reaches ``least`` points; none for smaller trees.

    The part grows from p by its least edge outwards; of the edges around a point only the ``least`` smallest can be used.
    """
    both = forest.select(F.col("a").alias("m"), F.col("b").alias("v"), F.struct("w", "a", "b").alias("r")).unionByName(forest.select(F.col("b").alias("m"), F.col("a").alias("v"), F.struct("w", "a", "b").alias("r")))
    near = stored(both.withColumn("k", F.row_number().over(Window.partitionBy("m").orderBy("r"))).where(F.col("k") <= least).drop("k"))
    none = F.struct(F.lit(-1.0).alias("w"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    part = near.select(F.col("m").alias("p")).distinct().select("p", F.array("p").alias("members"), none.alias("t"))
    for _ in range(least - 1):
        out = part.select("*", F.explode("members").alias("m")).join(near, "m").where(~F.array_contains("members", F.col("v")))
        part = out.groupBy("p", "members", "t").agg(F.min(F.struct("r", "v")).alias("x")).select("p", F.array_append("members", F.col("x.v")).alias("members"), F.greatest("t", "x.r").alias("t"))
        part = stored(part)
    return part.select("p", "t")


def _tree(table: pa.Table) -> pa.Table:
    """The condensed tree of one group: for each leaf x the clusters it is part of, from itself to the root."""
    rows = sorted((r for r in table.to_pylist() if r["w"] is not None), key=lambda r: (r["w"], r["a"], r["b"]))
    leaves = sorted({r["x"] for r in table.to_pylist()} | {r["y"] for r in rows})
    up = {x: x for x in leaves}
    top = {x: str(x) for x in leaves}
    above: dict[str, tuple] = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in rows:
        x, y = find(r["x"]), find(r["y"])
        name = f"{r['a']}:{r['b']}"
        above[top[x]] = above[top[y]] = (name, r["w"], r["a"], r["b"])
        up[y], top[x] = x, name
    roots = len({find(x) for x in leaves})
    out: dict[str, list] = {c: [] for c in ("x", "cluster", "w", "a", "b", "parent", "birth", "single")}
    for x in leaves:
        cluster, since = str(x), (None, None, None)
        while cluster is not None:
            parent, *edge = above.get(cluster, (None, None, None, None))
            for c, value in zip(out, (x, cluster, *since, parent, edge[0], parent is None and roots == 1)):
                out[c].append(value)
            cluster, since = parent, tuple(edge)
    kinds = {"x": pa.int64(), "cluster": pa.string(), "w": pa.float64(), "a": pa.int64(), "b": pa.int64(), "parent": pa.string(), "birth": pa.float64(), "single": pa.bool_()}
    g = pa.array([table.column("g")[0].as_py()] * len(out["x"]), table.schema.field("g").type)
    return pa.table({"g": g} | {c: pa.array(v, kinds[c]) for c, v in out.items()})


def _choose(table: pa.Table) -> pa.Table:
    """Of one group's clusters those of most stability: a cluster stays if it is more stable than what is chosen below it."""
    rows = {r["cluster"]: r for r in table.to_pylist()}
    below: dict[str, list[str]] = {}
    for c, r in rows.items():
        if r["parent"] is not None:
            below.setdefault(r["parent"], []).append(c)
    order, stack = [], [c for c, r in rows.items() if r["parent"] is None]
    while stack:
        order.append(c := stack.pop())
        stack += below.get(c, [])
    points, best, own = {}, {}, {}
    for c in reversed(order):
        r, children = rows[c], below.get(c, [])
        under = sum(points[k] for k in children)
        points[c] = under + r["n"]
        birth = 0.0 if r["birth"] is None else 1 / max(r["birth"], NEAREST)
        stability = r["density"] - r["n"] * birth + (under * (1 / max(rows[children[0]]["birth"], NEAREST) - birth) if children else 0.0)
        rest = sum(best[k] for k in children)
        own[c] = not r["single"] and (not children or stability >= rest)
        best[c] = stability if own[c] else rest
    chosen: dict[str, str | None] = {}
    for c in order:
        parent = rows[c]["parent"]
        chosen[c] = chosen[parent] if parent is not None and chosen[parent] else c if own[c] else None
    return pa.table({"g": pa.array([r["g"] for r in rows.values()], table.schema.field("g").type), "cluster": pa.array(list(rows)), "chosen": pa.array([chosen[c] for c in rows], pa.string())})


def clusters(points: DataFrame, graph: DataFrame, group: str, key: str = "vec_id", least: int = 5, samples: int = 3) -> DataFrame:
    """Per point: group, key, cluster (the smallest key in it, null for noise), core (distance to the ``samples``-th nearest, itself counted).

    ``graph``: (group, a, b, d), the nearest neighbours of each point, ``samples`` - 1 at least. Parts of a group that the
    graph doesn't join are apart at any distance. A group's only part is no cluster itself, as with HDBSCAN's default;
    ``least`` is the fewest points of a cluster. Keys are unique. Points that the graph doesn't know are noise; empty in,
    empty out.
    """
    if least < 2 or samples < 1:
        raise ValueError("a cluster has two points at least, and a core distance counts the point itself")
    graph = stored(graph.select(F.col(group).alias("g"), "a", "b", "d"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    core = stored(graph.withColumn("k", place).where(F.col("k") <= samples - 1).groupBy("a").agg(F.max("d").alias("core")).select(F.col("a").alias("p"), "core") if samples > 1 else graph.select(F.col("a").alias("p"), F.lit(0.0).alias("core")).distinct())
    reach = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct()
    for end in ("a", "b"):
        reach = reach.join(core.withColumnsRenamed({"p": end, "core": f"core_{end}"}), end, "left")
    forest = stored(spanning_forest(reach.select(F.greatest("d", "core_a", "core_b").alias("w"), "a", "b")))
    of = stored(graph.select("g", F.col("a").alias("p")).unionByName(graph.select("g", F.col("b").alias("p"))).distinct())
    left = stored(grown(forest, least).join(of, "p"))
    rank = F.struct("w", "a", "b")
    edges = forest
    for end in ("a", "b"):
        edges = edges.join(left.select(F.col("p").alias(end), F.col("t").alias(f"t_{end}")), end)
    edges = stored(edges.withColumn("split", (F.col("t_a") < rank) & (F.col("t_b") < rank)).select("w", "a", "b", "split"))
    part = joined(edges.where("NOT split"))
    left = stored(left.join(part.withColumnRenamed("node", "p"), "p", "left").select("g", "p", "t", F.coalesce("root", "p").alias("x")))
    leaf = left.select("g", "x").distinct()
    splits = edges.where("split")
    for end, name in (("a", "x"), ("b", "y")):
        splits = splits.join(left.select(F.col("p").alias(end), F.col("x").alias(name), *(["g"] if end == "a" else [])), end)
    nodes = splits.select("g", "x", "y", "w", "a", "b").unionByName(leaf.select("g", "x", F.col("x").alias("y"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b")))
    schema = leaf.select("g").schema
    tree = stored(nodes.groupBy("g").applyInArrow(_tree, ", ".join([f"g {schema['g'].dataType.simpleString()}", "x bigint, cluster string, w double, a bigint, b bigint, parent string, birth double, single boolean"])))
    first = tree.where("w IS NULL").select("x", F.when(F.col("parent").isNotNull(), F.struct(F.col("birth").alias("w"), F.split("parent", ":")[0].cast("long").alias("a"), F.split("parent", ":")[1].cast("long").alias("b"))).alias("next"))
    at = left.join(first, "x").withColumn("inside", F.col("next").isNull() | (F.col("t") < F.col("next")))
    fringe = at.where("NOT inside").select("g", "p", "t", "x").join(tree.where("w IS NOT NULL").select("x", "cluster", F.struct("w", "a", "b").alias("since")), "x").where("since < t")
    fringe = fringe.groupBy("g", "p", "t").agg(F.max_by("cluster", "since").alias("cluster"))
    at = stored(at.where("inside").select("g", "p", "t", F.col("x").cast("string").alias("cluster")).unionByName(fringe))
    density = F.sum(1 / F.greatest(F.col("t.w"), F.lit(NEAREST)))
    sums = at.groupBy("cluster").agg(F.count("*").alias("n"), density.alias("density"))
    known = tree.select("g", "cluster", "parent", "birth", "single").distinct().join(sums, "cluster", "left").select("g", "cluster", "parent", "birth", "single", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("density", F.lit(0.0)).alias("density"))
    chosen = known.groupBy("g").applyInArrow(_choose, f"g {schema['g'].dataType.simpleString()}, cluster string, chosen string")
    mine = at.join(chosen.select("cluster", "chosen"), "cluster").where("chosen IS NOT NULL").select("p", "chosen")
    named = mine.join(mine.groupBy("chosen").agg(F.min("p").alias("name")), "chosen").select("p", "name")
    out = points.select(F.col(group).alias(group), F.col(key)).join(named.withColumnRenamed("p", key), key, "left").join(core.withColumnRenamed("p", key), key, "left")
    return out.select(group, key, F.col("name").alias("cluster"), "core")


def representatives(vectors: DataFrame, found: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(cluster, key, cosine, points): of each cluster the vector farthest from the cluster's direction, ties to the smaller key.

    Directions are sums of positions, so what travels is a number a dimension and cluster, never a cluster's vectors.
    """
    rows = vectors.join(found.where("cluster IS NOT NULL").select(key, "cluster"), key).select("cluster", key, unit(F.transform(column, lambda x: x.cast("double"))).alias("v"))
    mean = rows.select("cluster", F.posexplode("v").alias("k", "x")).groupBy("cluster", "k").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"))  # one number a dimension
    near = rows.join(centre.select("cluster", unit(F.col("c")).alias("c")), "cluster").select("cluster", key, F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z).alias("cosine"))
    best = near.groupBy("cluster").agg(F.min(F.struct(F.round("cosine", 9).alias("cosine"), key)).alias("m"), F.count("*").alias("points"))
    return best.select("cluster", f"m.{key}", "m.cosine", "points")
