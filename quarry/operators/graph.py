"""Trees and graphs: frontiers, rank, similarity edges, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.semantic import unit
from quarry.operators.state import stored, swept

#: Rows of a block of vectors at most, blocks of a group that are made without need, rows that compare at a time.
LARGEST, MEETING, STRIP = 16_384, 8, 512
#: Of graphs that are walked but not written: rows for which a group gets one more block, blocks of a group that are made without need, vectors of a community that stay in one block, weights that a task holds at a time.
ROOM, FEW, WIDE, HELD = 2048, 4, 4096, 1 << 20


def descend(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", most: int = 64) -> DataFrame:
    """node and its least depth below ``roots`` (column node): one join a level, nodes seen before are left out."""
    seen = frontier = roots.select(F.col("node"), F.lit(0).alias("depth")).distinct()
    for depth in range(1, most + 1):
        step = frontier.join(edges, frontier["node"] == edges[parent]).select(F.col(child).alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = step.persist()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def pagerank(edges: DataFrame, alpha: float = 0.85, steps: int = 20, source: str = "source", target: str = "target", weight: str = "weight") -> DataFrame:
    """node and rank of an undirected weighted graph by power iteration; ranks sum to 1."""
    both = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.col(weight).cast("double").alias("w")).persist()
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    out = both.groupBy("a").agg(F.sum("w").alias("total"))
    share = both.join(out, "a").select("a", "b", (F.col("w") / F.col("total")).alias("p")).persist()
    n = out.count()
    rank = out.select(F.col("a").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(steps):
        got = share.join(rank, share["a"] == rank["node"]).groupBy("b").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        rank = got.select(F.col("b").alias("node"), ((1 - alpha) / n + alpha * F.col("got")).alias("rank"))
    return rank


def similar_rank(vectors: DataFrame, threshold: float, alpha: float = 0.85, steps: int = 20, key: str = "vec_id", column: str = "embedding", block: str | None = None) -> DataFrame:
    """``pagerank`` of the graph that ``similar`` gives, whose edges are worked out in every step and never written."""
    with swept(vectors.sparkSession):
        graph = _Near(_centred(vectors, key, column, block), threshold)
        total = stored(graph.degree())
        n = total.count()
        rank = total.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
        for _ in range(steps):
            got = graph.times(rank.join(total, "node").select("node", (F.col("rank") / F.col("k")).alias("x")))
            rank = stored(got.select("node", ((1 - alpha) / max(n, 1) + alpha * F.col("got")).alias("rank")))
    return rank


def _centred(vectors: DataFrame, key: str, column: str, block: str | None) -> DataFrame:
    """(id, g, v): unit vectors less their mean, as unit vectors again; vectors that are null or of another length take no part."""
    dims = vectors.agg(F.mode(F.when(F.size(column) > 0, F.size(column)))).first()[0] or 0
    rows = vectors.where(F.size(column) == dims).select(F.col(key).alias("id"), F.col(block).alias("g") if block else F.lit(0).alias("g"), unit(F.transform(column, lambda x: x.cast("double"))).alias("v"))
    mean = rows.agg(F.array(*(F.avg(F.element_at("v", k + 1)) for k in range(dims))).cast("array<double>").alias("m"))
    return rows.crossJoin(F.broadcast(mean)).select("id", "g", unit(F.zip_with("v", "m", lambda a, b: a - b)).alias("v")).where("id IS NOT NULL AND g IS NOT NULL")  # one row of means


def _pairs(rows: DataFrame, least: float, block: int) -> DataFrame:
    """source, target, weight of all pairs of unit vectors (id, g, v) in one group g whose inner product reaches ``least``.

    A group is cut into blocks, which meet pairwise in tasks of their own: at least ``block`` rows each as long as there are
    fewer than MEETING blocks, LARGEST at most. A meeting compares strips by products of floats and works out in doubles what
    they let through; it keeps a strip in memory, never its pairs. Rows travel once for each block of their group.
    """
    counts = rows.groupBy("g").agg(F.count("*").alias("n"))
    blocks = counts.select("g", F.greatest(F.ceil(F.col("n") / LARGEST), F.least(F.ceil(F.col("n") / block), F.lit(MEETING))).cast("int").alias("blocks"))
    own = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", "id", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, side = table.column("id").combine_chunks(), table.column("own").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        short, margin = x.astype(np.float32), 1e-6 + 2e-7 * x.shape[1]  # what floats may be off by
        left, right = np.nonzero(side == lo)[0], np.nonzero(side == hi)[0]
        for k in range(0, len(left), STRIP):
            strip = left[k : k + STRIP]
            i, j = np.nonzero(~(short[strip] @ short[right].T < least - margin))
            i, j = strip[i], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            for n in range(0, len(i), 50_000):
                a, b = i[n : n + 50_000], j[n : n + 50_000]
                w = np.einsum("ij,ij->i", x[a], x[b])
                keep = ~(w < least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[keep])), ids.take(pa.array(b[keep])), pa.array(w[keep])], ["a", "b", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    met = own.groupBy("g", "lo", "hi").applyInArrow(meet, f"a {kind}, b {kind}, weight double")
    return met.where("a <> b").select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "weight")


def similar(vectors: DataFrame, threshold: float, key: str = "vec_id", column: str = "embedding", block: str | None = None) -> DataFrame:
    """source, target, weight of pairs whose centred cosine, to four places, reaches ``threshold``, inside ``block`` if it is given."""
    pairs = _pairs(_centred(vectors, key, column, block), threshold - 6e-5, 1024)
    return pairs.select("source", "target", F.round("weight", 4).alias("weight")).where(F.col("weight") >= threshold)


def defects(tree: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Rows (id, defect) of a tree table: duplicate, self_parent or missing_parent."""
    twice = tree.groupBy(node).count().where("count > 1").select(node, F.lit("duplicate").alias("defect"))
    own = tree.where(F.col(node) == F.col(parent)).select(node, F.lit("self_parent").alias("defect"))
    known = tree.select(F.col(node).alias(parent)).distinct()
    lost = tree.where(F.col(parent).isNotNull()).join(known, parent, "left_anti").select(node, F.lit("missing_parent").alias("defect"))
    return twice.unionByName(own).unionByName(lost)


def hub_types(links: DataFrame, ratio: float = 1.5) -> DataFrame:
    """node and hub_type: authority (ratio times more links in than out), connector (the other way round) or balanced."""
    out = links.groupBy(F.col("source").alias("node")).agg(F.countDistinct("target").alias("o"))
    into = links.groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("i"))
    both = out.join(into, "node", "full_outer").select("node", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    return both.select("node", F.when(F.col("i") > ratio * F.col("o"), "authority").when(F.col("o") > ratio * F.col("i"), "connector").otherwise("balanced").alias("hub_type"))


def combine(semantic: DataFrame, links: DataFrame) -> DataFrame:
    """source, target, weight (the larger one) and origin (semantic, link or both) of two sets of edges."""
    marked = semantic.select("source", "target", "weight", F.lit(1).alias("m")).unionByName(links.select("source", "target", "weight", F.lit(2).alias("m")))
    each = marked.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.bit_or("m").alias("m"))
    return each.select("source", "target", "weight", F.when(F.col("m") == 3, "both").when(F.col("m") == 1, "semantic").otherwise("link").alias("origin"))


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """node and community by weighted label propagation: each takes the label of most weight around it, itself counted once.

    Ties go to the smallest label. A round is a join and two aggregates of at most as many rows as edges.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight").unionByName(edges.select("target", "source", "weight").toDF("a", "b", "weight"))
    own = both.groupBy("a").agg(F.max("weight").alias("weight")).select("a", F.col("a").alias("b"), "weight")
    all_ = both.unionByName(own)
    label = own.select(F.col("a").alias("node"), F.col("a").alias("community"))
    for _ in range(rounds):
        votes = all_.join(label, all_["b"] == label["node"]).groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("community"))).alias("x"))
        label = _settled(best.select(F.col("a").alias("node"), F.col("x.community").alias("community")))
    return label


def betweenness(edges: DataFrame, sources: int = 100) -> DataFrame:
    """node and betweenness of an undirected graph without weights, from ``sources`` starts (all, if fewer; scaled up).

    Starts are the nodes that hash lowest. Frontiers of all starts advance together, a join with the edges a level, then
    dependencies flow back level by level; there are at most ``sources`` rows a node, and nothing is shipped whole.
    """
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    near = stored(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = stored(near.select(F.col("a").alias("node")).distinct())
    n = nodes.count()
    starts = nodes.orderBy(F.xxhash64("node"), "node").limit(sources).select(F.col("node").alias("s"))  # bounded by `sources`
    level = stored(starts.select("s", F.col("s").alias("v"), F.lit(1.0).alias("ways")))
    levels, seen = [level], level.select("s", "v")
    while True:
        step = level.join(near, level["v"] == near["a"]).groupBy("s", F.col("b").alias("v")).agg(F.sum("ways").alias("ways"))
        level = stored(step.join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
    flow = None  # (s, v, share) of the level that was last left
    total = None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].select("s", F.col("v").alias("w"), F.col("ways").alias("ways_w"))
        own = here.withColumn("share", F.lit(0.0)) if flow is None else here.join(flow.withColumnRenamed("v", "w"), ["s", "w"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        part = own.select("w", "share")
        total = part if total is None else total.unionByName(part)
        up = own.join(near, own["w"] == near["a"]).select("s", F.col("b").alias("v"), "ways_w", "share").join(levels[k - 1], ["s", "v"])
        flow = stored(up.groupBy("s", "v").agg(F.sum(F.col("ways") / F.col("ways_w") * (1 + F.col("share"))).alias("share")))
    scale = n / max(min(sources, n), 1) / 2  # each pair is met from both ends
    sums = nodes.select("node", F.lit(0.0).alias("x"))
    if total is not None:
        sums = sums.unionByName(total.select(F.col("w").alias("node"), F.col("share").alias("x")))
    return sums.groupBy("node").agg((F.sum("x") * scale).alias("betweenness"))


def bridges(edges: DataFrame, share: float = 0.05, sources: int = 100) -> DataFrame:
    """The nodes of most betweenness, ``share`` of all but one at least; ties to the smaller node."""
    found = stored(betweenness(edges, sources))
    return found.orderBy(F.desc(F.round("betweenness", 9)), "node").limit(max(1, int(found.count() * share)))


def modularity(edges: DataFrame, community: DataFrame) -> float:
    """Of communities (node, community) in an undirected graph (source, target, weight)."""
    return _quality(_symmetric(edges), community.select("node", "community"))


def _symmetric(edges: DataFrame) -> DataFrame:
    """(a, b, w): each edge both ways; a loop counts twice at its node."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").cast("double").alias("w"))
    both = e.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))  # the edges are worked out once
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def _quality(both: DataFrame, label: DataFrame) -> float:
    of = lambda end: label.select(F.col("node").alias(end), F.col("community").alias(f"c{end}"))
    named = both.join(of("a"), "a").join(of("b"), "b")
    each = named.groupBy("ca").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    inside, squares, m = each.agg(F.sum("inside"), F.sum(F.col("all") * F.col("all")), F.sum("all")).first()
    return 0.0 if not m else inside / m - squares / (m * m)


class _Edges:
    """A graph whose edges are rows (a, b, w), each both ways."""

    def __init__(self, both: DataFrame):
        self.both = both

    def degree(self) -> DataFrame:
        return self.both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))

    def ties(self, own: DataFrame, size: DataFrame, m: float) -> DataFrame:
        """node, to and the weight w between a node and a community."""
        return self.both.where("a <> b").join(own.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), F.col("community").alias("to")).agg(F.sum("w").alias("w"))

    def quality(self, own: DataFrame, size: DataFrame, ties: DataFrame, m: float) -> float:
        return _quality(self.both, own.select("node", "community"))

    def folded(self, label: DataFrame) -> DataFrame:
        of = lambda end: label.select(F.col("node").alias(end), F.col("community").alias(f"{end}_"))
        return self.both.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("a_").alias("a"), F.col("b_").alias("b")).agg(F.sum("w").alias("w"))


def _block(rows: pa.Table, names: np.ndarray) -> SimpleNamespace:
    """One block's vectors x, by community and node; at: the node of each. Of each node: ids, loc (its community, counted in this block) and the other columns. coms: the block's communities, as places in ``names``."""
    com = np.searchsorted(names, rows.column("c").to_numpy())
    node = np.unique(rows.column("id").to_numpy(), return_inverse=True)[1]
    order = np.lexsort((node, com))
    first = np.concatenate([[True], node[order][1:] != node[order][:-1]])[: len(order)]
    heads = rows.take(pa.array(order[first]))
    coms, loc = np.unique(com[order[first]], return_inverse=True)
    x = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)[order]
    return SimpleNamespace(x=x, at=np.cumsum(first) - 1, ids=heads.column("id").combine_chunks(), coms=coms, loc=loc, **{k: heads.column(k).to_numpy() for k in {"x_", "k", "members"} & set(heads.column_names)})


def _edges(a: SimpleNamespace, b: SimpleNamespace, least: float, held: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The edges between two blocks, or of one both ways, for some whole nodes of ``a`` at a time: the first node, the one behind the last, and of each edge its node in a, that in b and the weight to four places."""
    start = 0
    while start < len(a.at) and len(b.at):
        end = int(np.searchsorted(a.at, a.at[min(start + max(1, held // len(b.at)), len(a.at)) - 1], "right"))
        w = (a.x[start:end] @ b.x.T).ravel()
        found = np.flatnonzero(~(w < least - 6e-5))
        i, j = np.divmod(found, len(b.at))
        i, j, w = a.at[start + i], b.at[j], np.round(w[found], 4)
        keep = ~(w < least)
        if a is b:
            keep &= i != j
        yield int(a.at[start]), int(a.at[end - 1]) + 1, i[keep], j[keep], w[keep]
        start = end


def _summed(at: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, w, n).astype(np.float64, copy=False)  # of no weights it makes integers


class _Sums:
    """Sums by community of a block and by column, as strips of its nodes come; a community is given out with its last strip."""

    def __init__(self, block: SimpleNamespace, width: int):
        self.block, self.width, self.open = block, width, None

    def add(self, first: int, last: int, i: np.ndarray, column: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Community (its place in names), column and sum."""
        loc = self.block.loc
        low, high = loc[first], loc[last - 1] + 1
        sums = _summed((loc[i] - low) * self.width + column, w, (high - low) * self.width).reshape(-1, self.width)
        if self.open is not None:
            sums[0] += self.open
        self.open = None
        if last < len(loc) and loc[last] == high - 1:
            self.open, sums = sums[-1].copy(), sums[:-1]
        found = np.flatnonzero(sums)
        row, column = np.divmod(found, self.width)
        return self.block.coms[low + row], column, sums.ravel()[found]


class _Best:
    """Of the communities offered to each node of a block the one that gains most, to nine places; the smallest of equals, as offers come by rising community."""

    def __init__(self, block: SimpleNamespace, coms: SimpleNamespace, m: float):
        self.block, self.coms, self.m, n = block, coms, m, len(block.loc)
        self.gain, self.to, self.w = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n)

    def offer(self, node: np.ndarray, com: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What this block can't choose from is given back: weights to wide communities, and those to the node's own."""
        block, coms = self.block, self.coms
        own = block.coms[block.loc[node]]
        back = coms.wide[com] | (com == own)
        free = ~back & ~((block.members[node] == 1) & (coms.members[com] == 1) & (com > own))
        n, c, x = node[free], com[free], w[free]
        gain = np.rint((x - block.k[n] * coms.total[c] / self.m) * 1e9)
        now = self.gain.copy()
        np.maximum.at(now, n, gain)
        top = (gain == now[n]) & (gain > self.gain[n])
        n, c, x = n[top], c[top], x[top]
        self.to[n] = len(coms.total)
        np.minimum.at(self.to, n, c)
        chosen = c == self.to[n]
        self.w[n[chosen]] = x[chosen]
        self.gain = now
        return node[back], com[back], w[back]


class _Near:
    """The graph of unit vectors (id, g, v) that ``similar`` would give, worked out anew whenever it is walked.

    Edges grow with the square of a group and are never rows: blocks of a group meet in tasks of their own, which keep a strip
    of weights in memory and give sums by node. A vector travels once for each block of its group, FEW in a group of up to
    FEW * LARGEST vectors. Vectors of one community share a block, so that a task knows all of a node's weight to it and
    sends the best alone; the weights to communities of more than WIDE vectors are sent in parts.
    """

    def __init__(self, rows: DataFrame, threshold: float):
        self.rows, self.least = stored(rows), threshold
        n = F.count("*")
        self.blocks = stored(self.rows.groupBy("g").agg(F.greatest(F.ceil(n / LARGEST), F.least(F.ceil(n / ROOM), F.lit(FEW))).cast("int").alias("blocks")))
        self.nodes = stored(self.rows.groupBy("id").agg(n.alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1")))

    def _met(self, named: DataFrame, visit: Callable[[SimpleNamespace, SimpleNamespace, np.ndarray, SimpleNamespace], Iterator[tuple[pa.Array, ...]]], schema: str) -> DataFrame:
        """What ``visit`` makes of each two blocks that meet. named: id, c (its community), pieces (blocks that c is dealt over) and more columns."""
        rows = self.rows.join(named, "id").join(self.blocks, "g")
        rows = rows.withColumn("own", F.pmod(F.pmod(F.xxhash64("c"), "blocks") + F.pmod(F.xxhash64("id"), "pieces"), "blocks").cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks", "pieces")
        columns = [x.split()[0] for x in schema.split(", ")]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches)).combine_chunks()
            names, first = np.unique(table.column("c").to_numpy(), return_index=True)
            of = table.take(pa.array(first))
            coms = SimpleNamespace(**{k: of.column(k).to_numpy() for k in {"total", "members", "wide"} & set(of.column_names)})
            side, lo, hi = table.column("own").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            a = _block(table.filter(pa.array(side == lo)), names)
            b = a if lo == hi else _block(table.filter(pa.array(side == hi)), names)
            kind = table.schema.field("c").type
            for out in visit(a, b, names, coms):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, None if x.dtype == np.float64 else kind) for x in out], columns)

        return rows.groupBy("g", "lo", "hi").applyInArrow(meet, schema)

    @property
    def kind(self) -> str:
        return self.rows.schema["id"].dataType.simpleString()

    def times(self, x: DataFrame) -> DataFrame:
        """node and got, the sum over its edges of their weight times x (node, x) at the other end."""
        least, held = self.least, HELD

        def visit(a, b, names, coms):
            left, right = np.zeros(len(a.loc)), np.zeros(len(b.loc))
            for _, _, i, j, w in _edges(a, b, least, held):
                left += _summed(i, w * b.x_[j], len(left))
                if a is not b:
                    right += _summed(j, w * a.x_[i], len(right))
            yield a.ids, left
            if a is not b:
                yield b.ids, right

        named = x.select(F.col("node").alias("id"), F.col("node").alias("c"), F.lit(1).alias("pieces"), F.col("x").alias("x_"))
        return self._met(named, visit, f"node {self.kind}, got double").groupBy("node").agg(F.sum("got").alias("got"))

    def degree(self) -> DataFrame:
        """node and k, the sum of its weights, of nodes with edges."""
        return self.times(self.nodes.select(F.col("id").alias("node"), F.lit(1.0).alias("x"))).where("got > 0").select("node", F.col("got").alias("k"))

    def _named(self, own: DataFrame, size: DataFrame) -> DataFrame:
        """id, c, k, and of c: total, members, pieces, wide."""
        each = own.select(F.col("node").alias("id"), F.col("community").alias("c"), "k").join(self.nodes, "id")
        dealt = each.groupBy("c").agg(F.ceil(F.sum("n") / WIDE).alias("pieces"), (F.min("g0") < F.max("g1")).alias("apart"))
        of = dealt.join(size.withColumnRenamed("community", "c"), "c").withColumn("wide", (F.col("pieces") > 1) | F.col("apart"))
        return each.select("id", "c", "k").join(of.drop("apart"), "c")

    def ties(self, own: DataFrame, size: DataFrame, m: float) -> DataFrame:
        """node, to and the weight w between a node and a community: its own, the wide ones (in parts) and of the others of a block the best."""
        least, held = self.least, HELD

        def visit(a, b, names, coms):
            best = [_Best(a, coms, m)] + [_Best(b, coms, m)] * (a is not b)
            across = _Sums(a, len(b.loc))
            for first, last, i, j, w in _edges(a, b, least, held):
                width = len(b.coms)
                sums = _summed((i - first) * width + b.loc[j], w, (last - first) * width)
                found = np.flatnonzero(sums)
                node, c = np.divmod(found, width)
                node, c, w_ = best[0].offer(first + node, b.coms[c], sums[found])
                yield a.ids.take(pa.array(node)), names[c], w_
                if a is not b:
                    c, node, w_ = across.add(first, last, i, j, w)
                    node, c, w_ = best[1].offer(node, c, w_)
                    yield b.ids.take(pa.array(node)), names[c], w_
            for x in best:
                found = np.flatnonzero(x.gain > -np.inf)
                yield x.block.ids.take(pa.array(found)), names[x.to[found]], x.w[found]

        return stored(self._met(self._named(own, size), visit, f"node {self.kind}, to {self.kind}, w double"))

    def quality(self, own: DataFrame, size: DataFrame, ties: DataFrame, m: float) -> float:
        inside = ties.join(own.select("node", "community"), "node").where("to = community").agg(F.sum("w")).first()[0]
        return (inside or 0.0) / m - size.agg(F.sum(F.col("total") * F.col("total"))).first()[0] / (m * m)

    def folded(self, label: DataFrame) -> DataFrame:
        least, held = self.least, HELD

        def visit(a, b, names, coms):
            sums = _Sums(a, len(b.coms))
            for first, last, i, j, w in _edges(a, b, least, held):
                c, to, w_ = sums.add(first, last, i, b.loc[j], w)
                yield names[c], names[b.coms[to]], w_
                if a is not b:
                    yield names[b.coms[to]], names[c], w_

        own = label.withColumn("k", F.lit(0.0))
        named = self._named(own, own.select("community").distinct()).drop("k", "wide")
        return self._met(named, visit, f"a {self.kind}, b {self.kind}, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))


def louvain(edges: DataFrame, rounds: int = 10, levels: int = 10, seed: int = 42) -> DataFrame:
    """node and community by modularity: rounds of moves, then communities become nodes, until nothing is gained.

    In a round half of the nodes, drawn by hash, move to the neighbouring community that raises modularity most (ties to the
    smaller); a lone node moves only to a smaller lone one, so that pairs don't swap. Moves are made at once, so a round
    that loses modularity is undone; two such rounds end a level. A community is named by its smallest node.
    """
    with swept(edges.sparkSession):
        return _louvain(_Edges(stored(_symmetric(edges))), rounds, levels, seed)


def similar_louvain(vectors: DataFrame, threshold: float, rounds: int = 10, levels: int = 10, seed: int = 42, key: str = "vec_id", column: str = "embedding", block: str | None = None) -> DataFrame:
    """``louvain`` of the graph that ``similar`` gives, whose edges are worked out in every round and never written; only those between the first level's communities are rows."""
    with swept(vectors.sparkSession):
        return _louvain(_Near(_centred(vectors, key, column, block), threshold), rounds, levels, seed)


def _louvain(graph: _Edges | _Near, rounds: int, levels: int, seed: int) -> DataFrame:
    final = best = None
    for _ in range(levels):
        degree = stored(graph.degree())
        label = stored(degree.select("node", F.col("node").alias("community")))
        final = label if final is None else final
        m = degree.agg(F.sum("k")).first()[0]
        if not m:
            break

        def sized(label, degree=degree):
            own = label.join(degree, "node").select("node", "community", "k")
            return own, own.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("members"))

        own, size = sized(label)
        ties = graph.ties(own, size, m)
        best = graph.quality(own, size, ties, m) if best is None else best
        start, idle = best, 0
        for r in range(rounds):
            all_ = ties.unionByName(own.select("node", F.col("community").alias("to"), F.lit(0.0).alias("w"))).groupBy("node", "to").agg(F.sum("w").alias("w"))
            each = all_.join(own, "node").join(size.select(F.col("community").alias("to"), "total", F.col("members").alias("there")), "to").join(size.select("community", F.col("members").alias("here")), "community")
            stays = F.col("to") == F.col("community")
            gain = F.col("w") - F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / m
            lone = (F.col("here") == 1) & (F.col("there") == 1) & ~stays & (F.col("to") > F.col("community"))
            each = each.withColumn("gain", F.round(gain, 9)).where(~lone)
            choice = each.groupBy("node", "community").agg(F.min(F.struct((-F.col("gain")).alias("loss"), (~stays).alias("moves"), F.col("to"))).alias("x"))
            free = F.pmod(F.xxhash64("node", F.lit(seed + r)), F.lit(2)) == 0
            moved = stored(choice.select("node", F.when(free, F.col("x.to")).otherwise(F.col("community")).alias("community"), (free & F.col("x.moves")).alias("_moved")))
            quality = best
            if not moved.where("_moved").isEmpty():
                new, new_size = sized(moved.select("node", "community"))
                new_ties = graph.ties(new, new_size, m)
                quality = graph.quality(new, new_size, new_ties, m)
            if quality > best + 1e-12:
                best, label, idle = quality, moved.select("node", "community"), 0
                own, size, ties = new, new_size, new_ties
            else:
                idle += 1
                if idle == 2:
                    break
        if best <= start + 1e-12:
            break
        name = label.groupBy("community").agg(F.min("node").alias("name"))
        label = stored(label.join(name, "community").select("node", F.col("name").alias("community")))
        final = stored(final.select("node", F.col("community").alias("c")).join(label.select(F.col("node").alias("c"), "community"), "c").select("node", "community"))
        graph = _Edges(stored(graph.folded(label)))
    return final


def _settled(df: DataFrame) -> DataFrame:
    from quarry.operators.walks import _cut

    return _cut(df)


def similar_all(vectors: DataFrame, threshold: float, top: int | None = None, key: str = "vec_id", column: str = "embedding", block: int = 1024) -> DataFrame:
    """source, target, weight of all pairs whose centred cosine reaches ``threshold``; with ``top`` the best of each node.

    Vectors meet in blocks (of ``block`` rows or more) that compare by matrix products, so pairs below the threshold are never rows.
    """
    pairs = _pairs(_centred(vectors.withColumn(key, F.col(key).cast("long")), key, column, None), threshold, block)
    if top is not None:
        from pyspark.sql import Window

        both = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
        place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target"))
        kept = both.withColumn("k", place).where(F.col("k") <= top)
        pairs = kept.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight").distinct()
    return pairs
