"""Graph operators against plain versions: rank, betweenness, communities, diverse choice, running totals."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, ordered, refresh, semantic


def random_graph(seed, n=30, m=60):
    rng = random.Random(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def frame(spark, pairs, weight=lambda a, b: 1.0):
    return spark.createDataFrame([(f"n{a:02}", f"n{b:02}", weight(a, b)) for a, b in pairs], "source string, target string, weight double")


def test_pagerank(spark):
    pairs = random_graph(1)
    weight = lambda a, b: 1.0 + (a * b) % 5
    got = {r.node: r.rank for r in graph.pagerank(frame(spark, pairs, weight), steps=12).collect()}
    nodes = sorted({x for p in pairs for x in p})
    w = np.zeros((len(nodes),) * 2)
    for a, b in pairs:
        w[nodes.index(a), nodes.index(b)] = w[nodes.index(b), nodes.index(a)] = weight(a, b)
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(12):
        rank = 0.15 / len(nodes) + 0.85 * (w / w.sum(1, keepdims=True)).T @ rank
    assert np.allclose([got[f"n{x:02}"] for x in nodes], rank) and len(got) == len(nodes)


def plain_betweenness(pairs):
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    out = dict.fromkeys(near, 0.0)
    for s in near:
        ways, dist, order = {s: 1}, {s: 0}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s:
                out[w] += share[w] / 2
    return out


def test_betweenness(spark):
    for seed in (2, 3):
        pairs = random_graph(seed, 24, 30)
        want = plain_betweenness(pairs)
        got = {int(r.node[1:]): r.betweenness for r in graph.betweenness(frame(spark, pairs)).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = graph.bridges(frame(spark, pairs), share=0.1).collect()
    assert [r.node for r in top] == [f"n{k:02}" for k in sorted(want, key=lambda k: (-round(want[k], 9), k))[: max(1, int(len(want) * 0.1))]]
    assert graph.betweenness(frame(spark, pairs).limit(0)).count() == 0


def test_louvain(spark):
    rng = random.Random(7)
    pairs = [(a, b) for a in range(32) for b in range(a + 1, 32) if rng.random() < (0.8 if a // 8 == b // 8 else 0.04)]
    edges = frame(spark, pairs)
    found = graph.louvain(edges)
    got = {int(r.node[1:]): r.community for r in found.collect()}
    assert got == {k: f"n{k // 8 * 8:02}" for k in got}
    want = sum(1 for a, b in pairs if a // 8 == b // 8) / len(pairs) - sum((sum((a // 8 == g) + (b // 8 == g) for a, b in pairs) / (2 * len(pairs))) ** 2 for g in range(4))
    assert abs(graph.modularity(edges, found) - want) < 1e-9
    sparse = frame(spark, random_graph(5, 30, 45))
    assert graph.modularity(sparse, graph.louvain(sparse)) > max(graph.modularity(sparse, graph.communities(sparse)), 0.3)
    assert graph.louvain(edges.limit(0)).count() == 0


def test_diverse_choice(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    v[40:] = v[:20]  # copies
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in semantic.vec_ops(rows, semantic.Modulation(centroid=(1, 2), diverse=True, limit=8)).collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    q = u[[1, 2]].mean(0)
    score = u @ (q / np.linalg.norm(q))
    pool = sorted(range(60), key=lambda k: (-score[k], k))[:24]
    low, high = score[pool].min(), score[pool].max()
    chosen, left = [], list(pool)
    while left and len(chosen) < 8:
        near = {k: max((u[k] @ u[c] for c in chosen), default=0.0) for k in left}
        left = [k for k in left if near[k] < 0.999999]
        if not left:
            break
        best = max(left, key=lambda k: (0.7 * (score[k] - low) / (high - low) - 0.3 * near[k], -left.index(k)))
        chosen.append(best)
        left.remove(best)
    assert set(got) == set(chosen) and len(got) == 8


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_totals(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.randint(0, 20), rng.randint(1, 9)) for k in range(n)]
    got = {r.k: r.total for r in ordered.running_total(spark.createDataFrame(rows, "k int, o int, v int"), ["o", "k"], F.col("v")).collect()}
    want, total = {}, 0
    for k, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = total = total + v
    assert got == want
    down = {r.k: r.number for r in ordered.numbered(spark.createDataFrame(rows, "k int, o int, v int"), [F.desc("o"), "k"]).collect()}
    assert down == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_queue_and_bytes(spark):
    rows = [(f"c{k % 5}", k, 1 + k % 7) for k in range(200)]
    d = spark.createDataFrame(rows, "cell string, at int, size int")
    assert {tuple(r) for r in refresh.overflow(d, "cell", "at", 37).collect()} == {(f"c{c}", sum(k % 5 == c for k in range(37)), 1) for c in range(5)}
    used, want = 0, []
    for _, at, size in rows[51:]:
        used += size
        if used <= 100:
            want.append(at)
    assert sorted(r["at"] for r in refresh.within_bytes(d, "at", "size", 50, 100).collect()) == want
    assert [r["at"] for r in refresh.within_bytes(d, "at", "size", 50, 0).collect()] == [51]


def plain_similar(rows, least, places, same=lambda a, b: True):
    """By numpy over all pairs; rows are (key, vector, group)."""
    v = np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    v = v - v.mean(0)
    w = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, places)
    return {(rows[i][0], rows[j][0]): w[i, j] for i in range(len(rows)) for j in range(len(rows)) if rows[i][0] < rows[j][0] and same(rows[i], rows[j]) and w[i, j] >= least}


def test_similar_meets_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), rng.normal(size=9).tolist(), int(k) % 3 if k % 7 else 5) for k in rng.permutation(2600)]
    whole = spark.createDataFrame([(-1, None, 1), *rows], "vec_id long, embedding array<float>, label int")  # the first one has no vector
    found = graph.similar(whole, 0.8, block="label")
    got = {(r.source, r.target): r.weight for r in found.collect()}
    want = plain_similar([(k, np.array(v, np.float32).astype(float), g) for k, v, g in rows], 0.8, 4, lambda a, b: a[2] == b[2])
    assert got == want and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "source#" not in "".join(x for x in plan.splitlines() if "Join" in x)  # pairs below the threshold are never rows


def test_edges_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "c", 3.0)], "source string, target string, weight double").withColumn("weight", F.udf(count, "double")("weight"))
    got = {(r.a, r.b): r.w for r in graph._symmetric(edges).collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 1.0, ("b", "c"): 2.0, ("c", "b"): 2.0, ("c", "c"): 6.0} and seen.value == 3


def test_similar_all_with_a_null_first(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), rng.normal(size=7).tolist(), 0) for k in rng.permutation(700)]
    got = {(r.source, r.target): round(r.weight, 6) for r in graph.similar_all(spark.createDataFrame([(-1, None, 0), *rows], "vec_id long, embedding array<double>, label int"), 0.8, block=64).collect()}
    want = plain_similar(rows, 0.8, 6)
    assert got == want and len(want) > 500
    few = graph.similar_all(spark.createDataFrame(rows[:50], "vec_id long, embedding array<double>, label int"), 0.3, top=2)
    assert few.count() and max(r["count"] for r in few.groupBy("source").count().collect()) <= 50
    assert graph.similar_all(spark.createDataFrame([], "vec_id long, embedding array<double>"), 0.3).count() == 0


def clustered(n, seed=8, wide=12):
    """Rows around a few directions in three groups; one id stands in two groups and another twice in one."""
    rng = np.random.default_rng(seed)
    hub = rng.normal(size=(wide, 8))
    rows = [(int(k), (hub[k % wide] + rng.normal(size=8) * 0.7).tolist(), int(k) % 3) for k in rng.permutation(n)]
    return rows + [(4, rows[0][1], 0), (7, rows[1][1], 1), (n + 5, [0.0] * 7 + [1e-3], 9)]  # the last one is alone in its group


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"LARGEST": 64, "ROOM": 16, "WIDE": 20, "HELD": 300}.items():
        monkeypatch.setattr(graph, name, value)


def test_rank_without_edges(spark, small_blocks):
    rows = spark.createDataFrame(clustered(400), "vec_id long, embedding array<double>, label int")
    want = {r.node: r.rank for r in graph.pagerank(graph.similar(rows, 0.3, block="label"), steps=5).collect()}
    got = {r.node: r.rank for r in graph.similar_rank(rows, 0.3, block="label", steps=5).collect()}
    assert set(got) == set(want) and len(got) > 390 and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-12)
    assert graph.similar_rank(rows.limit(0), 0.3).count() == 0


@pytest.mark.parametrize("wide", [4, 40])
def test_ties_and_folded_graph_without_edges(spark, small_blocks, wide):
    rows = spark.createDataFrame(clustered(400, wide=wide), "vec_id long, embedding array<double>, label int")
    both = graph.stored(graph._symmetric(graph.similar(rows, 0.3, block="label")))
    plain, near = graph._Edges(both), graph._Near(graph._centred(rows, "vec_id", "embedding", "label"), 0.3)
    k = {r.node: r.k for r in plain.degree().collect()}
    assert {r.node: round(r.k, 6) for r in near.degree().collect()} == {a: round(b, 6) for a, b in k.items()}
    names = {}
    for r in sorted(k):
        names.setdefault((r % wide, r % 3) if wide == 4 else r % 97, r)
    label = [(r, names[(r % wide, r % 3) if wide == 4 else r % 97]) for r in k]  # of 33 vectors or of four each
    own = spark.createDataFrame([(n, c, k[n]) for n, c in label], "node long, community long, k double")
    size = own.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("members"))
    m = sum(k.values())
    ties = near.ties(own, size, m)
    got = {(r.node, r.to): r.w for r in ties.groupBy("node", "to").agg(F.sum("w").alias("w")).collect()}
    want = {(r.node, r.to): r.w for r in plain.ties(own, size, m).collect()}
    assert all(abs(got[x] - want[x]) < 1e-9 for x in got)
    total, at = {r.community: r.total for r in size.collect()}, dict(label)
    for n, c in label:
        gain = {to: round(w - k[n] * total[to] / m, 9) for (x, to), w in want.items() if x == n and to != c}
        if gain:
            best = min(gain, key=lambda to: (-gain[to], to))
            assert (n, best) in got
    assert all((n, at[n]) in got for n, to in want if to == at[n])
    assert abs(near.quality(own, size, ties, m) - graph._quality(both, own.select("node", "community"))) < 1e-12
    short = own.select("node", "community")
    folded = [{(r.a, r.b): round(r.w, 6) for r in x.folded(short).collect()} for x in (plain, near)]
    assert folded[0] == folded[1] and len(folded[0]) > 30


def test_louvain_without_edges(spark, small_blocks):
    rows = spark.createDataFrame(clustered(400), "vec_id long, embedding array<double>, label int")
    edges = graph.stored(graph.similar(rows, 0.3, block="label"))
    want = {r.node: r.community for r in graph.louvain(edges, rounds=4, levels=2).collect()}
    got = {r.node: r.community for r in graph.similar_louvain(rows, 0.3, rounds=4, levels=2, block="label").collect()}
    assert got == want and 3 <= len(set(got.values())) < 100
    assert graph.similar_louvain(rows.limit(0), 0.3).count() == 0


@pytest.mark.parametrize("name", ["louvain_communities", "hubs_top10pct"])
def test_edges_of_similar_vectors_are_never_rows(spark, monkeypatch, name):
    import __spark_entry__

    def rows(*args):
        raise AssertionError("edges as rows")

    monkeypatch.setattr(graph, "_pairs", rows)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 40
