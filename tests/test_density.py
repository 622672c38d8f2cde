"""Density clusters against a plain HDBSCAN that builds the whole dendrogram of a group in memory."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import density


def plain(ids, edges, least):
    """Cluster of each id from edges (w, a, b): Kruskal's dendrogram, condensed from the top, most stable clusters."""
    up, node, size, kids, weight = {i: i for i in ids}, {i: i for i in ids}, {i: 1 for i in ids}, {}, {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for w, a, b in sorted(edges):
        x, y = find(a), find(b)
        if x != y:
            new = ("m", a, b)
            kids[new], weight[new], size[new] = (node[x], node[y]), max(w, density.NEAREST), size[node[x]] + size[node[y]]
            up[y], node[x] = x, new
    tops = [node[r] for r in {find(i) for i in ids} if size[node[r]] >= least]

    def points(n):
        out, stack = [], [n]
        while stack:
            n = stack.pop()
            if n in kids:
                stack += kids[n]
            else:
                out.append(n)
        return out

    def condense(n, birth):
        """(stability, members, children) of the cluster that begins as n."""
        stability, members = 0.0, points(n)
        while True:
            big = [k for k in kids[n] if size[k] >= least]
            here = 1 / weight[n]
            if len(big) == 2:
                stability += size[n] * (here - birth)
                return stability, members, [condense(k, here) for k in big]
            stability += sum(size[k] for k in kids[n] if k not in big) * (here - birth)
            if not big:
                return stability, members, []
            n = big[0]

    def best(c):
        below = [best(k) for k in c[2]]
        rest = sum(s for s, _ in below)
        return (c[0], [c[1]]) if not below or c[0] >= rest else (rest, [m for _, ms in below for m in ms])

    roots = [condense(t, 0.0) for t in tops]
    chosen = [m for r in roots for m in best(r)[1]] if len(roots) > 1 else [m for r in roots for k in r[2] for m in best(k)[1]]
    return {p: min(m) for m in chosen for p in m}


def reach(graph, samples):
    near = collections.defaultdict(list)
    for a, b, d in graph:
        near[a].append((d, b))
    core = {a: sorted(x)[samples - 2][0] if samples > 1 else 0.0 for a, x in near.items()}
    return core, {(max(d, core[a], core[b]), min(a, b), max(a, b)) for a, b, d in graph}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for g, blobs in ((0, 3), (1, 5), (2, 1), (3, 2)):
        for _ in range(blobs):
            centre = rng.normal(size=6)
            for _ in range(rng.integers(6, 14)):
                rows.append((i := i + 1, (centre + rng.normal(size=6) * rng.choice([0.1, 0.3])).tolist(), g))
        for _ in range(8):
            rows.append((i := i + 1, rng.normal(size=6).tolist(), g))
    rows += [((i := i + 1), rows[0][1], 0) for _ in range(7)]
    rows += [(9001, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 7), (9002, None, 0), (9003, [], 0), (9004, [1.0] * 6, None)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, g string, p int")


@pytest.mark.parametrize("k, least, samples, block", [(200, 5, 3, 2048), (200, 2, 1, 10), (4, 5, 3, 9)])
def test_clusters_equal_a_plain_version(spark, vectors, k, least, samples, block):
    graph = density.neighbour_graph(vectors, "label", k, block=block)
    got = density.clusters(vectors, graph, "label", least=least, samples=samples).collect()
    known = collections.defaultdict(list)
    for r in graph.collect():
        known[r.label].append((r.a, r.b, r.d))
    assert len(got) == vectors.count()
    want, cores = {}, {}
    for own in known.values():
        core, edges = reach(own, samples)
        cores |= core
        want |= plain(list(core), edges, least)
    assert {r.vec_id: r.cluster for r in got if r.cluster is not None} == want
    assert {r.vec_id: r.core for r in got if r.core is not None} == cores
    assert len(set(want.values())) > 3
    sizes = collections.Counter(want.values())
    assert min(sizes.values()) >= least


def test_blobs_are_found_and_edges_hold(spark, vectors):
    assert density.clusters(vectors.limit(0), density.neighbour_graph(vectors.limit(0), "label"), "label").count() == 0
    whole = density.neighbour_graph(vectors, "label", 200)
    near = collections.defaultdict(list)
    for r in whole.collect():
        near[r.a].append((r.d, r.b))
    assert {a: sorted(x)[:4] for a, x in near.items()} == {a: sorted(x) for a, x in _by(density.neighbour_graph(vectors, "label", 4, block=7)).items()}
    found = density.clusters(vectors, whole, "label")
    picks = density.representatives(vectors, found).collect()
    v = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in vectors.where("size(embedding) > 0").collect()}
    members = collections.defaultdict(list)
    for r in found.where(F.col("cluster").isNotNull()).collect():
        members[r.cluster].append(r.vec_id)
    assert {p.cluster for p in picks} == set(members)
    for p in picks:
        centre = np.mean([v[i] for i in members[p.cluster]], axis=0)
        cosine = {i: round(float(v[i] @ centre / np.linalg.norm(centre)), 9) for i in members[p.cluster]}
        assert p.points == len(members[p.cluster]) and p.vec_id == min(cosine, key=lambda i: (cosine[i], i))


def _by(graph):
    out = collections.defaultdict(list)
    for r in graph.collect():
        out[r.a].append((r.d, r.b))
    return out
