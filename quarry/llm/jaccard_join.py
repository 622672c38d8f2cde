"""N-gram Jaccard join by token-combination prefixes.

Shingles of a set are ordered by (document frequency, hash). The first common shingle of a pair lies in the standard
prefix of both; if it is rare it is indexed alone. Otherwise every common shingle is frequent, and the prefix extended
by g places holds g + 1 of them; frequent shingles are dealt into g subclasses, so two common ones meet in a subclass
and the pair shares that 2-combination. Sets are banded by size so that both sides use the same g. Candidates are
verified on whole sets.

Copies of a text collapse into one representative before anything is paired. Candidates aren't listed pair by pair:
each set goes to the block of its most common signature, blocks are split into tiles of bounded count and bytes, and
two tiles meet once if any signature occurs in both. A meeting compares all its sets by products of 0/1 matrices and
returns a spanning forest of the links it found. So a group of m sets ships about m * m / TILE_SETS rows and returns no
pairs, and every candidate pair is still compared on whole sets.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, give_back, mix, partitions, shingle_sets, string_buffers, text_bytes
from quarry.llm.components import connected_components, hot_keys, look_up
from quarry.llm.counting import SENT, Sender, Shape, answer, cuts, whole_counts

#: A tile holds about this many sets and this many bytes of tokens, or one longer set.
TILE_SETS = 256
TILE_BYTES = 2 << 20
#: Columns of a 0/1 matrix that are multiplied at once.
COLUMNS = 4096
_U = np.uint64


def _kept_texts(docs: pa.Table, kept: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Nodes, offsets and bytes of the texts of this group that stand for their copies."""
    if not kept.num_rows:  # all texts of the group stand behind copies elsewhere; the columns may be missing, too
        return [], np.zeros(1, np.int64), np.zeros(0, np.uint8)
    want = {(n, d) for n, d in zip(kept["rep"].to_pylist(), kept["rep_id"].to_pylist())}
    rows, nodes = [], []
    for k, pair in enumerate(zip(docs["node"].to_pylist(), docs["doc_id"].to_pylist())):
        if pair in want:
            want.discard(pair)
            rows.append(k)
            nodes.append(pair[0])
    offsets, data = string_buffers(docs["text"].take(pa.array(rows, pa.int64())))
    return nodes, offsets, data


def _prefix(size: int, need: int, extra: int) -> int:
    return min(size, size - need + 1 + extra)


def signatures(tokens: np.ndarray, df: np.ndarray, t: Fraction, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, kinds and places of one set; tokens are in the global order (df, token) with their frequencies.

    kind 0: single rare token, with its place in the order; kind -1: pair of frequent tokens.
    """
    size = len(tokens)
    need = math.ceil(t * size)
    first = _prefix(size, need, 0)
    rares = int(np.searchsorted(df, rare, side="right"))
    tiny = math.ceil(t * need) < 2  # a partner may share one shingle only, so frequent ones are indexed alone too
    single = np.flatnonzero(df[: first if tiny else min(first, rares)] > 1)
    pairs = [np.zeros(0, _U)]
    if rares < size and need >= 2:
        ratio = math.log(float(1 / t))
        band = int(math.floor(math.log(size) / ratio + 1e-9))
        for label in (band, band + 1):
            g = max(1, int((1 - float(t)) * math.exp(label * ratio) / 2))
            g = min(g, max(1, math.ceil(float(t) * math.exp((label - 1) * ratio) * 0.98) - 1))
            chosen = tokens[rares : _prefix(size, need, g)]
            if len(chosen) < 2:
                continue
            with np.errstate(over="ignore"):
                sub = mix(chosen + _U(17)) % _U(g)
                order = np.lexsort((chosen, sub))
                chosen, sub = chosen[order], sub[order]
                for gap in range(1, len(chosen)):
                    same = sub[gap:] == sub[:-gap]
                    if not same.any():
                        break
                    pairs.append(mix(chosen[:-gap][same] * _U(0x9E3779B97F4A7C15) + mix(chosen[gap:][same]) + _U(label)))
    both = np.unique(np.concatenate(pairs))
    kind = np.zeros(len(single) + len(both), np.int32)
    kind[len(single) :] = -1
    place = np.zeros(len(kind), np.int32)
    place[: len(single)] = single
    return np.concatenate([tokens[single], both]), kind, place


def similar_texts(docs: DataFrame, n: int = 4, threshold: Fraction | float | str = "0.85", key: str = "doc_id", text: str = "text", rare: int = 8, keepers: bool = False) -> DataFrame:
    """One row per input row: key, n_shingles, component_id; with ``keepers``: key, n_shingles, node (the text's md5), keep.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set is the distinct n-word shingles, or the whole
    sequence if the text has fewer words. Sets with Jaccard similarity of at least ``threshold`` link; component_id is
    the smallest key reachable. Null or empty texts have no shingles and link with nothing (component_id: own key);
    rows with a null key take no part (component_id: null; their n_shingles is null too). Repeated rows are each
    returned. Other columns are ignored. An empty table gives an empty result.

    With ``keepers``, rows with a null key take part, too. keep holds for the rows of one key and text of each component,
    the smallest key (null last) and then the smallest node, and for all rows without shingles.
    """
    spark = docs.sparkSession
    t = Fraction(str(threshold))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    if keepers:
        rows = rows.withColumn("own", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("text")))
    shape = Shape.of(text_bytes(rows), partitions(spark))
    dg = F.pmod(F.xxhash64("doc_id", "node"), F.lit(shape.groups)).cast("int")
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    copied = hot_keys(nodes, "node", nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0], "copies")
    kept = nodes.where("doc_id IS NOT NULL").select("node", "doc_id").withColumn("dg", dg)
    parted = rows.where("doc_id IS NOT NULL").withColumn("dg", dg).repartition(shape.tasks, "dg")

    def emit(key, left, right):
        _, offsets, data = _kept_texts(left, right)
        sender, sets = Sender(shape, key[0].as_py()), shingle_sets(offsets, data, n)
        if sets:
            sender.add(0, *np.unique(np.concatenate(sets), return_counts=True))
        give_back()
        return sender.table()

    def sign(key, left, right):
        if not right.num_rows:
            right = pa.table({"b": pa.array([], pa.int32())})
        own, answers = (right.filter(pa.array(right["b"].to_numpy(zero_copy_only=False) < 0)), right.filter(pa.array(right["b"].to_numpy(zero_copy_only=False) >= 0)))
        nodes, offsets, data = _kept_texts(left, own)
        sets = shingle_sets(offsets, data, n)
        tokens = np.unique(np.concatenate(sets)) if sets else np.zeros(0, _U)
        df = whole_counts(answers, 0, [x for x in np.diff(cuts(tokens, shape.wide)).tolist() if x])
        whole, found = [], []  # of the sets that may have partners: number and shared tokens; number and signatures
        for k, own in enumerate(sets):
            if not len(own):
                continue
            f = df[np.searchsorted(tokens, own)]
            if int((f > 1).sum()) < math.ceil(t * len(own)):  # tokens of its own alone rule out any partner
                continue
            order = np.lexsort((own, f))
            sigs = signatures(own[order], f[order], t, rare)
            if len(sigs[0]):
                whole.append((k, own[f > 1].tobytes()))
                found.append((k, *sigs))
        size = np.array([len(s) for s in sets], np.int64)
        sets = tokens = df = None
        every, blank = np.arange(len(nodes)), lambda m, kind: pa.nulls(m, kind)
        of = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        joined = lambda k, kind: np.concatenate([x[k] for x in found]).astype(kind) if found else np.zeros(0, kind)
        names = pa.array(nodes, pa.binary())
        parts = [
            (every, np.full(len(every), 2, np.int32), blank(len(every), pa.int64()), blank(len(every), pa.int32()), blank(len(every), pa.binary())),
            (np.array([k for k, _ in whole], np.int64), np.full(len(whole), 1, np.int32), blank(len(whole), pa.int64()), blank(len(whole), pa.int32()), pa.array([x for _, x in whole], pa.binary())),
            (of, joined(2, np.int32), pa.array(joined(1, np.uint64).view(np.int64)), pa.array(joined(3, np.int32)), blank(len(of), pa.binary())),
        ]
        out = pa.concat_tables(pa.table([pa.array(kind), names.take(pa.array(at)), pa.array(size[at]), sig, place, blob], names=["kind", "node", "size", "sig", "place", "tokens"]) for at, kind, sig, place, blob in parts)
        give_back()
        return out

    reps = kept.select("dg", F.col("node").alias("rep"), F.col("doc_id").alias("rep_id"))  # other names: both sides of a cogroup must not share attributes
    sent = parted.groupBy("dg").cogroup(reps.repartition(shape.tasks, "dg").groupBy("dg")).applyInArrow(emit, SENT)
    counted = answer(sent, shape)
    asked = counted.select(F.col("g").alias("dg"), "n", "b", "counts", F.lit(None).cast("binary").alias("rep"), F.lit(None).cast("long").alias("rep_id")).unionByName(
        reps.select("dg", F.lit(0).alias("n"), F.lit(-1).alias("b"), F.lit(None).cast("binary").alias("counts"), "rep", "rep_id")
    )
    signed = cut(parted.groupBy("dg").cogroup(asked.repartition(shape.tasks, "dg").groupBy("dg")).applyInArrow(sign, "kind int, node binary, size long, sig long, place int, tokens binary"))
    sizes = signed.where("kind = 2").select("node", "size")
    sets = signed.where("kind = 1").select("node", "size", "tokens")
    sigs = signed.where("kind <= 0").select("node", "size", "sig", "place", "kind")

    label = _link(sigs, sets, t)
    smallest = kept.select("node", F.col("doc_id"))
    named = cut(smallest.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    hot = hot_keys(named, "label", named.count())
    if keepers:
        order = lambda *more: F.struct(F.col("own").isNull().alias("missing"), F.col("own").alias("own"), *more)
        first = rows.groupBy("node").agg(F.min(order()).alias("first")).select("node", "first.own")
        best = named.join(first, "node").groupBy("label").agg(F.min(order(F.col("node"))).alias("best")).select("label", F.col("best.own").alias("best_own"), F.col("best.node").alias("best_node"))
        best = cut(best)
        nodes = look_up(named, "label", best, hot).select("node", "best_own", "best_node").join(sizes, "node")
        keep = (F.col("size") == 0) | ((F.col("node") == F.col("best_node")) & F.col("own").eqNullSafe(F.col("best_own")))
        return look_up(rows.select("own", "node"), "node", nodes, copied).select(F.col("own").alias("doc_id"), F.col("size").alias("n_shingles"), "node", keep.alias("keep"))
    component = cut(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    result = look_up(named, "label", component, hot).select("node", "component_id").join(sizes, "node").select("node", "component_id", F.col("size").alias("n_shingles"))
    out = look_up(rows.select("doc_id", "node"), "node", result, copied)
    return out.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.col("n_shingles")).alias("n_shingles"),
        F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` with each of ``two``."""
    out = np.zeros((len(one), len(two)), np.float32)
    x, y = np.concatenate(one), np.concatenate(two)
    shared = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True)
    if not len(shared):
        return out.astype(np.int64)

    def places(tokens, sets):
        col = np.searchsorted(shared, tokens)
        hit = shared[np.minimum(col, len(shared) - 1)] == tokens
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], col[hit]

    (rx, cx), (ry, cy) = places(x, one), places(y, two)
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        left, right = np.zeros((len(one), width), np.float32), np.zeros((len(two), width), np.float32)
        for m, r, c in ((left, rx, cx), (right, ry, cy)):
            use = (c >= low) & (c < low + width)
            m[r[use], c[use] - low] = 1
        out += left @ right.T
    return np.rint(out).astype(np.int64)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, node) that connect what the symmetric matrix connects."""
    free, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if free[root]:
            free[root] = False
            front = np.array([root])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & free)
                free[front] = False
                out.extend((root, int(k)) for k in front)
    return out


def _meeting(t: Fraction):
    """Compares the sets of two tiles, or of one with itself. Tokens that occur in one set alone are not in the blobs."""
    p, q = t.numerator, t.denominator

    def meet(table: pa.Table) -> pa.Table:
        side, size, nodes = table["side"].to_numpy(), table["size"].to_numpy(), table["node"].to_pylist()
        sets = [np.frombuffer(x, _U) for x in table["tokens"].to_pylist()]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(two):
            two = one
        common = _common([sets[k] for k in one], [sets[k] for k in two])
        good = q * common >= p * (size[one][:, None] + size[two][None, :] - common)
        linked = np.zeros((len(nodes), len(nodes)), bool)
        linked[np.ix_(one, two)] = good
        edges = _forest(linked | linked.T)
        give_back()
        return pa.table({"a": pa.array([nodes[x] for x, _ in edges], pa.binary()), "b": pa.array([nodes[y] for _, y in edges], pa.binary())})

    return meet


def _link(sigs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Rows (node, label) of the nodes that link with another."""
    p, q = t.numerator, t.denominator
    common = cut(sigs.groupBy("sig", "kind").agg(F.count("*").alias("m")).where("m > 1"))  # cut, here and below: then the join can split a hot signature
    live = cut(sigs.join(common.hint("merge"), ["sig", "kind"]).select("sig", "kind", "m", "node", "size"))
    block = live.groupBy("node").agg(F.max(F.struct("m", "sig", "kind")).alias("b"), F.first("size").alias("size"))
    block = block.select("node", "size", F.col("b.sig").alias("bsig"), F.col("b.kind").alias("bkind"))
    extent = block.groupBy("bsig", "bkind").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes"))
    extent = extent.select("bsig", "bkind", F.ceil(F.greatest(F.col("n") / TILE_SETS, F.col("bytes") / TILE_BYTES)).alias("parts"))
    block, extent = cut(block), cut(extent)
    tile = block.join(extent.hint("merge"), ["bsig", "bkind"]).select("node", F.xxhash64("bsig", "bkind", F.pmod(F.xxhash64("node"), "parts")).alias("tile"))
    tile = cut(tile)
    seen = live.join(tile.hint("merge"), "node").groupBy("sig", "kind", "tile").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    other = seen.select("sig", "kind", F.col("tile").alias("b"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = seen.withColumnRenamed("tile", "a").join(other.hint("merge"), ["sig", "kind"])
    pairs = pairs.where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("n") > 1)))
    pairs = pairs.where((q * F.col("high") >= p * F.col("low2")) & (q * F.col("high2") >= p * F.col("low"))).select("a", "b").distinct()
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("tile"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("b").alias("tile"), F.lit(1).alias("side"))))).alias("x"))
    members = tile.join(sets.hint("merge"), "node").select("tile", "node", "size", "tokens")
    sent = sides.select("a", "b", "x.tile", "x.side").join(members.hint("merge"), "tile").select("a", "b", "side", "node", "size", "tokens")
    return connected_components(sent.groupBy("a", "b").applyInArrow(_meeting(t), "a binary, b binary"))
