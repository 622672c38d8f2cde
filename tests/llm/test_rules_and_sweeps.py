"""Divergence rules, the concurrency sweep and whitening against plain versions: nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import concurrency, divergence, whitening

SPACE = r"[^\x20\x09-\x0D]"


def base(text):
    text = text or ""
    w = re.findall(SPACE + "+", text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit)


def histograms(text):
    text = text or ""
    vocabulary = sorted({w for own in divergence.COMMON.values() for w in own})
    kinds = [lambda c: ord(c) > 127, lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: c == " ", lambda c: c in "\t\n\v\f\r", lambda c: c in ".,;:'-", lambda c: c in "#*$%&|<>"]
    p = [sum(map(k, text)) for k in kinds]
    p.append(len(text) - sum(c in "0123456789" for c in text) - sum(p))
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(SPACE + "+", text)]
    count = collections.Counter(w[:-1] if w[-1] in ",." else w for w in low)
    w = [count[x] for x in vocabulary]
    w.append(len(low) - sum(w))
    return np.array(p) / max(sum(p), 1), np.array(w) / max(len(low), 1), sum(p)


def js(p, q):
    m = (p + q) / 2
    with np.errstate(all="ignore"):
        return math.sqrt(max(sum(np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)) / 2, 0))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = []
    for k in range(160):
        lang = list(divergence.COMMON)[k % 4]
        words = [rng.choice(divergence.COMMON[lang][:12]) if rng.random() < 0.45 else "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(20, 200))]
        rows.append((k, " ".join(words).capitalize() + ".\nEnd, " + words[0], lang))
    for k in range(160, 180):
        rows.append((k, " ".join("".join(rng.choice("XYZ#$%") for _ in range(5)) for _ in range(80)), "en"))
    rows += [(180, None, "en"), (181, "", None), (182, " \n\t\n ", "en"), (183, "a b c " * 40, "fr"), (184, "one\none\n one\none", "xx"), (185, rows[0][1], None), (0, rows[0][1], "en"), (186, "word " * 60_000 + "été\n" * 9, "fr"), (187, rows[5][1] * 3, None)]
    return rows


def plain_rules(rows):
    counts = [base(t) for _, t, _ in rows]
    failed = [n < 50 or 100 * r > 50 * n for n, _, _, _, r in counts]
    hist = [histograms(t) for _, t, _ in rows]
    sound = list({(lang, c[0], c[1], *h[0], *h[1]): (lang, h, c[0]) for (_, _, lang), c, h, f in zip(rows, counts, hist, failed) if not f and lang in divergence.COMMON}.values())

    def far(h, n, refs):
        d = min(js(h[0], r[0]) for r in refs.values()) if h[2] >= 200 else 0
        e = min(js(h[1], r[1]) for r in refs.values()) if n >= 50 else 0
        return d > 0.13 + 0.6 / math.sqrt(max(h[2], 1)) or e > 0.25 + 1.3 / math.sqrt(max(n, 1))

    def means(own):
        return {g: tuple(np.mean([h[k] for lang, h, _ in own if lang == g], axis=0) for k in (0, 1)) for g in {x[0] for x in own}}

    refs = means(sound)
    refs = means([x for x in sound if not far(x[1], x[2], refs)])
    return [(i, *c, f, not f and not far(h, c[0], refs)) for (i, _, _), c, f, h in zip(rows, counts, failed, hist)]


def test_rules(spark, corpus):
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus], "doc_id long, text string, lang string, n_words int, far string")
    got = divergence.rules(df).drop("class_distance", "word_distance").collect()
    want = plain_rules(corpus)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = {r[0]: r[-1] for r in want}
    assert not any(kept[k] for k in range(160, 180)) and sum(kept[k] for k in range(160)) > 100
    assert divergence.rules(df.limit(0)).count() == 0
    alone = divergence.rules(df.where("doc_id >= 180 AND doc_id < 183")).collect()
    assert [r.kept for r in alone] == [False] * 3


def plain_sweep(rows, total=None):
    steps = collections.defaultdict(lambda: [0, 0])
    for key, s, e, a in rows:
        if s is None:
            continue
        s, e = s // 60 * 60, None if e is None else e // 60 * 60
        if e is not None and e <= s:
            continue
        for k in [key] + [total] * (total is not None):
            for t, sign in ((s, 1), (e, -1)):
                if t is not None:
                    steps[k, t][0] += sign
                    steps[k, t][1] += sign * (a or 0)
    out = []
    for k in {k for k, _ in steps}:
        at = sorted(t for (x, t), v in steps.items() if x == k and v != [0, 0])
        n = c = high = 0
        own = []
        for t, after in zip(at, [*at[1:], None]):
            n, c = n + steps[k, t][0], c + steps[k, t][1]
            high = max(high, n) if own else n
            own.append((k, t, after, n, c, high))
        out += [(*r, r[3] == max(x[3] for x in own)) for r in own]
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_sweep(spark, block):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randint(-5000, 90_000), None, rng.choice([None, 0, 7, -3])) for _ in range(40)]
    rows += [(rng.choice([1, 1, 3]), s := rng.randint(-5000, 90_000), s + rng.choice([-100, 0, 30, 60, 600, 7000, 50_000]), rng.randint(0, 9)) for _ in range(300)]
    rows += [(4, 0, 60, 5), (4, 60, 120, 5), (5, None, 100, 1), (6, 100, 90, 1), (1, 0, 86_400, 1), (1, 0, 86_400, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "key int, start long, end long, amount long, id int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in concurrency.sweep(df, total=-2, block=block).collect()), key=key)
    assert got == sorted(plain_sweep(rows, -2), key=key)
    assert [r[1:5] for r in got if r[0] == 4] == [(0, 120, 1, 5), (120, None, 0, 0)]
    assert concurrency.sweep(df.limit(0)).count() == 0
    assert concurrency.sweep(df.where("key = 6")).count() == 0


def test_cover_is_the_interval(spark):
    spans = [(s, e) for s in range(0, 17) for e in range(s + 1, 17)]
    df = spark.createDataFrame([(k, s, e, 1, 2) for k, (s, e) in enumerate(spans)], "key int, s long, e long, n long, amount long")
    leaves = collections.defaultdict(list)
    for k, i, n, a in concurrency.cover(df, 4).collect():
        assert (n, a) == (1, 2)
        low = 1
        while i * low < 16:
            low *= 2
        leaves[k] += range(i * low - 16, (i + 1) * low - 16)
    assert all(sorted(leaves[k]) == list(range(s, e)) for k, (s, e) in enumerate(spans))


def test_open_sales(spark):
    at = lambda d, s=0: datetime.datetime(2024, 1, d, 0, 0, s)
    sales = spark.createDataFrame([(1, 10, 1.005, at(1, 59)), (2, 11, None, at(2)), (3, None, float("nan"), at(3)), (None, 12, 2.0, at(4)), (5, 10, 3.0, None)], "sale_id long, client_id long, total double, sold_at timestamp_ntz")
    lines = spark.createDataFrame([(1, at(2)), (1, at(5, 61 - 2)), (1, None), (2, None), (None, at(9)), (3, at(3))], "sale_id long, shipped_at timestamp_ntz")
    clients = spark.createDataFrame([(10, 7, "x"), (12, None, "y"), (None, 3, "z")], "client_id long, nation_id int, name string")
    got = {tuple(r) for r in concurrency.open_sales(sales, lines, clients).collect()}
    day = 19723 * 86400
    assert got == {(7, day, day + 11 * 86400, 100), (-1, day + 86400, None, 0), (-1, day + 2 * 86400, day + 9 * 86400, 0), (-1, day + 3 * 86400, None, 200)}


def test_jacobi():
    rng = np.random.default_rng(3)
    for rows, d in ((40, 7), (5, 8), (30, 1), (64, 64)):
        m = rng.normal(size=(rows, d)) * 10.0 ** rng.integers(-6, 6, d)
        s, v = whitening.jacobi(m)
        want = np.linalg.svd(m, compute_uv=False)
        assert np.allclose(s[: len(want)], want, rtol=1e-10, atol=want[0] * 1e-14) and np.allclose(v.T @ v, np.eye(d), atol=1e-12)
        assert np.allclose(np.linalg.norm(m @ v, axis=0), s, rtol=1e-9, atol=want[0] * 1e-13)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]).astype(np.float32)
    rows = [(k, v.tolist(), 1, "a") for k, v in enumerate(vectors)]
    rows += [(1000 + k, rows[0][1], 1, "a") for k in range(50)] + [(0, rows[0][1], 2, "b"), (None, rows[1][1], 1, "a")]
    odd = [(2000, None, 1, "a"), (2001, [], 1, "a"), (2002, [1.0] * 5 + [None], 1, "a"), (2003, [1.0] * 5 + [float("nan")], 1, "a"), (2004, [float("inf")] + [1.0] * 5, 1, "a"), (2005, [1.0] * 4, 1, "a")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, x int, n string")
    got = whitening.whiten(df, components=4).toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = (fit * n - total) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    for c in range(4):
        own = got[got.component == c + 1]
        assert np.allclose(own.explained, e[c] / e.sum(), rtol=1e-9)
        by = {(r.vec_id, r.deviation): r.whitened for r in own.fillna({"vec_id": -1}).itertuples()}
        want = (x - total / n) @ axes[:, c] / np.sqrt(e[c])
        deviation = ((n * x - total) ** 2).sum(1)
        found = np.array([by[-1 if r[0] is None else r[0], d] for r, d in zip(rows, deviation)])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-8
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 2000 AND vec_id < 2005")).count() == 0
    assert whitening.whiten(df.where("vec_id = 0")).count() == 0
    two = whitening.whiten(df.where("vec_id < 2")).toPandas()
    assert set(two.component) == {1} and np.allclose(two.whitened.abs(), 1)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).where(F.col("deviation").isNull()).count() > 0
