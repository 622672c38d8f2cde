"""The training-data operators against brute force on small inputs: nulls, empty texts, ties, repeats, extra columns."""

import collections
import itertools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import archive, common, components, counting, jaccard_join, lm_score, mixing, near_dedup, packing, pii, quality, sharding, topk
from quarry.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["The", "it's", "été", "中文"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 90))) for _ in range(30)]
    rows = [*base, *base[:5], None, "", "   ", "one", "One", "one two three", "<|endoftext|> x", "a\n\n b  c"]
    for k in range(12):  # near copies of one text, each with another change
        w = base[0].split()
        w[k % len(w)] = f"x{k}"
        rows.append(" ".join(w))
    return [(i, t, "extra", i) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, node string, size long")


def empty(docs):
    return docs.limit(0)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(packing.token_pieces(docs, tokenizer_path(), capacity=64), 64).toPandas()
    by = dict(list(got.groupby("doc_id")))
    for i, text, *_ in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = by[i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 64).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == list(own.ids_crc32)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(s.length.cumsum() - s.length) and s.length.sum() <= 64
    assert packing.pack(packing.token_pieces(empty(docs), tokenizer_path()), 64).count() == 0


def test_plan_is_as_small_as_brute_force():
    def least(items, capacity):
        best = len(items)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for b in {x: j for j, x in enumerate(bins)}.values():
                if bins[b] + items[k] <= capacity:
                    go(k + 1, [*bins[:b], bins[b] + items[k], *bins[b + 1 :]])
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best

    rng = random.Random(1)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        assert packing.plan(dict(collections.Counter(items)), 20, nodes=2000)[0] == least(items, 20)


def test_plan_at_production_parameters():
    rng = random.Random(7)
    for top, n in ((2048, 20000), (700, 3000), (2048, 3000)):
        counts = dict(collections.Counter(min(2048, int(rng.expovariate(1 / 900)) + 20) if top == 2048 else rng.randint(300, top) for _ in range(n)))
        used, segments = packing.plan(counts, 2048)
        placed, fill = collections.Counter(), collections.defaultdict(list)
        for length, first, count, start, each, offset in segments:
            for k in range(count):
                placed[length, first + k] += 1
                fill[start + k // each].append((offset + k % each * length, length))
        assert set(placed.values()) == {1} and set(placed) == {(s, k) for s, c in counts.items() for k in range(c)}
        assert sorted(fill) == list(range(used))
        for own in fill.values():
            own.sort()
            assert [a for a, _ in own] == [sum(b for _, b in own[:k]) for k in range(len(own))] and sum(b for _, b in own) <= 2048
        bound, first = packing.lower_bound(counts, 2048), packing.best_fit(counts, 2048)[0]
        assert used == bound or (top == 700 and used <= bound + (first - bound) // 2), (top, n, bound, first, used)


def test_fillings_waste_least():
    rng = random.Random(8)
    for _ in range(60):
        counts = {s: rng.randint(1, 3) for s in rng.sample(range(2, 30), 7)}
        room = rng.randint(1, 60)
        every = [c for c in itertools.product(*(range(n + 1) for n in counts.values())) if sum(a * s for a, s in zip(c, counts)) <= room]
        got = list(packing.by_waste(counts, sorted(counts, reverse=True), room))
        assert len(got) == len(set(got)) == len(every)
        assert [sum(c) for c in got] == sorted((sum(a * s for a, s in zip(c, counts)) for c in every), reverse=True)
        assert sum(packing.fillings(counts, room, 1, 500)[0]) == sum(got[0])


@pytest.fixture(params=["one group", "many groups"])
def groups(request, monkeypatch):
    if request.param == "many groups":  # ranges of ranges and families of two groups
        monkeypatch.setattr(counting, "GROUP_BYTES", 900)
        monkeypatch.setattr(counting, "FAN", 2)


@pytest.mark.parametrize("tile", [256, 3])
def test_jaccard(docs, texts, tile, monkeypatch, groups):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", tile)
    sets = {}
    for i, text, *_ in texts:
        w = words(text)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_texts(docs, rare=1).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard_join.similar_texts(empty(docs)).count() == 0


def test_null_and_repeated_keys(spark):
    d = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in jaccard_join.similar_texts(d).collect() if r.doc_id)
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 1)]
    assert [r.slot for r in sharding.assign(d, 1).orderBy("slot").collect()] == [0, 1, 2, 3]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB \n") for _ in range(rng.randint(0, 400))) for _ in range(50)] + ["x" * 900, "", "Aa " * 400]
    offsets, data = common.string_buffers(common.pa.array(texts))
    whole = common.word_hashes(offsets, data)
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    pieces = common.word_hashes(offsets, data)
    assert all((a == b).all() for a, b in zip(whole, pieces)) and len(whole[0]) == sum(len(words(t)) for t in texts)
    assert [len(set(x)) for x in (whole[0], {w for t in texts for w in words(t)})][0] == len({w for t in texts for w in words(t)})


def test_language_model(docs, texts, groups):
    w = {i: words(t) for i, t, *_ in texts}
    grams = lambda x, n: collections.Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
    total = collections.Counter()
    for x in w.values():
        for n in (1, 2, 3):
            total.update(grams(x, n))
    size = sum(map(len, w.values()))
    got = {r.doc_id: r for r in lm_score.lm_scores(docs).collect()}
    assert len(got) == len(w)
    for i, x in w.items():
        own = grams(x, 1) + grams(x, 2) + grams(x, 3)
        score = 0.0
        for k in range(len(x)):
            top = min(3, k + 1)
            for n in range(top, 0, -1):
                g = tuple(x[k - n + 1 : k + 1])
                c = total[g] - own[g]
                if n == 1 or c > 0:
                    p = max(c, 1) / max(size - len(x), 1) if n == 1 else c / (total[g[:-1]] - own[g[:-1]])
                    score += math.log(p) + (top - n) * math.log(0.4)
                    break
        assert got[i].n_words == len(x) and math.isclose(got[i].log_score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (200, 8)) / 256
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 1), (902, [float("nan")] * 8, 1), (903, x[3].tolist(), 2)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5, item_block=64).orderBy("query_id", "rank").collect()]
    whole = {i: np.floor(np.array(e) * 256).astype(int) for i, e, _ in rows if i not in (900, 901, 902)}
    want = []
    for q in (0, 50, 100, 150):
        best = sorted((-int(whole[q] @ e), i) for i, e in whole.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(v.limit(0), v, 5).count() == 0


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 16))
    x = np.concatenate([c + 0.1 * rng.normal(size=(15, 16)) for c in centre])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(800, x[0].tolist(), 0), (801, [0.0] * 16, 0), (802, None, 0), (803, x[0].tolist(), None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_dedup.near_duplicates(v, block=8).collect()}
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e, label in rows if e and any(e) and label is not None}
    label = {i: y for i, _, y in rows}
    true = {(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93}
    assert len(got) == len(rows) and sum(r.n_links for r in got.values()) <= len(true)
    assert sum(r.n_links for r in got.values()) >= 0.9 * len(true)
    assert (got[801].n_links, got[802].n_links, got[803].n_links) == (0, 0, 0)
    assert got[800].n_links >= 1 and got[800].component_id == got[0].component_id
    assert near_dedup.near_duplicates(v.limit(0)).count() == 0


def test_archives(spark):
    long = "<p>é</p>" * 40
    pages = spark.createDataFrame([(3, "http://a/x y", long, 1), (1, "u", long, 1), (2, None, None, 1), (4, "u", "short", 1), (5, "u", "short", 1), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 20, 1)], "page_id long, url string, html string, digest int")
    got = {r.page_id: tuple(r)[1:] for r in archive.round_trip(pages).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got[3] == (len(long.encode()), sha(long), "revisit", 1) and got[1][2:] == ("response", None)
    assert got[2] == (0, sha(""), "response", None) and got[5] == (5, sha("short"), "response", None)
    assert got[6][1] == sha("a\r\n\r\nWARC/1.1\r\n" * 20) and len(got) == 6
    for version in (1, 2):
        records = [archive.ArcRecord({"URL": "u", "IP-address": "1.1.1.1", "Archive-date": "20010203040506", "Content-type": "text/plain"}, b) for b in (b"", b"\n\nx", b"bytes\xff")]
        back = list(archive.read_arc(archive.write_arc(records, version)))
        assert [r.body for r in back] == [r.body for r in records]
        assert archive.convert(back[1]).headers["WARC-Date"] == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        list(archive.read_arc(archive.write_arc(records)[:-4]))


def _luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def test_personal_data(spark):
    rng = random.Random(2)
    parts = ["1", "23", "4.", "-", " ", "+", "@", "a.", "b-", "_c", "%", "é", "😀", "(", ")", "255.1.", "4111111111111111", "\n", "x@y.z", "12345678", ""]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), "e") for i in range(400)] + [(1000, None, "e"), (1001, "1 " * 3000, "e"), (1002, "a" * 9000 + "@", "e"), (1003, "1.2.3.4" + ".5" * 2000, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r.doc_id: r.b for r in pii.find(d).select("doc_id", pii.joined(pii.F.col("base")).alias("b")).collect()}
    for i, text, _ in rows:
        t, want = (text or ""), []
        want += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and _luhn(re.sub("[^0-9]", "", m[0]))]
        want += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert got[i] == ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in want), (i, text)
    clean = pii.redact(d.where("doc_id = 1000 OR text LIKE '%x@y.z%'")).collect()
    assert all(r.text is None or ("x@y.z" not in r.text and "[" in r.text) for r in clean)
    assert pii.find(d.limit(0)).count() == 0


def test_boosting_separates():
    x = {n: np.array([k % b for k in range(64)]) for n, b in pii.BINS.items()}
    y = (x["digits"] > 4).astype(float)
    forest = pii.boost(x, y, np.ones(64))
    assert ((forest.logit(x) > 0) == (y > 0)).all()


def test_quality_and_mixing(spark):
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), "e") for i in range(600)] + [(900, None, "e"), (901, "", "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in quality.score(d, quality.train(d, labels)).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    assert sum((out[i] >= 0.3) == (i % 3 > 0) for i in range(300, 600)) >= 290
    got = mixing.rates(d, mixing.quality_domains(labels), {"good": 0.9, "poor": 0.1}, hold="good").collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and abs(sum(r.domain_p.values()) - 1) < 1e-9 for r in got)
    share = {n: sum(r.tokens * r.rate * r.domain_p[n] for r in got) for n in ("good", "poor")}
    assert abs(share["good"] / sum(share.values()) - 0.9) < 0.01
    assert quality.score(d.limit(0), quality.train(d.limit(0), labels.limit(0))).count() == 0


def test_sharding_moves_only_into_the_new_shard(docs):
    got = sharding.assign(docs, 5).toPandas()
    assert set(got[got.shard != got.grown_shard].grown_shard) <= {5}
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_pii_in_runs_that_fail(spark):
    def card():
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(digits + c for c in "0123456789" if _luhn(digits + c))

    rng = random.Random(3)
    broken = lambda: next(c for c in iter(lambda: "7" + "".join(rng.choice("0123456789") for _ in range(15)), None) if not _luhn(c))
    rows = [f"card {card()} paid" for _ in range(40)] + [f"item {broken()} sold" for _ in range(40)]
    rows += [f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now" for _ in range(40)] + [f"from 10.{k}.3.4 today" for k in range(40)]
    shapes = [
        ("a 7536784127813050 4845168114407329 b", ["7536784127813050", "4845168114407329"]),
        ("a 2353820953013749 4550997810720808 b", ["4550997810720808"]),
        ("a +1 (826) 555-4081 190.137.223.204 b", ["+1 (826) 555-4081", "190.137.223.204"]),
        ("a +1 (843) 555-7672 170.106.47.218 b", ["+1 (843) 555-7672", "170.106.47.218"]),
    ]
    d = spark.createDataFrame(list(enumerate([*rows, *(t for t, _ in shapes)])), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(d).collect()}
    for k, (text, hidden) in enumerate(shapes, len(rows)):
        assert all(h not in got[k] for h in hidden), (text, got[k])
    assert [got[len(rows)], got[len(rows) + 1]] == ["a [CARD] [CARD] b", "a 2353820953013749 [CARD] b"]  # the first group of the second fails the check
    assert all(got[k] == rows[k] for k in range(40, 80))
    # parts overlap each other: every window of a run of 20 digits and every start of a phone run
    one = spark.createDataFrame([(0, "x 12345678901234567890 y +12 345 678 90 1234 5678 z")], "doc_id long, text string")
    found = pii.candidates(one).select("_parts").collect()[0][0]
    assert sum(s.kind == 2 for s in found) == sum(20 - n + 1 for n in range(13, 20)) + sum(18 - n + 1 for n in range(13, 19))
    assert [(s.start, s.end) for s in found if s.kind == 3] == [(25, 36), (25, 39), (25, 44)]


def test_top_k_reads_until_the_stop_rule_holds():
    rng = np.random.default_rng(4)
    items = np.floor(rng.normal(size=(600, 64)) * 40)
    queries, own = items[:20], np.eye(20, 600, dtype=bool)
    alive = topk.survivors(queries, items, own, 5)
    assert alive.mean() <= 0.05 and (alive.sum(axis=1) >= 5).all() and not alive[own].any()
    exact = np.where(own, -np.inf, queries @ items.T)
    assert alive[exact >= np.sort(exact, axis=1)[:, -5][:, None]].all()


def test_top_k_of_large_values_and_repeated_rows(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 1.0]), (3, [3e9, 1.0]), (3, [3e9, 1.0]), (4, [1.7e308, 0.0]), (5, [0.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id = 3").limit(1), 6).collect()]
    whole = {i: [math.floor(x * 256) if abs(x) < 1e149 else int(1e150) for x in e] for i, e in rows}
    score = {i: sum(a * b for a, b in zip(e, whole[3])) for i, e in whole.items() if i != 3}
    ranked = sorted(score, key=lambda i: (-float(score[i]), i))
    assert [(r[0], r[1], r[2]) for r in got] == [(3, k, i) for k, i in enumerate(ranked, 1)]
    assert all(r[3] == min(max(score[r[2]], -(2**63)), 2**63 - 1) for r in got) and score[5] == 32768
    twice = [tuple(r) for r in topk.top_k(v, v.where("vec_id = 0"), 2).collect()]
    assert [r[2] for r in twice] == [4, 1]


def test_class_prior_and_unlabelled_texts(spark):
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.8):
        positive = rng.normal(1.5, 1, (3000, 4))
        mixed = np.where(rng.random((6000, 1)) < prior, rng.normal(1.5, 1, (6000, 4)), rng.normal(-1.5, 1, (6000, 4)))
        assert abs(quality.class_prior(positive, mixed) - prior) < 0.08
        model = quality.fit(positive, mixed, quality.class_prior(positive, mixed))
        test = np.concatenate([rng.normal(1.5, 1, (500, 4)), rng.normal(-1.5, 1, (500, 4))])
        assert ((model.score(test) >= 0.5) == (np.arange(1000) < 500)).mean() > 0.97  # as good as a fit on labels of both classes
    # labels 0 are never read: without them the result is the same
    texts = [(i, " ".join("good words here %d" % j if i % 2 else "$$ %d ##" % j for j in range(20))) for i in range(200)]
    d = spark.createDataFrame(texts + [(7, texts[7][1])] * 30, "doc_id long, text string")
    one, both = ([(i, i % 2) for i in range(100) if i % 2 or k] for k in (0, 1))
    scores = [{r.doc_id: r.score for r in quality.score(d, quality.train(d, spark.createDataFrame(x, "doc_id long, quality int"))).collect()} for x in (one, both)]
    assert scores[0] == scores[1] and all((scores[0][i] >= 0.3) == (i % 2 == 1) for i, _ in texts)


def test_sharding_tree(spark):
    leaves = sharding.tree(24)
    heavy = [sharding.Shard(s.number, s.region, s.rack, 3.0 if s.number == 4 else 0.0 if s.number == 7 else 1.0) for s in leaves]
    name = sharding.F.col("id").cast("string")
    got = spark.range(60_000).select(sharding.choose(name, leaves).alias("a"), sharding.choose(name, heavy).alias("b")).toPandas()
    for level in (lambda s: s.region, lambda s: (s.region, s.rack), lambda s: s.number):
        for tree, column in ((leaves, "a"), (heavy, "b")):
            weight = collections.Counter()
            for s in tree:
                weight[level(s)] += s.weight
            seen = collections.Counter(level(tree[n]) for n in got[column])
            assert all(abs(seen[x] / 60_000 - w / sum(weight.values())) < 0.012 for x, w in weight.items())
    moved = got[got.a != got.b]
    assert set(moved.a[moved.b != 4]) == {7} and not (got.b == 7).any()  # only into the heavier leaf, or out of the empty one
    d = spark.createDataFrame([(1, None), (1, "é"), (None, "x"), (2, "y" * 50_000)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.size, r.text_crc32, r.law) for r in sharding.assign(d, 3, weights={0: 0.0}).collect())
    assert out == sorted([(1, 8, 0, "key"), (1, 10, zlib.crc32("é".encode()), "key"), (0, 9, zlib.crc32(b"x"), "key"), (2, 50_008, zlib.crc32(b"y" * 50_000), "key")])
    assert sharding.assign(d.limit(0), 3).count() == 0


def test_look_up_of_hot_keys(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(3000 + i, None) for i in range(40)] + [(4000 + i, "lost") for i in range(600)]
    left = spark.createDataFrame(rows, "i int, k string")
    table = spark.createDataFrame([("hot", 7), *((f"k{i}", i) for i in range(0, 3000, 6))], "k string, v int")
    hot = components.hot_keys(left, "k", len(rows))
    assert set(hot) == ({"hot"} if common.partitions(spark) <= 8 else {"hot", "lost"})
    got = {r["i"]: (r["k"], r["v"]) for r in components.look_up(left, "k", table, hot).collect()}
    known = {"hot": 7} | {f"k{i}": i for i in range(0, 3000, 6)}
    assert got == {i: (k, known.get(k)) for i, k in rows}
    left, table = (d.withColumn("k", d["k"].cast("binary")) for d in (left, table))
    hot = components.hot_keys(left, "k", len(rows))
    found = components.look_up(left, "k", table, hot).where("v = 7")
    assert hot and found.count() == 2000 and {bytes(r["k"]) for r in found.select("k").distinct().collect()} == {b"hot"}


def test_components_of_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(1000, 1060)] + [(899, 2000), (2000, 2001), (5, 5), (None, 3), (1, 0)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in (*range(900), 2000, 2001)} | {i: 1000 for i in range(1000, 1061)}


def test_near_duplicate_components(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 64))
    x = np.repeat(base, 25, axis=0) + 0.17 * rng.normal(size=(1000, 64))  # cosines around 0.97 of each other
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(0, x[0].tolist(), 0), (None, x[0].tolist(), 0), (5000, [1.0] * 16, 1), (5001, [1.0] * 16, 1)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = (u @ u.T >= 0.93) & (np.arange(1000)[:, None] % 3 == np.arange(1000)[None, :] % 3)
    want = sims.sum() - 1000
    mine = [r for r in got if r.vec_id is not None and 0 < r.vec_id < 1000]
    assert sum(r.n_links for r in mine) >= 0.95 * want * 999 / 1000
    least = np.arange(1000)
    for _ in range(30):
        least = np.where(sims, least[None, :], 10**6).min(1)
    assert sum(r.component_id == least[r.vec_id] for r in mine) >= 0.99 * len(mine)
    assert len(got) == len(rows) and {r.component_id for r in got if r.vec_id in (5000, 5001)} == {5000}


def test_archives_of_nulls_repeats_and_nothing(spark):
    long = "<p>x</p>" * 20
    pages = spark.createDataFrame([(None, "u", long), (4, "u", long), (4, "u", long), (9, "v", long), (9, "v", "other" * 30), (5, "w", None)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in archive.round_trip(pages).collect())
    assert got == [(0, 160, "revisit", 4), (4, 160, "response", None), (4, 160, "response", None), (5, 0, "response", None), (9, 150, "response", None), (9, 160, "revisit", 4)]
    assert archive.round_trip(pages.limit(0)).count() == 0


def test_loose_proposals_are_learnt(spark):
    """Numbers that no base span ever covers aren't redacted, spelt addresses neither; what overlaps a base span stays base."""
    rows = [(i, f"call +1 (555) 555-{1000 + i} or order 555-0{100 + i} from 10.0.0.{i} v1.2.3.999", "x") for i in range(60)] + [(60, None, "x"), (60, None, "x"), (None, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.candidates(d.select("doc_id", "text")).selectExpr("explode(_loose) AS s").selectExpr("s.kind", "s.valid").toPandas()
    assert set(found.kind[found.valid]) == {1} and (found.kind == 3).any()
    out = [r.text for r in pii.redact(d).orderBy("doc_id").collect() if r.text]
    assert out == [f"call [PHONE] or order 555-0{100 + i} from [IP] v1.2.3.999" for i in range(60)]
    assert pii.redact(d).columns == d.columns and pii.redact(d.limit(0)).count() == 0
    # calibration on held-out rows: what is right in the fitted half alone isn't selected
    x = {n: np.arange(8) % b for n, b in pii.BINS.items()} | {"kind": np.zeros(8, int)}
    y = (np.arange(8) >= 4).astype(float)
    assert 0 in pii.boost(x, y, np.ones(8), np.ones(8)).thresholds
    assert 0 not in pii.boost(x, y, np.ones(8), np.where(y > 0, 0.01, 1.0)).thresholds or not pii.boost(x, y, np.ones(8), np.where(y > 0, 0.01, 1.0)).thresholds[0] < 0


def test_labels_of_repeated_keys_are_bounded(spark):
    d = spark.createDataFrame([(i % 3, f"w{i} tok") for i in range(300)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (0, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model = mixing.learn(d, mixing.quality_domains(labels), "domain")
    assert model.names == ["good", "poor", "toxic"]
    got = mixing.rates(d, mixing.quality_domains(labels), {"good": 0.5, "poor": 0.5}, hold="good")
    assert got.count() == 301 and mixing.rates(d.limit(0), mixing.quality_domains(labels), mixing.TARGETS).count() == 0
