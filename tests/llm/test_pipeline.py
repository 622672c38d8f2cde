"""The corpus pipeline on the smallest tables, each stage against a plain version of it."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import mixing, quality
from quarry.llm.common import read
from quarry.llm.queries import THRESHOLD, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("stages"), read(spark, FOLDER, "documents"), []
    out.append(("documents", docs))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    columns = stages["documents"].columns
    assert all(stages[name].columns == columns for name, _ in corpus_pipeline.STAGES[:-1])


def test_quality_stage(spark, stages):
    model = quality.train(stages["documents"], read(spark, FOLDER, "labels"))
    scores = {r.doc_id: r._score for r in quality.score(stages["documents"], model, name="_score").collect()}
    assert set(rows(stages["quality"])) == {i for i, s in scores.items() if s >= THRESHOLD}
    clean = {r.doc_id for r in read(spark, FOLDER, "labels").where("quality = 1 AND toxic = 0").collect()} & set(scores)
    assert clean <= set(rows(stages["quality"]))


def test_similar_stage(stages):
    sets = {}
    for i, text in rows(stages["quality"]).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert set(rows(stages["similar"])) == {i for i in sets if least[i] == i}


def test_similar_stage_keeps_one_row_of_each_group(spark):
    a, b, c, d = ("".join(f"{x}{k} " for k in range(20)) for x in "abcd")
    near = a + "a20 "
    docs = [(1, a, "x"), (1, a, "x"), (1, a, "x"), (2, near, "x"), (3, b, "x"), (3, c, "x"), (0, c, "x"), (None, d, "x"), (None, d, "y"), (None, a, "x"), (7, None, "x"), (None, "", "x"), (None, "", "x"), (4, d + "d20 ", "x"), (None, d + "x1 ", "x")]
    docs += [(None, "only here without an id", "x"), (None, "only here without an id", "x")]
    got = corpus_pipeline.drop_similar(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string"), FOLDER)
    want = [(1, a), (3, b), (0, c), (4, d + "d20 "), (7, None), (None, ""), (None, ""), (None, "only here without an id")]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want)
    assert got.columns == ["doc_id", "text", "lang"]


def test_pii_stage(stages):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    before, after = rows(stages["similar"]), rows(stages["pii"])
    assert set(before) == set(after)
    assert any(email.search(t or "") for t in before.values()) and not any(email.search(t or "") for t in after.values())
    assert all(r.n_chars == len(r.text) for r in stages["pii"].collect() if r.text is not None)


def test_mix_stage(spark, stages):
    before, after = rows(stages["pii"]), stages["mix"].collect()
    assert all(before[r.doc_id] == r.text for r in after)
    labels = mixing.quality_domains(read(spark, FOLDER, "labels"))
    model = mixing.learn(stages["pii"], labels, "domain")
    good = model.names.index("good")
    likely = {r.doc_id for r in mixing.posteriors(stages["pii"], model).collect() if r._p[good] >= 0.5}
    assert likely <= {r.doc_id for r in after}
    assert max(collections.Counter(r.doc_id for r in after).values()) <= 2


def test_pack_stage(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = collections.Counter()
    for r in stages["mix"].collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        wanted[r.doc_id, len(ids)] += 1
    got = stages["pack"].toPandas()
    total = got.groupby("doc_id").length.sum()
    assert {i: sum(n * m for (j, n), m in wanted.items() if j == i) for i, _ in wanted} == dict(total)
    assert all(zlib.crc32(np.array(ids, "<u4").tobytes()) == crc for ids, crc in zip(got.ids, got.ids_crc32))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(s.length.cumsum() - s.length) and s.length.sum() <= 2048


def test_mixing_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "some words", "c")], "doc_id long, text string, _p string")
    kept = mixing.resample(docs, mixing.quality_domains(labels), mixing.TARGETS, hold="good", keep=0.5, fill=False)
    assert kept.columns == docs.columns and sorted(r._p for r in kept.collect()) == ["a", "b", "c"]
    assert mixing.resample(docs.limit(0), mixing.quality_domains(labels), mixing.TARGETS, hold="good").count() == 0


def test_fit_meets_targets_and_keeps(spark):
    p = [[0.9, 0.1], [0.8, 0.2], [0.1, 0.9], [0.0, 1.0]]
    rows = spark.createDataFrame([(10, p[k % 4]) for k in range(400)] + [(0, [1.0, 0.0])], "_tokens long, _p array<double>")
    mix = mixing.solve(rows, np.array([0.8, 0.2]))
    assert np.abs(mix.expected - mix.target).max() < 1 and mix.target.sum() == 4000
    rate = np.array([r.r for r in rows.select(mix.rate().alias("r")).collect()][:4])
    assert (rate >= 0).all() and np.allclose(1000 * rate @ np.array(p), mix.expected)
    held = mixing.solve(rows, np.array([0.99, 0.01]), hold=0, keep=0.5, fill=False)
    rate = [r.r for r in rows.select(held.rate().alias("r")).collect()][:4]
    assert min(rate[:2]) >= 1 and max(rate[2:]) < 0.05


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h " * 20, "n1", 7.0, 8, "o", "i"), (2, "a b c d e f g h " * 20, "n2", 7.5, 9, "o", "i"), (3, "mail to x.y@example.org now", None, None, 3, "p", "j")], "doc_id long, text string, _node string, _score double, _spans int, _order string, _id string")
    kept = {r.doc_id: r for r in corpus_pipeline.drop_similar(spark, docs, FOLDER).collect()}
    assert set(kept) == {1, 3} and kept[1]._node == "n1" and kept[1]._score == 7.0
    scored = {r.doc_id: r for r in corpus_pipeline.keep_quality(spark, docs, FOLDER).collect()}
    assert all(r._score == {1: 7.0, 2: 7.5, 3: None}[i] for i, r in scored.items())
    hidden = {r.doc_id: r for r in corpus_pipeline.redact(spark, docs, FOLDER).collect()}
    assert hidden[3].text == "mail to [EMAIL] now" and [(r._node, r._spans, r._order) for i, r in sorted(hidden.items())] == [("n1", 8, "o"), ("n2", 9, "o"), (None, 3, "p")]
