"""Cases in which queries once differed from their SQL, on small tables of their own."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import markdown as M
from quarry.operators import lexical, relational
from quarry.plans import catalog, derived, extended  # noqa: F401  derived adds to extended
from tests.test_catalog import plain

QUERIES, ORACLES = catalog.QUERIES | extended.QUERIES, catalog.ORACLES | extended.ORACLES


def agree(spark, folder, name, **tables):
    """Whether a query equals its SQL on tables that are given as frames; its rows."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = plain(QUERIES[name](spark, str(folder)).toPandas())
    assert got == plain(con.execute(ORACLES[name]).df())
    return got[1]


def test_shares_of_short_texts(spark, tmp_path):
    texts = ["ab", "a", "字", "字a", "漢字漢", "漢漢漢漢", "ひらa", *("x" * n for n in range(3, 12)), "a\nb", "", None]
    docs = spark.createDataFrame([(3 * k + m, t) for k, t in enumerate(texts) for m in range(3)], "doc_id long, text string")
    rows = agree(spark, tmp_path, "md_cjk_dominant", documents=docs)
    assert (True, 1) in rows  # "ab" takes in two thirds of a character, which is one


def test_longest_prefix_of_rows_in_any_order(spark):
    def shuffled(batches):
        for b in batches:
            yield b.sample(frac=1, random_state=random.randrange(1 << 30))  # each reading has an order of its own

    rows = spark.range(0, 300, 1, 1).selectExpr("concat('r', id % 10, '/', id) AS path").mapInPandas(shuffled, "path string")
    roots = spark.range(10).selectExpr("concat('r', id, '/') AS root")
    got = relational.longest_prefix(rows, "path", roots, "root").toPandas()
    assert len(got) == 300 and all(p.startswith(r) for p, r in zip(got["path"], got["root"]))
    odd = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 3, 4], "t": ["ab/c", "ab/c", None, ""]}))
    found = relational.longest_prefix(odd, "t", spark.createDataFrame([("a",), ("ab",), ("",), (None,)], "root string"), "root").collect()
    assert sorted((r.k, r.root) for r in found) == [(1, "ab"), (2, "ab"), (3, None), (4, None)]


def test_every_rule_of_commands(spark, tmp_path):
    lines = spark.createDataFrame([(k if k % 5 else None, k % 3, k // 2 if k % 7 else None) for k in range(60)] + [(1, 1, 0)] * 2, "sale_id long, line_no int, item_id long")
    rows = agree(spark, tmp_path, "shell_file_ops", sale_lines=lines)
    assert {r[2] for r in rows} == {"write", "read", "append", "edit", "delete", "create", "mkdir"}


def test_branches_of_every_turn(spark, tmp_path):
    turns = [(c, t) for c in range(6) for t in range(3 * c + 2) if (c, t) not in {(3, 2), (4, 6), (5, 0)}]  # some answer a turn that is lost
    rows = agree(spark, tmp_path, "conversation_forks", conversations=spark.createDataFrame(turns, "conv_id long, turn long"))
    assert len(rows) == len(turns) and max(r[0] for r in rows) > 3


def test_every_defect_of_a_tree(spark, tmp_path):
    rows = agree(spark, tmp_path, "tree_validate", clients=spark.createDataFrame([(k,) for k in range(130) if k not in (64, 74)], "client_id long"))
    assert {r[0] for r in rows} == {"duplicate", "self_parent", "missing_parent", "invalid_depth", "depth_mismatch", "duplicate_position", "cycle"}


def test_definitions_with_parents(spark, tmp_path):
    rows = agree(spark, tmp_path, "code_definitions", items=spark.createDataFrame([(0,), (12,)], "item_id long"))
    assert ("h12", 6, 12, "function", 7, "f12.g", "f12") in rows and len(rows) == 10


def test_tags_after_a_line_that_ends_with_a_word(spark):
    text = "word\n#One #two##no a#no\n" + " ".join(f"#t{k}" for k in range(400))
    got = spark.createDataFrame([(text,)], "t string").select(M.inline_tags(F.col("t")).alias("tags")).first().tags
    assert got == ["one", "two", *(f"t{k}" for k in range(400))]


def test_search_splits_a_text_once(spark):
    docs = spark.createDataFrame([(1, "The cat and"), (2, "and so on and on and the"), (3, "thé"), (4, None), (5, "landtheft")], "doc_id long, text string")
    found = lexical.search(docs, "NEAR(the and, 1) OR (th* NOT cat)")
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 3]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_keyword_reads_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha"), (3, None)], "doc_id long, text string").withColumn("text", F.udf(count)("text"))
    got = lexical.keyword(docs, "alpha beta").collect()
    assert [(r.doc_id, r.matched_tokens) for r in got] == [(1, "alpha,beta")] and seen.value == 3


def test_projection_moves_contents_no_more_than_needed(spark, tmp_path):
    from quarry.plans.projection import Spec, compile_projection, read_objects

    spark.createDataFrame([("a", "x"), ("b", "y")], "k string, t string").createOrReplaceTempView("once_objects")
    sql = "SELECT k AS object_key, t AS content, 'note' AS object_kind FROM once_objects"
    first = compile_projection(spark, f"{tmp_path}/p", Spec("p", sql))
    spark.createDataFrame([("a", "x"), ("c", "z")], "k string, t string").createOrReplaceTempView("once_objects")
    then = compile_projection(spark, f"{tmp_path}/p", Spec("p", sql))
    assert (first.written, then.written, then.removed, then.kept, then.vector_debt) == (2, 1, 1, 1, 2)
    plan = read_objects(spark, f"{tmp_path}/p", columns=["vector"])._jdf.queryExecution().optimizedPlan().toString()
    assert "content#" not in plan.splitlines()[-2] and {r.object_key for r in read_objects(spark, f"{tmp_path}/p").collect()} == {"a", "c"}


def test_neighbours_with_ties_across_blocks(spark):
    import numpy as np

    from quarry.operators import density

    v = np.random.default_rng(4).integers(-1, 2, size=(300, 4)).astype(float)  # few directions, so most distances tie
    rows = [(k, x.tolist(), 1) for k, x in enumerate(v) if x.any()]
    found = density.neighbour_graph(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "label", k=4, block=64)
    got = {a: sorted(b for b in g["b"]) for a, g in found.toPandas().groupby("a")}
    u = np.array([r[1] for r in rows]) / np.linalg.norm([r[1] for r in rows], axis=1, keepdims=True)
    d, ids = density.distances(u @ u.T), [r[0] for r in rows]
    want = {ids[i]: sorted(ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[i, j], ids[j]))[:4]) for i in range(len(ids))}
    assert got == want


def test_shared_makes_pairs_in_parts_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(relational, "PAIRS", 10, raising=False)
    rows = spark.createDataFrame([(n, a) for a in range(6) for n in range(a, a + 5)] + [(None, 1), (3, None)], "n long, a long")
    found = relational.shared(rows, "n", "a", 6, 2)
    assert found.rdd.getNumPartitions() >= 1 and "REPARTITION_BY_NUM, [" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.source, r.target): r.weight for r in found.collect()} == {(x, y): n for x in range(10) for y in range(x + 1, 10) if (n := sum(a <= x and y < a + 5 for a in range(6))) >= 2}


def test_index_is_written_in_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 2000, raising=False)  # bytes, so that a task makes several lists of a term
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rng = random.Random(5)
        rows = [(f"d{k}", " ".join(rng.choices(["red", "the", "Über", "fox", "sky"], k=rng.randint(1, 9))) if k % 40 else None) for k in range(400)] + [("rare", "fox zebra fox")]
        docs = spark.createDataFrame(rows, "name string, text string").repartition(3)
        index = lexical.write_index(docs, f"{tmp_path}/i", buckets=4, spread=2, key="name")
        want = sorted(map(tuple, lexical.postings(docs, "name").select("term", "name", "dl", "tf").collect()))
        assert sorted(map(tuple, index.read("postings").drop("bucket").collect())) == want
        written = spark.read.parquet(f"{tmp_path}/i/postings").count()
        assert 20 < written < len(want) / 4  # a row for a term and chunk, not for every posting
        for words in ("red zebra", "the uber", "fox", "nothing"):
            assert list(map(tuple, lexical.ranked(index, words, key="name").collect())) == list(map(tuple, lexical.keyword(docs, words, key="name").collect())), words
        assert sorted(map(tuple, index.read("terms").drop("bucket").collect())) == sorted(map(tuple, lexical.postings(docs, "name").groupBy("term").count().collect()))
        assert index.read("docs").count() == 401 and tuple(lexical.index_drift(index, docs, key="name").first()) == (0, 0, 0, 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_index_of_texts_without_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " - ")], "doc_id long, text string")
    index = lexical.write_index(docs, f"{tmp_path}/i")
    assert lexical.ranked(index, "red fox").count() == 0 and sorted(map(tuple, index.read("docs").collect())) == [(1, 0), (2, 0), (3, 0)]


def test_index_takes_marks_off_words_not_texts(spark, tmp_path):
    rows = [(k, text) for k, text in enumerate(["Über uber ÜBER fox", "ÿàç yac naïve-NAIVE", "u\u0308ber ß Œuvre 東京 Ａ ñ9", "été,ete;ÉTÉ", "plain words", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lists = lexical._lists(docs, "doc_id", "text")
    assert "translate(" not in lists._jdf.queryExecution().executedPlan().toString()
    assert lists.where("term = 'uber'").select("doc_id", "tf").collect() == [([0], [3])]
    index = lexical.write_index(docs, f"{tmp_path}/i")
    assert sorted(map(tuple, index.read("postings").select("term", "doc_id", "dl", "tf").collect())) == sorted(map(tuple, lexical.postings(docs).select("term", "doc_id", "dl", "tf").collect()))
    assert [r[0] for r in lexical.ranked(index, "ete").collect()] == [3]
