"""Searches inside SQL, the read-only policy, the written index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical
from quarry.plans import policy, programs
from quarry.plans.searches import Searches

TEXTS = [(1, "the red fox"), (2, "a red dog and the red hen"), (3, "blue sky"), (4, None), (5, "Red-Fox fox, the end"), (6, "the sky is red"), (7, "sky"), (8, "green field"), (9, "green hill")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    df.createOrReplaceTempView("documents")
    return df


@pytest.fixture(scope="module")
def searches(spark, docs):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(k, rng.normal(size=4).tolist(), k % 2) for k in range(1, 10)], "vec_id long, embedding array<double>, label int")
    vectors.createOrReplaceTempView("embeddings")
    near = lambda candidates, value: candidates.select("id", (F.col("score") * int(value)).alias("_times"), F.lit("x").alias("_tag"))
    return Searches(spark, vectors, docs, embed=lambda text: np.array([len(text), 1.0, 0, 0]), tokens={"times": near})


def test_calls_are_found_in_the_tree(searches, spark):
    text = """WITH a AS (SELECT id, score FROM vec_ops('centroid:1,2 pool:3')) -- FROM vec_ops('nothing')
        SELECT id, 'FROM vec_ops(''x'')' AS said, (SELECT count(*) FROM keyword('red fox')) AS n FROM a WHERE id IN (SELECT id FROM vec_ops('centroid:1,2 pool:3')) /* keyword('no') */"""
    rows = searches.sql(text).collect()
    want = [r.id for r in searches.vec_ops("centroid:1,2 pool:3").collect()]
    assert sorted(r.id for r in rows) == sorted(want) and len(want) == 3
    assert {r.said for r in rows} == {"FROM vec_ops('x')"} and {r.n for r in rows} == {2}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_vec_ops") or t.name.startswith("_keyword")]


def test_two_calls_of_one_name_keep_apart(searches):
    got = searches.sql("SELECT a.id AS a, b.id AS b FROM vec_ops('centroid:1 pool:1') a CROSS JOIN vec_ops(query => 'centroid:2 pool:1', scope => 'SELECT vec_id FROM embeddings WHERE vec_id = 2') b").collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_dynamic_columns_and_texts(searches):
    got = searches.sql("SELECT * FROM vec_ops(:q)", {"q": "similar:some words pool:2 times:3"})
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["id bigint", "score double", "_z double", "_times double", "_tag string"]
    assert all(abs(r._times - 3 * r.score) < 1e-9 for r in got.collect())
    assert searches.sql("SELECT * FROM vec_ops('centroid:1', 'SELECT vec_id FROM embeddings WHERE false')").count() == 0


@pytest.mark.parametrize(
    "text, error",
    [
        ("SELECT vec_ops('centroid:1')", PermissionError),
        ("SELECT id FROM vec_ops(id)", ValueError),
        ("SELECT id FROM vec_ops('centroid:1', 'SELECT vec_id, label FROM embeddings')", ValueError),
        ("SELECT id FROM vec_ops('centroid:1', 'DROP TABLE embeddings')", PermissionError),
        ("SELECT id FROM vec_ops('centroid:1', 'SELECT id FROM keyword(''red'')')", PermissionError),
        ("SELECT id FROM vec_ops('centroid:1 kind:a')", ValueError),
        ("SELECT id FROM vec_ops('suppres:a centroid:1')", ValueError),
        ("SELECT id FROM vec_ops('centroid:77')", KeyError),
        ("SELECT id FROM vec_ops('')", ValueError),
        ("who's there", ValueError),
        ("SELECT id FROM keyword('a', 'b', 'c')", ValueError),
    ],
)
def test_wrong_calls(searches, text, error):
    with pytest.raises(error):
        searches.sql(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.System', 'getProperty', 'user.home'))",
        "SELECT * FROM text.`/etc/hostname`",
        "WITH a AS (SELECT * FROM parquet.`/tmp/x`) SELECT * FROM documents",
        "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM elsewhere)",
        "SELECT try_reflect('a', 'b') FROM documents",
        "SELECT no_such_function(1)",
        "SELECT * FROM IDENTIFIER('documents')",
        "SELECT * FROM python_worker_logs()",
        "SELECT input_file_name() FROM documents ORDER BY reflect('a', 'b')",
        "SELECT count(*) OVER (ORDER BY java_method('a', 'b')) FROM documents",
        "FROM documents |> SELECT reflect('a', 'b')",
        "EXPLAIN SELECT 1",
        "SHOW TABLES",
        "VALUES (reflect('a', 'b'))",
    ],
)
def test_policy_refuses(spark, docs, text):
    with pytest.raises(PermissionError):
        policy.read_only(spark, text)
    good, refused = programs.shipped(spark, [{"name": "x", "sql": text}], set())
    assert not good and refused


@pytest.mark.parametrize(
    "text",
    [
        "WITH a AS (SELECT doc_id FROM documents) SELECT upper('x'), count(*) FROM a JOIN documents USING (doc_id) GROUP BY 1 HAVING count(*) > 0 ORDER BY 1 LIMIT 1 OFFSET 0",
        "SELECT e FROM documents LATERAL VIEW explode(split(text, ' ')) AS e",
        "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY text) FROM documents UNION ALL VALUES (1, 2)",
        "SELECT * FROM (SELECT doc_id, text FROM documents) PIVOT (count(text) FOR doc_id IN (1, 2)), range(3)",
        "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT * FROM t",
        "SELECT DISTINCT doc_id FROM documents TABLESAMPLE (50 PERCENT) EXCEPT SELECT 3",
    ],
)
def test_policy_lets_queries_pass(spark, docs, text):
    policy.read_only(spark, text)
    spark.sql(text).collect()


def test_federation_leaves_strings_alone(spark, docs):
    corpora = {"mine": {"docs": docs.limit(0).unionByName(docs.where("doc_id = 1"))}}
    got = programs.federated(spark, "ATTACH 'mine'; SELECT 'mine.docs' AS said, d.doc_id, mine.doc_id AS x FROM mine.docs d JOIN mine.docs AS mine ON d.doc_id = mine.doc_id -- mine.docs", corpora)
    assert [tuple(r) for r in got.collect()] == [("mine.docs", 1, 1)]
    with pytest.raises(KeyError):
        programs.federated(spark, "ATTACH 'mine'; SELECT * FROM mine.other", corpora)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_mine")]


def test_index_ranks_like_the_scan(spark, docs, tmp_path):
    index = lexical.write_index(docs, str(tmp_path / "i"), buckets=4, spread=2)
    for words in ("red fox", "red zebra", "the red sky", "zebra", "", "FOX"):
        want = sorted(map(tuple, lexical.keyword(docs, words).collect()))
        assert sorted(map(tuple, lexical.ranked(index, words).collect())) == want, words
        scope = docs.where("doc_id > 2").select("doc_id")
        assert sorted(map(tuple, lexical.ranked(index, words, scope).collect())) == sorted(map(tuple, lexical.keyword(docs, words, F.col("doc_id") > 2).collect())) == sorted(map(tuple, lexical.keyword(docs, words, scope).collect()))
    assert lexical.ranked(index, "red").count() == 4 and len(set(lexical.ranked(index, "red").select("doc_id").collect())) == 4
    files = index.of("postings", ["fox"]).inputFiles()
    assert files and {f.split("bucket=")[1].split("/")[0] for f in files if "bucket=" in f} >= {str(b) for b in [r[0] for r in spark.createDataFrame([("fox",)], "term string").select(lexical._bucket(4)).collect()]}
    plan = index.of("postings", ["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") or "bucket" in plan.split("PartitionFilters")[1][:80]


def test_index_upkeep(spark, docs, tmp_path):
    index = lexical.write_index(docs.where("doc_id < 6"), str(tmp_path / "i"), buckets=4)
    assert tuple(lexical.index_drift(index, docs).first()) == (4, 0, 0, 0)
    lexical.append_index(index, docs)
    assert tuple(lexical.index_drift(index, docs).first()) == (0, 0, 0, 0)
    assert sorted(map(tuple, lexical.ranked(index, "red sky").collect())) == sorted(map(tuple, lexical.keyword(docs, "red sky").collect()))
    before = index.read("docs").count()
    lexical.append_index(index, docs)
    assert index.read("docs").count() == before
    changed = docs.where("doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 7, "sky sky").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(None, "x"), (8, "y")], "doc_id long, text string"))
    assert tuple(lexical.index_drift(index, changed).first())[1:3] == (1, 1)


def test_near_and_messages(spark, docs):
    find = lambda q: sorted(r.doc_id for r in lexical.search(docs, q).collect())
    assert find("NEAR(red the fox, 2)") == [1, 5] and find("NEAR(dog the hen, 1)") == [] and find("NEAR(dog the hen, 2)") == [2]
    for q in ("the AND", "a OR", "NOT", "NEAR(one)", "(red", "red)", "OR red"):
        with pytest.raises(ValueError):
            lexical.search(docs, q)
