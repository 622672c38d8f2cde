"""Programs, policy, modifiers, pages of results, index, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import markdown as M
from quarry.operators import lexical, refresh, relational
from quarry.plans import programs
from quarry.sources import tables


def test_parse_and_invocation():
    p = programs.parse("-- @name: a\n-- @params: x, y (default: 3), z (default: b c)\nSELECT 1\n--\nFROM t", "n")
    assert (p.name, p.params, p.defaults, p.queries) == ("a", ["x", "y", "z"], {"y": 3, "z": "b c"}, [("default", "SELECT 1\nFROM t")])
    assert programs.invocation("@help a=1 b=x 7 w") == ("orient", [7, "w"], {"a": 1, "b": "x"})
    assert programs.prelude("ATTACH 'a b'; attach 'c' as d; SELECT 1") == ([("a b", "a_b"), ("c", "d")], "SELECT 1")
    with pytest.raises(ValueError):
        programs.prelude("ATTACH 'a'; ATTACH 'a'; SELECT 1")
    assert [programs.bare_text(x) for x in ("how do I", "@orient", "WITH a AS (SELECT 1) SELECT 1", "select 1")] == [True, False, False, False]


def test_policy(spark):
    for sql in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a = 1", "CACHE TABLE x"):
        with pytest.raises(PermissionError):
            programs.read_only(spark, sql)
    programs.read_only(spark, "SELECT 1 UNION SELECT 2 EXCEPT SELECT 3")
    with pytest.raises(ValueError):
        programs.run(spark, programs.parse("-- @params: a\nSELECT :a", "n"))
    good, refused = programs.shipped(spark, [{"name": "ok", "sql": "SELECT 1"}, {"name": "orient", "sql": "SELECT 1"}, {"name": "bad", "sql": "DROP TABLE x"}, {"name": "ok", "sql": "SELECT 2"}, 7], {"orient"})
    assert list(good) == ["ok"] and len(refused) == 4


def test_modifiers():
    assert programs.modifiers("plain words")["similar"] == "plain words"
    m = programs.modifiers("similar:foo decay")
    assert m["similar"] == "foo decay" and m["decay"] is None  # a bare decay ends no text
    assert programs.modifiers("diverse decay")["decay"] == "default"
    assert programs.modifiers("decay:x")["decay"] == "default" and programs.modifiers("kind:a")["extra"] == ["kind:a"]
    assert programs.modifiers("")["similar"] is None


def test_pieces_round_trip():
    rng = random.Random(1)

    def value(depth):
        kind = rng.randint(0, 3 if depth else 1)
        if kind == 0:
            return rng.choice([1, None, True, 2.5, "é" * rng.randint(0, 3000)])
        if kind == 1:
            return "x" * rng.randint(0, 2500)
        return [value(depth - 1) for _ in range(rng.randint(0, 6))] if kind == 2 else {f"k{i}": value(depth - 1) for i in range(rng.randint(0, 6))}

    for _ in range(60):
        v = value(4)
        parts = json.loads(json.dumps(list(refresh.pieces(v))))
        assert refresh.rebuilt(parts) == v
        assert all(len(json.dumps(p.get("value", ""), ensure_ascii=False, separators=(",", ":"))) <= 1200 and len(p.get("string_fragment", "")) <= 900 for p in parts)


def test_index_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alpha beta alpha"), (2, "beta, gamma!"), (3, None)], "doc_id long, text string")
    lexical.write_index(docs, str(tmp_path / "i"), 4)
    got = sorted((r.term, r.doc_id, r.tf, r.dl) for r in lexical.read_index(spark, str(tmp_path / "i"), ["alpha", "gamma"], 4).collect())
    assert got == [("alpha", 1, 2, 3), ("gamma", 2, 1, 2)]
    plan = lexical.read_index(spark, str(tmp_path / "i"), ["alpha"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_explicit_queries(spark):
    docs = spark.createDataFrame([(1, "a red fox runs"), (2, "a fox that is red"), (3, "foxes run"), (4, None)], "doc_id long, text string")
    find = lambda q: sorted(r.doc_id for r in lexical.search(docs, q).collect())
    assert find('"red fox"') == [1] and find("fox red") == [1, 2] and find("fox* NOT red") == [3] and find("NEAR(red fox, 1)") == [1] and find("NEAR(red fox, 2)") == [1, 2]
    assert find("runs OR (foxes AND run)") == [1, 3] and find("") == [] and find("nothing") == []


def test_star_refuses_to_multiply(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    side = spark.createDataFrame([(1, "x", 5)], "k int, v string, w int")
    assert sorted(tuple(r) for r in relational.star(base, [side], "k").collect()) == [(1, "a", 5), (2, "b", None)]
    with pytest.raises(ValueError):
        relational.star(base, [side.unionByName(side)], "k")


def test_folders_lines_and_mounts(spark, tmp_path):
    (tmp_path / "docs" / ".hidden").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("# A é")
    (tmp_path / "docs" / "b.exe").write_text("no")
    (tmp_path / "docs" / ".hidden" / "c.md").write_text("no")
    found = tables.text_folder(spark, str(tmp_path / "docs"))
    assert [(r.content, r.size) for r in found.collect()] == [("# A é", 6)]
    seen = tables.mount(found, "s", F.lit(True), 3).collect()
    assert [(r.scope, r.name, r.chars, r.content) for r in seen] == [("s", "a.md", 5, "# A")]
    (tmp_path / "s.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in tables.session_lines(spark, str(tmp_path / "s.jsonl"), "a int").collect()) == [1, 2]
    assert [json.loads(r.json) for r in tables.as_json(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == [{"a": 1, "b": None}]


def test_markdown_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "####### seven\nx"), (4, "# A\n" + "y" * 5000)], "id int, text string")
    got = sorted((r.id, r.depth) for r in M.sections(rows, "id", "text").collect())
    assert got == [(3, 7), (4, 1)]
    assert M.windows(rows, "id", "text").where("id = 4").count() == 2
