"""Versions, projections, the vector store and replaced files: what is rewritten, what stays, what a dead writer leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import refresh
from quarry.operators.semantic import Modulation, vec_ops
from quarry.operators.vector_store import Refused, VectorStore
from quarry.plans import projection
from quarry.plans.projection import ProjectionError, Spec, compile_projection, read_objects, read_part
from quarry.sources import tables
from quarry.sources.versions import Conflict, Versions
from quarry.streaming.replace import ReplacedFiles


def test_versions(spark, tmp_path):
    a, b = (Versions(spark, str(tmp_path / "v")) for _ in range(2))
    assert a.latest() == (0, {})
    folder = a.folder()
    spark.range(3).write.parquet(a.at(folder))
    assert a.commit({"data": [folder]}, 0) == 1 and b.latest() == (1, {"data": [folder]})
    lost = b.folder()
    spark.range(4).write.parquet(b.at(lost))  # its writer dies
    assert a.latest()[1]["data"] == [folder]
    assert a.commit({"data": [folder], "n": 2}, 1) == 2
    with pytest.raises(Conflict):
        b.commit({"data": [lost]}, 1)
    assert a.vacuum() == 1 and spark.read.parquet(a.at(folder)).count() == 3
    for n in range(2, 5):
        a.commit({"data": [folder], "n": n}, n)
    a.vacuum(keep=2)
    assert a.numbers() == [4, 5]


@pytest.fixture
def corpus(spark):
    def put(objects, references=(), tree=()):
        spark.createDataFrame(objects, "k string, text string, kind string, n int").createOrReplaceTempView("p_objects")
        spark.createDataFrame(list(references), "k string, cell string, target string, relation string").createOrReplaceTempView("p_refs")
        spark.createDataFrame(list(tree), "child string, parent string, position int").createOrReplaceTempView("p_tree")

    return put


def spec(**more):
    return Spec(
        "p", "SELECT k AS object_key, text AS content, kind AS object_kind, n AS source_order FROM p_objects", "SELECT k AS object_key, cell AS target_cell_id, target AS target_object_id, relation FROM p_refs",
        "SELECT child AS child_key, parent AS parent_key, 'part' AS relation, position FROM p_tree", **more,
    )


def embed(rows):
    return rows.select("object_key", F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")).alias("vector"))


def test_only_changed_rows_are_written(spark, corpus, tmp_path):
    path = str(tmp_path / "p")
    rows = [(f"o{i}", f"text {i}", "note", i) for i in range(300)]
    refs = [("o1", "c", "x", "cites"), ("o1", "c", "y", "cites")]
    tree = [(f"o{i}", f"o{i // 2}", i) for i in range(1, 40) if i // 2 != i]
    tree = [t for t in tree if t[0] != "o0" and t[1] != t[0]]
    corpus(rows, refs, tree)
    targets = spark.createDataFrame([("c", "x")], "target_cell_id string, target_object_id string")
    first = compile_projection(spark, path, spec(targets=targets, embed=embed))
    assert (first.version, first.objects, first.written, first.removed, first.kept, first.references, first.unresolved, first.tree_edges, first.vector_debt) == (1, 300, 300, 0, 0, 2, 1, len(tree), 0)
    again = compile_projection(spark, path, spec(targets=targets, embed=embed))
    assert (again.version, again.written, again.content_signature) == (1, 0, first.content_signature)
    rows[7], rows[8], rows[9] = ("o7", "text seven", "note", 7), ("o8", "text 8", "card", 8), ("new", "x", "note", 9)
    corpus(rows, refs, tree[:8] + [t for t in tree[9:] if t[0] != "o9" and t[1] != "o9"])
    second = compile_projection(spark, path, spec(targets=targets))
    held = {r.object_key: r for r in read_objects(spark, path).collect()}
    by_version = {k for k, r in held.items() if r.version == 2}
    edges = {x for t in tree[8:9] + [t for t in tree if "o9" in t[:2]] for x in t[:2]}
    assert by_version == ({"o7", "o8", "new"} | edges) - {"o9"} and "o9" not in held
    assert (second.written, second.removed, second.kept) == (len(by_version), 1, 300 - len(by_version))
    written = spark.read.parquet(*(f"{path}/{s}" for s in Versions(spark, path).latest()[1]["segments"][1:]))
    assert written.count() == second.written + 1
    assert held["o7"].vector is None and held["new"].vector is None and list(held["o8"].vector) == [6.0, 1.0] and second.vector_debt == 2
    assert read_objects(spark, path, 1).count() == 300 and read_part(spark, path, "references").count() == 2
    corpus(rows[::-1], refs[::-1], (tree[:8] + [t for t in tree[9:] if "o9" not in t[:2]])[::-1])
    third = compile_projection(spark, path, spec(targets=targets))
    assert third.version == 2 and third.written == 0 and third.content_signature == second.content_signature != first.content_signature


def test_segments_are_merged(spark, corpus, tmp_path):
    path, rows = str(tmp_path / "p"), [(f"o{i}", "a", "note", i) for i in range(20)]
    for k in range(5):
        rows[k] = (f"o{k}", f"changed {k}", "note", k)
        corpus(rows)
        compile_projection(spark, path, spec(), most_segments=3)
    assert len(Versions(spark, path).latest()[1]["segments"]) == 2
    assert {r.object_key: r.content for r in read_objects(spark, path).collect()} == {r[0]: r[1] for r in rows}


@pytest.mark.parametrize(
    "objects, references, tree",
    [
        ([("a", "x", "k", 1), ("a", "y", "k", 2)], [], []),
        ([(None, "x", "k", 1)], [], []),
        ([("a", None, "k", 1)], [], []),
        ([("a", "x", "k", 1)], [("b", "c", "t", "r")], []),
        ([("a", "x", "k", 1)], [("a", None, "t", "r")], []),
        ([("a", "x", "k", 1), ("b", "x", "k", 1)], [], [("a", "b", 1), ("b", "a", 1)]),
        ([("a", "x", "k", 1), ("b", "x", "k", 1), ("c", "x", "k", 1)], [], [("a", "b", 1), ("a", "c", 1)]),
        ([("a", "x", "k", 1)], [], [("a", "a", 1)]),
        ([("a", "x", "k", 1)], [], [("a", "z", 1)]),
    ],
)
def test_broken_selections_leave_the_last_state(spark, corpus, tmp_path, objects, references, tree):
    path = str(tmp_path / "p")
    corpus([("a", "good", "k", 1)])
    compile_projection(spark, path, spec())
    corpus(objects, references, tree)
    with pytest.raises(ProjectionError):
        compile_projection(spark, path, spec())
    assert [r.content for r in read_objects(spark, path).collect()] == ["good"]
    with pytest.raises(ProjectionError):
        compile_projection(spark, path, Spec("p", "SELECT k FROM p_objects"))
    with pytest.raises(PermissionError):
        compile_projection(spark, path, Spec("p", "DROP TABLE p_objects"))


def test_failing_embedder_leaves_debt(spark, corpus, tmp_path):
    corpus([])
    assert compile_projection(spark, str(tmp_path / "e"), spec()).objects == 0
    corpus([("a", "x", "k", 1)])

    def fail(rows):
        raise RuntimeError("no model")

    assert compile_projection(spark, str(tmp_path / "p"), spec(embed=fail)).vector_debt == 1
    long_chain = spark.range(1, 40).select(F.col("id").cast("string").alias("child_key"), (F.col("id") - 1).cast("string").alias("parent_key"))
    assert projection.looped(long_chain).count() == 0


def vectors(spark, ids, seed=0, d=5):
    rng = np.random.default_rng(seed)
    table = {i: rng.normal(size=d).tolist() for i in range(200)}
    return spark.createDataFrame([(i, table[i]) for i in ids] + [(None, table[0]), (9999, None), (9998, [1.0] * (d - 1))], "vec_id long, embedding array<double>")


def test_store_appends_and_rebuilds(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"), most_rows=20)
    assert store.refresh(vectors(spark, range(100))).action == "rebuilt"
    assert store.refresh(vectors(spark, range(100))).action == "fresh"
    got = store.refresh(vectors(spark, [*range(110), 105]))
    assert (got.action, got.rows) == ("appended", 10) and {r.segment for r in store.read().select("segment").distinct().collect()} == {1, 2}
    whole = VectorStore(spark, str(tmp_path / "w"))
    whole.refresh(vectors(spark, range(110)))
    ask = Modulation(centroid=(3, 107), suppress=(5,), limit=12)
    assert vec_ops(store.read(), ask).collect() == vec_ops(whole.read(), ask).collect()
    assert tuple(store.drift(vectors(spark, [*range(2, 110), 120])).first()) == (1, 2)
    assert (store.refresh(vectors(spark, range(2, 110))).reason, store.read().count()) == ("vectors went", 108)
    assert store.refresh(vectors(spark, range(2, 200))).reason == "many are new"


def test_move_is_refused_or_served(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.refresh(vectors(spark, range(50)))
    before = sorted(map(tuple, store.read().select("vec_id", F.col("embedding")[0]).collect()))
    texts = spark.createDataFrame([(i, "t" * (i + 1)) for i in range(50)], "vec_id long, text string")
    n = F.length("text").cast("double")
    good = lambda t: t.select("vec_id", F.array(F.cos(n), F.sin(n), F.cos(n * 0.37)).alias("embedding"))
    bad = [
        lambda t: good(t).where("vec_id <> 7"),
        lambda t: good(t).unionByName(good(t).limit(1)),
        lambda t: good(t).withColumn("embedding", F.when(F.col("vec_id") == 7, F.slice("embedding", 1, 2)).otherwise(F.col("embedding"))),
        lambda t: good(t).withColumn("embedding", F.when(F.col("vec_id") == 7, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))),
        lambda t: good(t).withColumn("embedding", F.transform("embedding", lambda x: x + F.rand() * 50)),
    ]
    for embedder in bad:
        with pytest.raises(Refused):
            store.move(texts, embedder, "new")
        assert sorted(map(tuple, store.read().select("vec_id", F.col("embedding")[0]).collect())) == before
    done = store.move(texts, good, "new")
    assert (done.rows, store.versions.latest()[1]["model"], store.versions.latest()[1]["dims"]) == (50, "new", 3)


def test_files_are_replaced_whole(spark, tmp_path):
    schema = "path string, arrival int, line int, text string, ok boolean"
    files = ReplacedFiles(spark, str(tmp_path / "f"), good=F.col("ok"), buckets=4)
    held = lambda: sorted((r.path, r.line, r.text) for r in files.read().collect())
    files(spark.createDataFrame([(f"f{i}", 1, k, f"v1 {k}", True) for i in range(6) for k in range(3)] + [(None, 1, 1, "x", True)], schema), 0)
    assert held() == sorted((f"f{i}", k, f"v1 {k}") for i in range(6) for k in range(3))
    folders = dict(Versions(spark, str(tmp_path / "f")).latest()[1]["buckets"])
    batch = [("f1", 2, 0, "v2", True), ("f2", 2, 0, "v2", True), ("f2", 2, 1, "broken", None), ("f3", 2, 0, "v2", True), ("f3", 3, 0, "v3 broken", False), ("f4", 2, 0, "old", True), ("f4", 5, 0, "v5", True)]
    before = files.read()
    files(spark.createDataFrame(batch, schema), 1)
    want = [("f1", 0, "v2"), ("f3", 0, "v2"), ("f4", 0, "v5")] + [(f"f{i}", k, f"v1 {k}") for i in (0, 2, 5) for k in range(3)]
    assert held() == sorted(want)
    assert before.count() == 18  # a reader of the former state goes on
    now = Versions(spark, str(tmp_path / "f")).latest()[1]["buckets"]
    touched = {str(r[0]) for r in spark.createDataFrame([("f1",), ("f3",), ("f4",)], "path string").select(files._bucket()).collect()}
    assert {b for b in folders if now[b] != folders[b]} == touched & set(folders)
    files(spark.createDataFrame([("f1", 9, 0, "again", True)], schema), 1)  # the batch is repeated after a restart
    assert held() == sorted(want)


def test_dead_write_leaves_the_former_state(spark, tmp_path):
    schema = "path string, arrival int, text string"
    files = ReplacedFiles(spark, str(tmp_path / "f"))
    files(spark.createDataFrame([("a", 1, "one"), ("b", 1, "one")], schema), 0)
    boom = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        files(spark.createDataFrame([("a", 2, "two")], schema).withColumn("text", boom("text")), 1)
    assert sorted(map(tuple, files.read().select("path", "text").collect())) == [("a", "one"), ("b", "one")]
    files(spark.createDataFrame([("a", 2, "two")], schema), 1)
    assert sorted(map(tuple, files.read().select("path", "text").collect())) == [("a", "two"), ("b", "one")]


def test_stream_replaces_files(spark, tmp_path):
    schema = "path string, arrival int, text string, gone boolean"
    source = tmp_path / "in"
    for k, rows in enumerate([[("a", 1, "one", False), ("b", 1, "one", False)], [("a", 2, "two", False)], [("b", 3, None, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        files = ReplacedFiles(spark, str(tmp_path / "f"), removed="gone")
        spark.readStream.schema(schema).json(str(source)).writeStream.foreachBatch(files).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in files.read().select("path", "text").collect()] == [("a", "two")]
    assert Versions(spark, str(tmp_path / "f")).latest()[0] == 3


def test_audit_log(spark, tmp_path):
    log = Versions(spark, str(tmp_path / "a"))
    look = lambda rows, at: refresh.audit(log, spark.createDataFrame(rows, "k int, v string"), ["k"], at)
    assert look([(1, "a"), (2, "b"), (2, "c"), (None, "x")], 1) == 2
    assert look([(1, "a"), (2, "b")], 2) == 0
    assert look([(1, None), (3, "d")], 3) == 3
    assert look([(1, None), (2, "b"), (3, "d")], 4) == 1
    got = sorted((r.k, r.at, r.v, r.change) for r in refresh.observations(log).collect())
    assert got == [(1, 1, "a", "new"), (1, 3, None, "changed"), (2, 1, "b", "new"), (2, 3, "b", "gone"), (2, 4, "b", "new"), (3, 3, "d", "new")]
    assert sorted(map(tuple, refresh.current(log, ["k"]).collect())) == [(1, None), (2, "b"), (3, "d")]


def test_text_folder_excludes(spark, tmp_path):
    for name in ("a.md", "sub/b.md", "sub/deep/c.md", "build/d.md", ".git/e.md", "sub/.f.md", "g.py", "h.exe", "drafts/i.md", "drafts/x/j.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    read = lambda **more: sorted((r.path.split(tmp_path.name + "/")[1], r.kind) for r in tables.text_folder(spark, str(tmp_path), **more).collect())
    assert [p for p, _ in read()] == ["a.md", "build/d.md", "drafts/i.md", "drafts/x/j.md", "sub/b.md", "sub/deep/c.md"]
    assert read(extensions=("md", "py"), pruned=tables.PRUNED, excludes=("drafts/*", "sub/**/c.md")) == [("a.md", "note"), ("drafts/x/j.md", "note"), ("g.py", "code"), ("sub/b.md", "note")]
    assert [p for p, _ in read(excludes=("drafts/**",))] == ["a.md", "build/d.md", "sub/b.md", "sub/deep/c.md"]
