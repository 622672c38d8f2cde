"""Small literal inputs of operators that are registered over the given tables, each with the rows it must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import code as C
from quarry.functions import markdown as M
from quarry.functions import scalars as S
from quarry.operators import graph, refresh, walks
from quarry.plans import programs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _value(x) -> str:
    if x is None:
        return "NULL"
    return str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def expect(columns: str, rows: list[tuple]):
    """Registers a query with the rows that it must give; ``columns`` as in 'a int, b string'."""
    typed = [c.split() for c in columns.split(", ")]
    names = ", ".join(f'"{n}"' for n, _ in typed)
    head = ", ".join(f'CAST("{n}" AS {_KINDS[k]}) AS "{n}"' for n, k in typed)
    body = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(spark).select(*(F.col(n).cast(k).alias(n) for n, k in typed))
        ORACLES[f.__name__] = f"SELECT {head} FROM (VALUES {body}) t({names})"
        return f

    return add


def rows(spark: SparkSession, columns: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), columns)


def scalar(spark: SparkSession, values: list, f, kind: str = "string") -> DataFrame:
    """(k, out) of a function of one column x over a list."""
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").select("k", f(F.col("x")).alias("out"))


@expect("k int, out string", [(0, "# A\nx\n## B"), (1, "# T\n## A"), (2, "plain"), (3, "#tag\n# A")])
def md_promote_headers(spark):
    return scalar(spark, ["## A\nx\n### B", "# T\n## A", "plain", "#tag\n## A"], M.promote_headers)


@expect("k int, block string, body string", [(0, "a: 1", "text"), (1, None, "no"), (2, None, "---\nnever closed")])
def md_front_matter(spark):
    return scalar(spark, ["---\na: 1\n---\n\ntext", "no", "---\nnever closed"], M.front_matter).select("k", "out.*")


_NOTE = "intro\n# One\na\n## Two\nb\n# \n#### Deep\nc\n## Three\n\n# Four\nd"


@expect("id int, position int, title string, depth int, body string", [(1, 0, "", 0, "intro"), (1, 1, "One", 1, "# One\na"), (1, 2, "Two", 2, "## Two\nb"), (1, 3, "", 1, "#"), (1, 4, "Deep", 4, "#### Deep\nc"), (1, 5, "Three", 2, "## Three"), (1, 6, "Four", 1, "# Four\nd")])
def doc_sections(spark):
    return M.sections(rows(spark, "id int, text string", (1, _NOTE), (2, ""), (3, None)), "id", "text")


@expect("id int, position int, title string, body string", [(1, 0, "", "intro\n# One\na"), (1, 1, "Two", "## Two\nb\n# \n#### Deep\nc"), (1, 2, "Three", "## Three\n\n# Four\nd")])
def md_sections_at_level(spark):
    return M.sections(rows(spark, "id int, text string", (1, _NOTE)), "id", "text", 2, deep=False)


@expect("position int, chain string, parent int", [(0, "", None), (1, "One", 0), (2, "One > Two", 1), (3, "", 0), (4, " > Deep", 3), (5, " > Three", 3), (6, "Four", 0)])
def md_heading_tree(spark):
    parts = M.sections(rows(spark, "id int, text string", (1, _NOTE)), "id", "text")
    return M.heading_tree(parts, "id").select("position", F.array_join("chain", " > ").alias("chain"), "parent")


@expect("k int, out boolean", [(0, True), (1, True), (2, False), (3, True), (4, True)])
def md_trivial_sections(spark):
    return scalar(spark, ["short", "TODO:", "a section that holds quite enough text", "-" * 40, "[[a link that is long enough to count]]"], M.trivial)


@expect("k int, out boolean", [(0, True), (1, False), (2, False), (3, True)])
def md_cjk_dominant(spark):
    return scalar(spark, ["中文 ab", "中 abcdefgh", "", "カタカナ한국"], M.cjk_dominant)


@expect("id int, position int, size int", [(1, 0, 2000), (1, 1, 1200), (2, 0, 4000), (2, 1, 600), (3, 0, 5)])
def md_windows(spark):
    return M.windows(rows(spark, "id int, text string", (1, "字" * 3000), (2, "x" * 4400), (3, "short"), (4, "")), "id", "text").select("id", "position", F.length("piece").alias("size"))


@expect("k int, out string", [(0, "see B and Page > Head, x"), (1, "Head"), (2, "a b"), (3, "body")])
def md_clean(spark):
    return scalar(spark, ["see [[A|B]] and [[Page#Head]],<!-- no\n--> x", "[[#Head]]", "a <% t %>{{v}}b #tag", "body\n[^1]: note"], M.clean)


@expect("k int, out string", [(0, "a  b"), (1, "x\n\n\ny"), (2, "- a\n    - b"), (3, "p\n    not code")])
def md_strip_code(spark):
    return scalar(spark, ["a ```\n#no\n``` b", "x\n\n    code\ny", "- a\n    - b", "p\n    not code"], M.strip_code)


@expect("k int, out string", [(0, "A,B/C"), (1, ""), (2, "Note")])
def md_wikilinks(spark):
    return scalar(spark, ["[[A|x]] [[A]] [[B/C#h]] `[[code]]`", '[[ -z "$X" ]] [[<% t %>]] [[a == b]]', "```\n[[x]]\n```\n[[Note]]"], lambda c: F.array_join(M.wikilinks(c), ","))


@expect("k int, out string", [(0, "one,two/three"), (1, "été"), (2, "faced"), (3, "")])
def md_inline_tags(spark):
    return scalar(spark, ["#One (#two/three) #one", "#Été w#x ##no #1", "#fff #d4763c #faced", "`#code` plain"], lambda c: F.array_join(M.inline_tags(c), ","))


@expect("k int, out string", [(0, "a,b,c")])
def md_merge_tags(spark):
    return scalar(spark, ["x"], lambda c: M.merge_tags(F.array(F.lit("B "), F.lit("a")), F.array(F.lit("c"), F.lit("A"), F.lit(" "))))


@expect("k int, key string, value string", [(0, "due", "tomorrow"), (0, "by", "me"), (0, "note", "in text")])
def md_fields(spark):
    return scalar(spark, ["Due:: tomorrow\n  by:: me\nsome [Note:: in text] more\n`no:: code`"], M.fields).select("k", F.explode("out").alias("f")).select("k", "f.*")


_VAULT = [("a/One.md", "One", ["First"], "Title One"), ("b/One.md", "One", None, "Other"), ("c/d/Été.md", "Été", ["Summer"], "Été")]
_LINKS = [("x.md", "a/One"), ("x.md", "d/Été"), ("x.md", "one"), ("x.md", "first"), ("x.md", "title one"), ("x.md", "Ete"), ("x.md", "nowhere"), ("a/One.md", "first"), ("y.md", "nowhere")]


@expect("from_path string, target string, to_path string, step string", [("x.md", "a/One", "a/One.md", "exact"), ("x.md", "d/Été", "c/d/Été.md", "suffix"), ("x.md", "one", "a/One.md", "basename"), ("x.md", "first", "a/One.md", "alias"), ("x.md", "title one", "a/One.md", "title"), ("x.md", "Ete", None, None), ("x.md", "nowhere", None, None), ("a/One.md", "first", None, None), ("y.md", "nowhere", None, None)])
def wikilink_resolve(spark):
    return M.resolve_links(rows(spark, "from_path string, target string", *_LINKS), rows(spark, "path string, stem string, aliases array<string>, title string", *_VAULT))


@expect("target string, wanted_by string, n long", [("nowhere", "x.md,y.md", 2), ("first", "a/One.md", 1), ("Ete", "x.md", 1)])
def ghost_notes(spark):
    found = M.resolve_links(rows(spark, "from_path string, target string", *_LINKS), rows(spark, "path string, stem string, aliases array<string>, title string", *_VAULT))
    return found.where("to_path IS NULL").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("from_path")), ",").alias("wanted_by"), F.count("*").alias("n"))


@expect("k int, out string", [(0, "Bash"), (1, "Edit"), (2, "custom"), (3, "unknown"), (4, "unknown")])
def tool_names(spark):
    return scalar(spark, ["local_shell", "apply_patch", "custom", "", None], S.canonical_tool)


@expect("k int, out string", [(0, "a.py,b c.py,d"), (1, "")])
def patch_files(spark):
    return scalar(spark, ["*** Update File: a.py\n@@\n*** Add File: b c.py \n+*** Add File: no\n*** Delete File: d", None], lambda c: F.array_join(S.patch_paths(c), ","))


@expect("k int, out string", [(0, "def f():\n  pass\nx 1\ty")])
def strip_line_numbers(spark):
    return scalar(spark, ["  1\tdef f():\n 20\t  pass\nx 1\ty"], S.strip_line_numbers)


@expect("path string, cwd string, out string, name string", [("a/../b.py", "/w", "/w/b.py", "b.py"), ("/x//y/./z", None, "/x/y/z", "z"), ("../q", "/w/v", "/w/q", "q"), ("../q", None, "../q", "q"), ("/../r", None, "/r", "r"), ("", "/w", None, None)])
def path_normalise(spark):
    d = rows(spark, "path string, cwd string", ("a/../b.py", "/w"), ("/x//y/./z", None), ("../q", "/w/v"), ("../q", None), ("/../r", None), ("", "/w"))
    return d.withColumn("out", S.normalise_path(F.col("path"), F.col("cwd"))).withColumn("name", S.basename(F.col("out")))


@expect("k int, out string", [(0, "search://web?q=two%20words"), (1, ""), (2, "search://web?q=caf%C3%A9%20%26%20co")])
def search_pseudo_url(spark):
    return scalar(spark, ["  Two   words ", "", "Café & Co"], S.search_url)


@expect("k int, out string, shown string", [(0, "240131", "2024-01-31"), (1, None, None), (2, "240229-2359", "2024-02-29 23:59"), (3, "20240301", "2024-03-01"), (4, "2024-03-01T10:00", "2024-03-01T10:00"), (5, None, None), (6, None, None)])
def file_dates(spark):
    return scalar(spark, ["240131", "240231", "240229-2359", "20240301", "2024-03-01T10:00", "20990101", "soon"], lambda c: S.file_date(c, F.lit("2024-06-01").cast("date"))).withColumn("shown", S.show_date(F.col("out")))


@expect("k int, date string, title string", [(0, "240131", "my plan"), (1, None, "notes v2"), (2, "20240301", "a")])
def name_dates(spark):
    d = rows(spark, "k int, x string", (0, "240131_my-plan.md"), (1, "notes_v2.txt"), (2, "20240301 a"))
    return d.select("k", S.name_date(F.col("x")).alias("date"), S.name_title(F.col("x")).alias("title"))


@expect("kind string, subject string, raw string", [("invalid_file_date", "b", "241301")])
def file_date_defects(spark):
    d = rows(spark, "subject string, raw string", ("a", "240131"), ("b", "241301"), ("c", None), ("d", ""))
    return d.where((F.coalesce("raw", F.lit("")) != "") & S.file_date(F.col("raw"), F.lit("2024-06-01").cast("date")).isNull()).select(F.lit("invalid_file_date").alias("kind"), "subject", "raw")


@expect("k int, out long", [(0, 1704067200), (1, 1704067200), (2, 1704103200), (3, 1704103200), (4, 1704103200), (5, None), (6, 12)])
def timestamp_coerce(spark):
    return scalar(spark, ["1704067200", "2024-01-01", "2024-01-01 10:00:00", "2024-01-01 (Mon) 10:00:00", "2024-01-01T10:00:00", "noon", "12.9"], S.coerce_timestamp)


@expect("k int, out boolean", [(0, True), (1, True), (2, False), (3, True), (4, False)])
def runtime_noise(spark):
    return scalar(spark, ["", "[debug] a\n[debug] b\nreal text\nmore\nand more", "[debug] a\nb\nc\nd", "[debug] a\nb", "plain text"], lambda c: S.noise(c, ("[debug]", "[trace]")))


@expect("k int, a string, b string", [(0, "one two...", "...o three"), (1, "short", "short")])
def text_clips(spark):
    d = rows(spark, "k int, x string", (0, "one\ntwo three"), (1, "short"))
    return d.select("k", S.clip(F.col("x"), 10).alias("a"), S.clip_left(S.clip(F.col("x"), 99), 10).alias("b"))


@expect("k int, out string", [(0, "body\nmore"), (1, "plain"), (2, "")])
def strip_first_heading(spark):
    return scalar(spark, ["# Head\nbody\nmore", "plain", "# only"], S.strip_heading)


@expect("k int, out boolean", [(0, True), (1, True), (2, False), (3, False)])
def issue_questions(spark):
    return scalar(spark, ["Does it run?", "How to build", "Crash on start", None], S.asks)


@expect("k int, offset double, local string, open boolean", [(0, -5.0, "2024-01-15 07:00", False), (1, -4.0, "2024-07-15 11:00", True)])
def zone_times(spark):
    d = rows(spark, "k int, s long", (0, 1705320000), (1, 1721055600)).withColumn("ts", F.timestamp_seconds("s"))
    zone = "America/New_York"
    return d.select("k", S.offset_hours(zone, F.col("ts")).alias("offset"), F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd HH:mm").alias("local"), S.in_call_window(zone, F.col("ts")).alias("open"))


_SYMBOLS = [("d1", "f"), ("d2", "g"), ("d3", "h"), ("d4", "dup"), ("d5", "dup"), ("d6", "k")]
_CALLS = [("d2", "f"), ("d3", "g"), ("d4", "g"), ("d6", "dup"), ("d1", "h"), ("d6", "nothing"), ("d3", "h")]


def _code(spark):
    return rows(spark, "def_id string, name string", *_SYMBOLS), rows(spark, "caller_id string, callee_name string", *_CALLS)


@expect("id string, name string, depth int, resolution_state string, truncated boolean", [("d2", "g", 1, "unique", False), ("d3", "h", 2, "unique", False), ("d4", "dup", 2, "ambiguous", False)])
def call_impact_bounded(spark):
    return walks.impact(*_code(spark), "f", 5)


@expect("id string, depth int, truncated boolean", [("d2", 1, True)])
def call_impact_cut(spark):
    return walks.impact(*_code(spark), "f", 1)


@expect("caller_id string, callee_name string, candidates long, state string, def_id string", [("d2", "f", 1, "unique", "d1"), ("d3", "g", 1, "unique", "d2"), ("d4", "g", 1, "unique", "d2"), ("d6", "dup", 2, "ambiguous", None), ("d1", "h", 1, "unique", "d3"), ("d6", "nothing", 0, "unresolved", None), ("d3", "h", 1, "unique", "d3")])
def call_resolution(spark):
    return walks.callers(*_code(spark))


@expect("source string, final string, hops int", [("a", "c", 2), ("b", "c", 1), ("x", "y", 1), ("y", "x", 1)])
def redirect_chains(spark):
    return walks.follow(rows(spark, "source string, target string", ("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")))


@expect("node string, distance int", [("leaf", 0), ("mid", 1), ("root", 2)])
def ancestor_lineage(spark):
    return walks.lineage(rows(spark, "child string, parent string", ("leaf", "mid"), ("mid", "root"), ("root", None), ("other", "root")), "leaf")


@expect("session string, id string, branch int, forks long", [("s", "1", 0, 2), ("s", "2", 0, 2), ("s", "3", 1, 2), ("s", "4", 0, 2), ("s", "5", 1, 2), ("s", "6", 2, 2), ("t", "7", 0, 0), ("t", "8", 1, 0)])
def conversation_forks(spark):
    return walks.branches(rows(spark, "session string, id string, parent string, at int", ("s", "1", None, 1), ("s", "2", "1", 2), ("s", "3", "1", 3), ("s", "4", "2", 4), ("s", "5", "3", 5), ("s", "6", "3", 6), ("t", "7", "gone", 1), ("t", "8", "gone", 2)))


@expect("node string, parent string, depth int, children long, orchestrator int", [("r", None, 0, 6, 1), *((f"c{k}", "r", 1, 0, 0) for k in range(5)), ("c5", "r", 1, 1, 0), ("g", "c5", 2, 0, 0), ("u", "v", -1, 1, 0), ("v", "u", -1, 1, 0)])
def bfs_depth(spark):
    return walks.delegation(rows(spark, "parent string, child string", *(("r", f"c{k}") for k in range(6)), ("c5", "g"), ("u", "v"), ("v", "u")))


@expect("id string, defect string", [("b", "duplicate"), ("c", "self_parent"), ("d", "missing_parent"), ("e", "depth_mismatch"), ("f", "duplicate_position"), ("g", "duplicate_position"), ("c", "cycle"), ("x", "cycle"), ("y", "cycle"), ("n", "invalid_depth"), ("n", "depth_mismatch")])
def tree_validate(spark):
    d = rows(spark, "id string, parent_id string, depth int, position int", ("a", None, 0, 0), ("b", "a", 1, 0), ("b", "a", 1, 0), ("c", "c", 1, 0), ("d", "gone", 1, 0), ("e", "a", 3, 1), ("f", "a", 1, 2), ("g", "a", 1, 2), ("x", "y", None, 0), ("y", "x", None, 0), ("n", "a", -1, 9))
    return walks.tree_defects(d)


@expect("cell string, kept long, owes int", [("a", 2, 0), ("b", 1, 1)])
def queue_overflow(spark):
    return refresh.overflow(rows(spark, "cell string, at int", ("a", 1), ("b", 2), ("a", 3), ("b", 4)), "cell", "at", 3)


@expect("id string", [("gone",)])
def delete_reconcile(spark):
    kept = rows(spark, "id string", ("here",), ("gone",))
    nothing = refresh.prune(kept, kept.limit(0), "id")
    return refresh.prune(kept, rows(spark, "id string", ("here",), ("new",)), "id").unionByName(nothing)


@expect("id int, v string", [(3, "c")])
def idempotent_ingest(spark):
    return refresh.ingest(rows(spark, "id int, v string", (1, "a"), (2, "b")), rows(spark, "id int, v string", (2, "z"), (3, "c"), (3, "c")), ["id"])


@expect("session string, n int", [("s", 3), ("t", 0)])
def resume_lines(spark):
    lines = rows(spark, "session string, n int, line string", ("s", 1, "{}"), ("s", 2, "{}"), ("s", 3, '{"a":1}'), ("s", 4, "{bro"), ("t", 0, "{}"))
    return refresh.resume(lines, rows(spark, "session string, n int", ("s", 1), ("s", 2)), "session", "n")


@expect("at int", [(3,), (4,)])
def byte_budget(spark):
    return refresh.within_bytes(rows(spark, "at int, size int", (1, 5), (2, 5), (3, 6), (4, 4), (5, 1)), "at", "size", 2, 10).select("at")


@expect("chunk_id string, session string, line int, tools string, ts int", [("s_x_7", "s_x", 7, "Edit,Read", 3)])
def orphan_bodies(spark):
    return refresh.orphans(rows(spark, "chunk_id string, tool string, ts int", ("s_x_7", "Read", 4), ("s_x_7", "Edit", 3), ("kept_1", "Read", 1), ("nonumber", "Read", 1)), rows(spark, "chunk_id string", ("kept_1",)))


@expect("cell string, since long, stale int", [("a", 60, 1), ("b", 10, 0), ("c", 5, 1)])
def graph_staleness(spark):
    return refresh.graph_stale(rows(spark, "cell string, operation string, at int, rows int", ("a", "build", 1, 0), ("a", "add", 2, 60), ("b", "add", 1, 99), ("b", "build", 2, 0), ("b", "add", 3, 10), ("c", "add", 1, 5)))


@expect("id string", [("c",), ("a",)])
def round_robin(spark):
    return refresh.fair_batch(rows(spark, "id string", ("a",), ("b",), ("c",)), "id", "b", 2)


@expect("name string, state string, severity int", [("c", "stale-running", 1), ("a", "overdue", 2), ("b", "never-run", 3), ("d", "fresh", 9)])
def health_rollup(spark):
    from quarry.operators.relational import refresh_state

    d = spark.sql("""SELECT * FROM VALUES ('a', 'idle', timestamp'2024-01-01 00:00:00', CAST(NULL AS timestamp), 3600), ('b', 'idle', CAST(NULL AS timestamp), CAST(NULL AS timestamp), 3600),
        ('c', 'running', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:00', 3600), ('d', 'idle', timestamp'2024-01-02 11:30:00', CAST(NULL AS timestamp), 3600) AS t(name, refresh_status, last_refresh_at, refresh_started_at, refresh_interval)""")
    order = F.when(F.col("state") == "stale-running", 1).when(F.col("state") == "overdue", 2).when(F.col("state") == "never-run", 3).when(F.col("state") == "due", 4).otherwise(9)
    return refresh_state(d, "2024-01-02 12:00:00").select("name", "state", order.alias("severity")).orderBy("severity", "name")


# ---- programs ------------------------------------------------------------------------------------------------------

_PROGRAM = "-- @name: pick\n-- @description: numbers\n-- @params: least (default: 2), most\n-- @multi: true\n-- @query: some\nSELECT id FROM range(10) WHERE id >= :least AND id < :most\n-- @query: bad\nDROP TABLE x\n-- @query: many\nSELECT count(*) AS id FROM range(:most)"


@expect("name string, id long", [("some", 2), ("some", 3), ("many", 4)])
def program_run(spark):
    got = programs.run(spark, programs.parse(_PROGRAM, "x"), most=4)
    out = [df.select(F.lit(n).alias("name"), F.col("id").cast("long")) for n, df in got if not isinstance(df, str)]
    return out[0].unionByName(out[1])


@expect("name string, result string", [("bad", "refused"), ("many", "rows"), ("some", "rows")])
def program_policy(spark):
    got = programs.run(spark, programs.parse(_PROGRAM, "x"), most=4)
    return rows(spark, "name string, result string", *((n, "refused" if isinstance(r, str) and r.startswith("PermissionError") else "rows") for n, r in got))


@expect("alias string, id long", [("left", 1), ("my_right", 2)])
def federated_query(spark):
    corpora = {"left": {"docs": rows(spark, "id long", (1,))}, "my right": {"docs": rows(spark, "id long", (2,))}}
    return programs.federated(spark, "ATTACH 'left'; ATTACH 'my right' AS my_right; SELECT 'left' AS alias, id FROM left.docs UNION ALL SELECT 'my_right', id FROM my_right.docs", corpora)


@expect("node string, hub_type string", [("a", "authority"), ("b", "connector"), ("c", "balanced")])
def hub_types(spark):
    return graph.hub_types(rows(spark, "source string, target string", ("b", "a"), ("c", "a"), ("b", "c"), ("b", "b2"))).where("node IN ('a', 'b', 'c')")


@expect("source string, target string, weight double, origin string", [("a", "b", 1.0, "both"), ("a", "c", 0.5, "semantic"), ("b", "c", 1.0, "link")])
def edge_origins(spark):
    return graph.combine(rows(spark, "source string, target string, weight double", ("a", "b", 0.4), ("a", "c", 0.5)), rows(spark, "source string, target string, weight double", ("a", "b", 1.0), ("b", "c", 1.0)))


# ---- source files, commands, rules -------------------------------------------------------------------------------------

_PY = "import os, sys as s\nfrom a.b import c\n\n@deco(1)\ndef f():\n    def g():\n        return h()\n    return g() + len([])\n\nclass K(Base):\n    def m(self):\n        return f(self.x())\n\nf()\n"


@expect("kind string, name string, parent string, first int, last int, calls string", [("module", "", None, 1, 14, "deco,f"), ("function", "f", "", 4, 8, "g,len"), ("function", "f.g", "f", 6, 7, "h"), ("class", "K", "", 10, 12, ""), ("function", "K.m", "K", 11, 12, "f")])
def code_definitions(spark):
    found = C.code_tree(rows(spark, "path string, text string", ("a.py", _PY), ("bad.py", "def ("), ("none.py", None)))
    return found.where("path = 'a.py'").withColumn("calls", F.array_join("calls", ","))


@expect("k int, out string", [(0, "os,sys,a.b"), (1, "react,./x,fs")])
def code_imports(spark):
    return scalar(spark, [_PY, "import React from 'react'\nimport {a} from \"./x\"\nconst f = require('fs')"], lambda c: F.array_join(C.imports(c), ","))


@expect("k int, path string, op string, confidence double", [(0, "out.txt", "write", 0.9), (0, "in.txt", "read", 0.7), (1, "log", "append", 0.9), (2, "a.py", "edit", 0.95), (3, "b", "write", 0.9), (3, "a", "delete", 0.9), (4, "x y", "delete", 0.95), (5, "f.py", "read", 0.6)])
def shell_file_ops(spark):
    d = rows(spark, "k int, command string", (0, "cat in.txt > out.txt 2>&1"), (1, "echo x >> log; ls > /dev/null"), (2, "sed -i 's/a/b/' a.py"), (3, "mv a b"), (4, 'rm -rf "x y"'), (5, "grep -n 'def ' f.py"))
    return C.file_ops(d, "k", "command")


@expect("path string, strategy string", [("a/b/c.md", "ast"), ("a/x.md", "sliding"), ("ab/x.md", "template"), ("q.md", "whole"), ("z/own.md", "sidecar")])
def split_rules(spark):
    files = rows(spark, "path string, subtype string", ("a/b/c.md", None), ("a/x.md", "plan"), ("ab/x.md", "plan"), ("q.md", None), ("z/own.md", "plan"))
    rules = rows(spark, "kind string, pattern string, strategy string", ("folder", "a", "sliding"), ("folder", "a/b", "ast"), ("subtype", "plan", "template"), ("default", "", "whole"), ("file", "z/own.md", "sidecar"))
    return C.rule_for(files, rules)


@expect("title string, type string", [("Methods", "method"), ("Related work", "related"), ("ABSTRACT", "abstract"), ("Else", None)])
def title_types(spark):
    d = rows(spark, "title string", ("Methods",), ("Related work",), ("ABSTRACT",), ("Else",))
    return C.classify(d, [("abstract", "abstract"), ("/^related/i", "related"), ("/method/i", "method")])


@expect("position int, title string, depth int, body string", [(0, "Abstract", 1, "# Abstract\n\nWe do."), (1, "One", 1, "# One\n\ntext"), (2, "Two", 2, "## Two\n\nmore")])
def latex_parts(spark):
    d = rows(spark, "id int, raw string", (1, "\\begin{abstract}\nWe do.% no\n\\end{abstract}\n\\section{One}\ntext\n\\subsection*{Two}\nmore")).select("id", C.latex_sections(F.col("raw")).alias("text"))
    return M.sections(d, "id", "text").drop("id")


@expect("k int, out string", [(0, "A long title")])
def latex_titles(spark):
    return scalar(spark, ["\\title{A long\n  title}\\author{x}"], C.latex_title)
