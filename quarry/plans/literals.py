"""Queries over small literal tables: what no given table can show yet. Their SQL states the expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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


_SYMBOLS = [("d1", "f"), ("d2", "g"), ("d3", "h"), ("d4", "dup"), ("d5", "dup"), ("d6", "k")]
_CALLS = [("d2", "f"), ("d3", "g"), ("d4", "g"), ("d6", "dup"), ("d1", "h"), ("d6", "nothing"), ("d3", "h")]


def _code(spark):
    return rows(spark, "def_id string, name string", *_SYMBOLS), rows(spark, "caller_id string, callee_name string", *_CALLS)


@expect("id string, depth int", [("d6", 1)])
def call_impact_ambiguous_root(spark):
    return walks.impact(*_code(spark), "dup", 5)


@expect("k string, batch int, n long, first double, released double", [("a", 0, 3, 0.0, 8.0), ("a", 1, 1, 20.0, 23.0), ("b", 0, 4, 0.0, 10.0), ("b", 1, 2, 10.0, 15.0)])
def debounce_latency(spark):
    d = rows(spark, "k string, s int", ("a", 0), ("a", 2), ("a", 5), ("a", 20), ("b", 0), ("b", 3), ("b", 6), ("b", 9), ("b", 10), ("b", 12)).withColumn("ts", F.timestamp_seconds("s"))
    return refresh.release(d, ["k"], "ts", 3, 10, "s")


@expect("k int, path string, size int", [(0, '["text"]', 900), (0, '["text"]', 400)])
def result_pieces(spark):
    parts = [p for p in refresh.pieces({"text": "x" * 1300, "n": 300 * [1]}) if "string_fragment" in p]
    return rows(spark, "k int, path string, size int", *((0, __import__("json").dumps(p["path"]), len(p["string_fragment"])) for p in parts))


@expect("k string, v string", [("similar", "slow auth"), ("suppress", "tests|docs old"), ("decay", "7"), ("diverse", "True"), ("pool", "50"), ("centroid", "a,b"), ("from", "x y"), ("to", "z")])
def modifier_parse(spark):
    m = programs.modifiers("similar:slow auth diverse suppress:tests unlike:docs old recent:7 centroid:a,b limit:50 from:x y to:z")
    show = {"suppress": "|".join(m["suppress"]), "centroid": ",".join(m["centroid"])}
    return rows(spark, "k string, v string", *((k, str(show.get(k, v))) for k, v in m.items() if k != "extra"))


@expect("text string, n int", [("decey:7", 1), ("decay:x", 1), ("kind:a", 0), ("pool:5 similar:a", 0), ("simlar:x", 1)])
def modifier_check(spark):
    texts = ["decey:7", "decay:x", "kind:a", "pool:5 similar:a", "simlar:x"]
    return rows(spark, "text string, n int", *((t, len(programs.complaints(t))) for t in texts))


@expect("n_nodes long, n_groups long, worst long", [(9, 3, 3)])
def communities_split(spark):
    edges = rows(spark, "source string, target string, weight double", *((f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(3) for j in range(i + 1, 3)), ("a0", "b0", 0.1), ("b0", "c0", 0.1))
    found = graph.communities(edges)
    sizes = found.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_groups"), F.max("n").alias("worst"))


@expect("node string, betweenness double", [("m", 4.0), ("a", 0.0), ("b", 0.0), ("c", 0.0), ("d", 0.0)])
def bridges_betweenness(spark):
    return graph.betweenness(rows(spark, "source string, target string", ("a", "b"), ("a", "m"), ("b", "m"), ("m", "c"), ("m", "d"), ("c", "d")))
