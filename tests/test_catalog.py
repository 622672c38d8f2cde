"""Registered queries against DuckDB on the smallest tables, and scalar edge cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import lexical, relational
from quarry.plans import catalog, corpus, derived, extended, literals, programs  # noqa: F401  derived adds to extended

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(df):
    names = sorted(df.columns)

    def value(x):
        x = x.item() if hasattr(x, "item") else x
        if x is None or str(x) in ("NaT", "<NA>", "nan"):
            return None
        if hasattr(x, "isoformat"):
            return str(x)[:26]
        if isinstance(x, float) or type(x).__name__ == "Decimal":
            return int(x) if float(x).is_integer() else float(x)
        return x

    return names, sorted((tuple(value(x) for x in row) for row in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES | corpus.ORACLES | literals.ORACLES | extended.ORACLES))
def test_query_equals_sql(spark, duck, name):
    queries, oracles = catalog.QUERIES | corpus.QUERIES | literals.QUERIES | extended.QUERIES, catalog.ORACLES | corpus.ORACLES | literals.ORACLES | extended.ORACLES
    assert plain(queries[name](spark, FOLDER).toPandas()) == plain(duck.execute(oracles[name]).df())


def test_keyword_edges(spark):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha"), (3, None), (4, "gamma's")], "doc_id long, text string")
    one = lexical.keyword(docs, "beta").collect()
    assert [(r.doc_id, r.rank) for r in one] == [(1, 0.5)]
    assert {r.doc_id for r in lexical.keyword(docs, "alpha gamma").collect()} == {1, 2, 4}
    assert lexical.keyword(docs, "alpha", where=F.lit(False)).count() == 0
    assert lexical.keyword(docs, "zzz").count() == 0


def test_scalars(spark):
    assert X.sanitise("it's a-b .net x") == ["its", "net"]
    row = spark.range(1).select(
        X.normalise_url(F.lit("HTTPS://Ex.org:443/a/?b=2&utm_source=x&a=1#f")).alias("u"),
        X.sentences(F.lit("A b. C d! E? F")).alias("s"),
        X.entropy(F.split(F.lit("a b a b"), " ")).alias("h"),
        X.section_type(F.lit("Related Work")).alias("t"),
        X.extension(F.lit("a.b/c")).alias("e"),
    ).first()
    assert (row.u, row.s, row.t, row.e) == ("https://ex.org/a?a=1&b=2#f", "A b. C d! E?", "related", "")
    assert math.isclose(row.h, 1.0)


def test_tracking_parameters(spark):
    names = """utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid ref source campaign mc_cid mc_eid
        _ga _gl msclkid zanpid dclid yclid wickedid twclid li_fat_id igshid epik si""".split()
    urls = [f"https://A.org/x/?z=1&{n}=7&b=2" for n in names] + ["https://A.org/x/?z=1&SI=7&b=2", "https://a.org/x?z=1&b=2&site=3&sources=4"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(X.normalise_url(F.col("u"))).collect()]
    assert len(names) == 24 and got == ["https://a.org/x?b=2&z=1"] * 25 + ["https://a.org/x?b=2&site=3&sources=4&z=1"]
    pages = duckdb.connect()
    pages.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    pages.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert [r[1] for r in sorted(pages.execute(catalog.ORACLES["url_normalize"]).fetchall())] == got


def test_gap_is_strict(spark):
    rows = spark.createDataFrame([(1, 0), (1, 3600), (1, 7201)], "u int, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.sprint for r in relational.sessions(rows, "u", "ts", "s", 1).orderBy("s").collect()] == [0, 0, 1]


def test_upsert_and_refresh_state(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 2, "d")], "k int, seq int, v string")
    assert sorted((r.k, r.v) for r in relational.upsert(base, new, "k", "seq").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    registry = spark.sql("SELECT 'idle' refresh_status, timestamp'2024-01-01 00:00:00' last_refresh_at, CAST(NULL AS timestamp) refresh_started_at, 3600 refresh_interval")
    state = lambda at: relational.refresh_state(registry, at).first().state
    assert [state("2024-01-01 00:30:00"), state("2024-01-01 01:30:00"), state("2024-01-01 03:00:00")] == ["fresh", "due", "overdue"]
