"""Registered queries over the reference operators, each with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import graph, lexical, relational, semantic
from quarry.operators.state import new_folder
from quarry.sources.tables import table, views
from quarry.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def relation(name: str, tables: list[str], sql: str, duck: str | None = None) -> None:
    """A query that both engines can state in SQL."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        views(spark, folder, tables)
        return spark.sql(sql)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, duck or sql


# ---- lexical -------------------------------------------------------------------------------------------------------

_TERMS = f"list_filter(string_split_regex(translate(lower(coalesce(text, '')), '{X.MARKED}', '{X.BARE}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _bm25(words: list[str], scope: str = "true", limit: int = 200) -> str:
    n = range(len(words))
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}, bool_or(s AND tf{i} > 0) AS hit{i}" for i in n)
    every, some = " AND ".join(f"tf{i} > 0" for i in n), " OR ".join(f"tf{i} > 0" for i in n)
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in n)
    pick = lambda want: "concat_ws(',', " + ", ".join(f"CASE WHEN hit{i} = {want} THEN '{w}' END" for i, w in enumerate(words)) + ")"
    return f"""WITH a AS (SELECT doc_id, {scope} AS s, {_TERMS} AS t FROM documents), b AS (SELECT doc_id, s, len(t) AS dl, {tf} FROM a),
        c AS (SELECT count(*) AS n, avg(dl) AS avgdl, bool_or(s AND {every}) AS al, {df} FROM b),
        d AS (SELECT doc_id, {score} AS v, {pick('true')} AS matched_tokens, {pick('false')} AS dropped_tokens FROM b, c WHERE s AND ({some}) AND (NOT al OR ({every})) ORDER BY v DESC, doc_id LIMIT {limit})
        SELECT doc_id, round(v, 6) AS bm25, round(CASE WHEN max(v) OVER () > min(v) OVER () THEN (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) ELSE 0.5 END, 6) AS rank, matched_tokens, dropped_tokens FROM d"""


@query(_bm25(["thing", "erth"], limit=50))
def kw_bm25_and(spark, folder):
    return lexical.keyword(table(spark, folder, "documents"), "thing erth", limit=50)


@query(_bm25(["thing", "eauhen"], limit=50))
def kw_bm25_or(spark, folder):
    return lexical.keyword(table(spark, folder, "documents"), "thing eauhen", limit=50)


@query(_bm25(["the", "and"], "lang = 'en' AND source = 'src3'", 20))
def kw_scoped(spark, folder):
    return lexical.keyword(table(spark, folder, "documents"), "the and", where=(F.col("lang") == "en") & (F.col("source") == "src3"), limit=20)


@query(_bm25(["the", "zzqx"], limit=20))
def kw_dropped_tokens(spark, folder):
    return lexical.keyword(table(spark, folder, "documents"), "the zzqx", limit=20)


# ---- semantic ------------------------------------------------------------------------------------------------------

_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def _vec(raw: str, score: str, where: str = "true", limit: int = 10, more: str = "", source: str = "embeddings") -> str:
    return f"""WITH u AS (SELECT vec_id, label, {_unit(_V)} AS v {", ts" if source != "embeddings" else ""} FROM {source}),
        m AS (SELECT list(a ORDER BY k) AS m FROM (SELECT k, avg(v[k]) AS a FROM u, range(1, 65) t(k) WHERE vec_id IN (1, 2, 3) GROUP BY k)),
        q AS (SELECT {_unit('m')} AS q FROM m) {more},
        r AS (SELECT vec_id, v, {raw} AS raw {", ts" if source != "embeddings" else ""} FROM u, q WHERE {where}),
        s AS (SELECT avg(raw) AS mean, stddev_pop(raw) AS std FROM r)
        SELECT vec_id, round({score}, 4) AS score, round((raw - mean) / std, 4) AS z FROM r, s ORDER BY {score} DESC, vec_id LIMIT {limit}"""


def _of(i: int) -> str:
    return f"(SELECT v FROM u WHERE vec_id = {i})"


@query(_vec("list_inner_product(v, q)", "raw"))
def vec_centroid(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1, 2, 3)))


@query(_vec("list_inner_product(v, q)", "raw", "label IN (1, 2)"))
def vec_prefilter(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1, 2, 3)), scope=F.col("label").isin(1, 2))


@query(_vec("list_inner_product(v, q)", f"raw - 0.5 * list_inner_product(v, (SELECT v FROM u WHERE vec_id = 4)) - 0.5 * list_inner_product(v, (SELECT v FROM u WHERE vec_id = 5))"))
def vec_suppress2(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1, 2, 3), suppress=(4, 5)))


@query(_vec("list_inner_product(v, q)", "0.5 * raw + 0.5 * list_inner_product(v, (SELECT w FROM w))", more=f", d AS (SELECT list_transform(list_zip({_of(9)}, {_of(8)}), lambda z: z[1] - z[2]) AS d), w AS (SELECT {_unit('d')} AS w FROM d)"))
def vec_trajectory(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1, 2, 3), toward=(8, 9)))


@query(_vec("list_inner_product(v, q)", "raw * pow(2.0, -greatest((epoch(TIMESTAMP '2024-02-01 00:00:00') - coalesce(epoch(ts), 0)) / 86400.0, 0.0) / 7)", source="(SELECT e.*, ts FROM embeddings e LEFT JOIN events ON vec_id = event_id)"))
def vec_decay(spark, folder):
    e = table(spark, folder, "embeddings").join(table(spark, folder, "events").select(F.col("event_id").alias("vec_id"), "ts"), "vec_id", "left")
    return semantic.vec_ops(e, semantic.Modulation(centroid=(1, 2, 3), half_life=7, as_of="2024-02-01 00:00:00"), ts="ts")


@query()
def vec_mmr(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1, 2, 3), diverse=True))


@query(f"""WITH u AS (SELECT vec_id, {_unit(_V)} AS v FROM embeddings), p AS (SELECT vec_id, {_unit('v[1:16]')} AS v FROM u) SELECT a.vec_id, round(list_inner_product(a.v, b.v), 4) AS score FROM p a, p b WHERE b.vec_id = 1 ORDER BY list_inner_product(a.v, b.v) DESC, a.vec_id LIMIT 10""")
def vec_matryoshka(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1,), dims=16)).select("vec_id", "score")


@query("""WITH e AS (SELECT label, unnest(range(0, 64)) AS position, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, position, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL),
    n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT label, CAST(position AS INTEGER) AS position, round(m / n, 6) AS value FROM m JOIN n USING (label)""")
def source_mean_pool(spark, folder):
    return semantic.mean_pool(table(spark, folder, "embeddings"), "label")


@query("WITH k AS (" + _bm25(["thing", "erth"], limit=50) + f"), v AS (SELECT vec_id, list_inner_product({_unit(_V)}, (SELECT {_unit(_V)} FROM embeddings WHERE vec_id = 1)) AS s FROM embeddings) SELECT doc_id, rank, round(s, 4) AS score, round(rank + round(s, 4), 4) AS hybrid FROM k JOIN v ON doc_id = vec_id")
def hybrid_sum(spark, folder):
    k = lexical.keyword(table(spark, folder, "documents"), "thing erth", limit=50).select("doc_id", "rank")
    v = semantic.scores(table(spark, folder, "embeddings"), (1,), k.select(F.col("doc_id").alias("vec_id"))).withColumnRenamed("vec_id", "doc_id")
    return k.join(v, "doc_id").select("doc_id", "rank", "score", F.round(F.col("rank") + F.col("score"), 4).alias("hybrid"))


# ---- windows, joins, incremental -----------------------------------------------------------------------------------


@query("""WITH g AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sprint FROM g)
    SELECT user_id, CAST(sprint AS BIGINT) AS sprint, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, sprint""")
def sprints(spark, folder):
    s = relational.sessions(table(spark, folder, "events"), "user_id", "ts", "event_id", 6)
    return s.groupBy("user_id", "sprint").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM b GROUP BY user_id, run, event_type""")
def tool_run_collapse(spark, folder):
    return relational.runs(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH a AS (SELECT conv_id, turn, role, CAST(sum(length(text)) OVER w AS BIGINT) AS used, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, role, used FROM a WHERE used <= 1200 OR n = 1""")
def budget_page(spark, folder):
    return relational.budget(table(spark, folder, "conversations"), "conv_id", "turn", F.length("text"), 1200).select("conv_id", "turn", "role", "used")


@query("""SELECT conv_id, turn, prompt_turn FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt_turn FROM conversations) WHERE role = 'assistant'""")
def asof_prior_prompt(spark, folder):
    c = relational.last_before(table(spark, folder, "conversations"), "conv_id", "turn", F.col("role") == "user", "turn", "prompt_turn")
    return c.where("role = 'assistant'").select("conv_id", "turn", "prompt_turn")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey), s AS (SELECT p FROM e GROUP BY p HAVING count(*) BETWEEN 2 AND 200)
    SELECT a.c AS source, b.c AS target, count(*) AS weight FROM e a JOIN s USING (p) JOIN e b USING (p) WHERE a.c < b.c GROUP BY ALL HAVING count(*) >= 3""")
def shared_attr_graph(spark, folder):
    e = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p"))
    return relational.shared(e, "c", "p", 200, 3)


@query("""WITH l AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id % 3 <> 0), r AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS d FROM documents WHERE doc_id % 4 <> 0)
    SELECT doc_id, CASE WHEN l.d IS NULL THEN 'new' WHEN r.d IS NULL THEN 'orphan' WHEN l.d = r.d THEN 'current' ELSE 'stale' END AS status FROM l FULL JOIN r USING (doc_id)""")
def snapshot_diff(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    local = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    remote = d.where("doc_id % 4 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return relational.snapshot_diff(local, remote, "doc_id", "h")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY sha256(text)")
def dedupe_keep_first(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return relational.keep_first(d, [F.col("digest")], "doc_id")


@query("""WITH c AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), d AS (SELECT * FROM c WHERE i = 1 OR event_type IS DISTINCT FROM p)
    SELECT user_id, row_number() OVER w AS revision, event_type, event_id AS valid_from, lead(event_id) OVER w AS valid_until FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def annotation_scd2(spark, folder):
    return relational.history(table(spark, folder, "events"), "user_id", "event_id", "event_type")


@query("""WITH g AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    b AS (SELECT *, sum(CASE WHEN gap > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS burst FROM g)
    SELECT user_id, event_type, CAST(burst AS BIGINT) AS burst, count(*) AS n, min(ts) AS first, max(ts) AS last FROM b GROUP BY user_id, event_type, burst""")
def debounce_replay(spark, folder):
    return relational.debounce(table(spark, folder, "events"), ["user_id", "event_type"], "ts", 60, "event_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, folder):
    return windows.tumbling(table(spark, folder, "events"), "1 hour")


# ---- text ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, concat_ws(':', source, CAST(doc_id AS VARCHAR), substr(sha256(text), 1, 12)) AS chunk_id FROM documents")
def chunk_ids(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"))


@query("""WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS x, len(w) AS n FROM w), c AS (SELECT doc_id, x, n, count(*) AS k FROM t GROUP BY ALL)
    SELECT doc_id, round(-sum(k / n * log2(k / n)), 6) AS bits FROM c GROUP BY doc_id""")
def word_entropy(spark, folder):
    """By counts of exploded words: linear in the text, where the scalar form is quadratic in its distinct words."""
    w = table(spark, folder, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w")).select("doc_id", F.size("w").alias("n"), F.explode("w").alias("x"))
    p = F.col("k") / F.col("n")
    return w.groupBy("doc_id", "n", "x").agg(F.count("*").alias("k")).groupBy("doc_id").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("bits"))


@query("SELECT doc_id, substr(text, CAST(1 + 3800 * k AS INTEGER), 4000) AS piece, CAST(k AS INTEGER) AS position FROM documents, range(0, 1000) r(k) WHERE length(text) > 0 AND 3800 * k < greatest(length(text) - 200, 1)")
def doc_windows(spark, folder):
    d = table(spark, folder, "documents").where(F.length("text") > 0)
    last = F.ceil(F.greatest(F.length("text") - 200, F.lit(1)) / 3800).cast("int") - 1
    return d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("position")).select("doc_id", F.substring("text", 1 + 3800 * F.col("position"), F.lit(4000)).alias("piece"), "position")


_TRACK = ", ".join(f"'{t}'" for t in X.TRACKING)


@query(rf"""WITH a AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM pages),
    b AS (SELECT page_id, s, lower(regexp_extract(r, '^([^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS p, list_sort(list_filter(string_split(regexp_extract(r, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK}))) AS q, regexp_extract(r, '(#.*)$', 1) AS f FROM a)
    SELECT page_id, s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || f AS url FROM b""")
def url_normalize(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.normalise_url(F.col("url")).alias("url"))


@query("""WITH t AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM t WHERE length(word) > 3 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM c) SELECT lang, word, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def keyword_top_n(spark, folder):
    from pyspark.sql import Window

    t = table(spark, folder, "documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.length("word") > 3)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return t.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("place", place).where("place <= 10")


# ---- graphs --------------------------------------------------------------------------------------------------------


@query(f"""WITH u AS (SELECT vec_id, label, {_unit(_V)} AS v FROM embeddings), m AS (SELECT list(a ORDER BY k) AS m FROM (SELECT k, avg(v[k]) AS a FROM u, range(1, 65) t(k) GROUP BY k)),
    d AS (SELECT vec_id, label, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS d FROM u, m), c AS (SELECT vec_id, label, {_unit('d')} AS v FROM d),
    p AS (SELECT a.vec_id AS source, b.vec_id AS target, round(list_inner_product(a.v, b.v), 4) AS weight FROM c a JOIN c b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT * FROM p WHERE weight >= 0.35""")
def sim_graph_centered(spark, folder):
    return graph.similar(table(spark, folder, "embeddings"), 0.35, block="label")


@query("""SELECT 'n' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'r2', 0 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""")
def tree_subtree(spark, folder):
    n, c = table(spark, folder, "nation"), table(spark, folder, "customer")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child")).unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child")))
    return graph.descend(edges, spark.createDataFrame([("r2",)], "node string"))


@query()
def hubs_top10pct(spark, folder):
    from pyspark.sql import Window

    r = graph.similar_rank(table(spark, folder, "embeddings"), 0.2, block="label", steps=8)
    n = r.count()
    return r.select("node", F.round("rank", 8).alias("rank")).orderBy(F.desc("rank"), "node").limit(max(1, n // 10))


# ---- SQL that both engines share -------------------------------------------------------------------------------------

relation("view_chunks_star", ["documents", "labels"], """SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, s.n AS source_docs FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON d.source = s.source""")
relation("view_sources_agg", ["documents"], "SELECT source, count(DISTINCT doc_id) AS chunks, count(DISTINCT lang) AS langs, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY source")
relation("path_change_events", ["events"], """SELECT event_id, user_id, prior, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events) x
    WHERE prior IS NULL OR prior <> event_type""")
relation("msg_index_tail", ["conversations"], """SELECT conv_id, turn, role, total FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) x WHERE k <= 2""")
relation("nearest_sibling", ["conversations"], """SELECT a.conv_id, a.turn, min(b.turn) AS next_user FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'user' AND b.turn > a.turn GROUP BY a.conv_id, a.turn""")
relation("anti_unlabelled", ["documents", "labels"], "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
relation("semi_toxic", ["documents", "labels"], "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
relation("coverage_pct", ["documents", "labels"], "SELECT d.source, round(100.0 * count(l.doc_id) / count(*), 1) AS pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source", "SELECT d.source, round(CAST(100 * count(l.doc_id) AS DECIMAL(20,1)) / count(*), 1) AS pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
relation("conditional_sums", ["events"], "SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id", "SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
relation("majority_vote", ["documents"], "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY source, lang) x WHERE k = 1")
relation("union_summary", ["documents", "pages", "benchmark"], "SELECT 'documents' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
relation("fallback_row", ["documents"], "SELECT source FROM documents WHERE source = 'none' UNION ALL SELECT 'empty' WHERE NOT EXISTS (SELECT 1 FROM documents WHERE source = 'none')")
relation("json_props", ["events"], "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
relation("substring_match", ["documents"], "SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
relation("thread_numbering", ["conversations"], "SELECT conv_id, turn, place FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) x WHERE role <> 'system'", "SELECT conv_id, turn, CAST(place AS INTEGER) AS place FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) x WHERE role <> 'system'")
relation("custom_rank_order", ["orders"], "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderkey LIMIT 25")
relation("delegation_tree", ["region", "nation", "supplier"], """WITH RECURSIVE e AS (SELECT concat('r', r_regionkey) AS child, CAST(NULL AS STRING) AS parent FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier),
    t AS (SELECT child, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.child WHERE t.depth < 5) SELECT child, depth FROM t""")
relation("drift_history", ["events"], "SELECT user_id, ts, value FROM (SELECT user_id, ts, value, event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1 AND value <> f")
relation("orders_star", ["lineitem", "orders", "customer", "nation", "region"], """SELECT r_name, n_name, count(*) AS n, CAST(round(sum(l_extendedprice * (1 - l_discount)), 0) AS BIGINT) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")


# ---- explicit keyword queries, index, more vector queries --------------------------------------------------------------

_FLAT = f"(SELECT doc_id, ' ' || array_to_string({_TERMS}, ' ') || ' ' AS s, {_TERMS} AS t FROM documents)"


def _explicit(name: str, text: str, where: str) -> None:
    QUERIES[name] = lambda spark, folder: lexical.search(table(spark, folder, "documents"), text)
    ORACLES[name] = f"SELECT doc_id FROM {_FLAT} WHERE {where}"


_explicit("kw_phrase", '"the and" OR "of the"', "contains(s, ' the and ') OR contains(s, ' of the ')")
_explicit("kw_not", "the NOT and", "contains(s, ' the ') AND NOT contains(s, ' and ')")
_explicit("kw_prefix", "(thin* OR lice*) AND the", "(contains(s, ' thin') OR contains(s, ' lice')) AND contains(s, ' the ')")
_explicit("kw_near", "NEAR(the and, 3)", "regexp_matches(s, ' the ([^ ]+ ){0,3}and ') OR regexp_matches(s, ' and ([^ ]+ ){0,3}the ')")


@query(f"WITH x AS (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM {_FLAT}), p AS (SELECT term, doc_id, dl, count(*) AS tf FROM x GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(dl) AS INTEGER) AS longest FROM p GROUP BY term")
def kw_term_stats(spark, folder):
    return lexical.term_stats(table(spark, folder, "documents"))


@query(f"""WITH h AS (SELECT doc_id, t, list_position(t, 'license') AS k FROM {_FLAT} WHERE list_contains(t, 'license')), a AS (SELECT *, greatest(least(k - 15, len(t) - 29), 1) AS s FROM h)
    SELECT doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || array_to_string(list_transform(list_slice(t, s, s + 29), lambda y: CASE WHEN y = 'license' THEN '>>>' || y || '<<<' ELSE y END), ' ') || CASE WHEN s + 29 < len(t) THEN '...' ELSE '' END AS snippet FROM a""")
def kw_snippet(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", X.terms(F.col("text")).alias("t")).where(F.array_contains("t", "license"))
    return d.select("doc_id", lexical.snippet(F.col("t"), ["license"]).alias("snippet"))


@query(f"SELECT page_id FROM (SELECT page_id, ' ' || array_to_string({_TERMS.replace('text', 'html')}, ' ') || ' ' AS s FROM pages) WHERE contains(s, ' the ') AND contains(s, ' and ')")
def kw_second_surface(spark, folder):
    return lexical.search(table(spark, folder, "pages"), "the AND and", key="page_id", text="html")


@query(_vec(f"list_inner_product(v, (SELECT {_unit('b')} FROM (SELECT list_transform(list_zip(q, {_of(7)}), lambda z: z[1] + z[2]) AS b FROM q)))", "raw"))
def vec_centroid_blend(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1, 2, 3), blend=7))


@query(_vec("list_inner_product(v, q)", "raw", "label = 4", 25))
def vec_zscore(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1, 2, 3), limit=25), scope=F.col("label") == 4)


@query(f"SELECT vec_id, score FROM ({_vec('list_inner_product(v, q)', 'raw', limit=1000)}) WHERE score >= 0.25")
def vec_threshold(spark, folder):
    return semantic.vec_ops(table(spark, folder, "embeddings"), semantic.Modulation(centroid=(1, 2, 3), threshold=0.24995, limit=1000, pool=1000)).select("vec_id", "score")


@query(f"WITH s AS ({_vec('list_inner_product(v, q)', 'raw', limit=30)}) SELECT label AS source, CAST(row_number() OVER (ORDER BY max(score) DESC, label) AS INTEGER) AS place, max(score) AS score FROM s JOIN embeddings USING (vec_id) GROUP BY label")
def vec_sources(spark, folder):
    e = table(spark, folder, "embeddings")
    found = semantic.vec_ops(e, semantic.Modulation(centroid=(1, 2, 3), limit=30)).join(e.select("vec_id", "label"), "vec_id")
    return semantic.sources_by_rank(found, F.col("label"))


@query(f"""WITH u AS (SELECT vec_id, label, {_unit(_V)} AS v FROM embeddings), m AS (SELECT list(a ORDER BY k) AS m FROM (SELECT k, avg(v[k]) AS a FROM u, range(1, 65) t(k) GROUP BY k)),
    w AS (SELECT label, v, least(greatest(1 - list_inner_product(v, {_unit('m')}), 0.05), 2) AS w FROM u, m), e AS (SELECT label, w, unnest(range(0, 64)) AS position, unnest(v) AS x FROM w),
    p AS (SELECT label, position, sum(w * x) / sum(w) AS m FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM p GROUP BY label) SELECT label, CAST(position AS INTEGER) AS position, round(m / n, 6) AS value FROM p JOIN n USING (label)""")
def source_weighted_pool(spark, folder):
    return semantic.weighted_pool(table(spark, folder, "embeddings"), "label")


@query(f"""WITH u AS (SELECT vec_id, {_unit(_V)} AS v FROM embeddings), m AS (SELECT list(a ORDER BY k) AS m FROM (SELECT k, avg(v[k]) AS a FROM u, range(1, 65) t(k) GROUP BY k)),
    d AS (SELECT vec_id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS d FROM u, m), c AS (SELECT vec_id, {_unit('d')} AS v FROM d)
    SELECT a.vec_id AS source, b.vec_id AS target, round(list_inner_product(a.v, b.v), 6) AS weight FROM c a JOIN c b ON a.vec_id < b.vec_id WHERE list_inner_product(a.v, b.v) >= 0.4""")
def sim_graph_all(spark, folder):
    return graph.similar_all(table(spark, folder, "embeddings"), 0.4, block=256).withColumn("weight", F.round("weight", 6))


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, m
    WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY ALL""")
def stream_appended(spark, folder):
    """A real stream: the file is read as it stands, windows are appended once the watermark has passed them, and read back."""
    top = new_folder(spark, "stream")
    schema = table(spark, folder, "events").schema
    rows = windows.source(spark, f"{folder}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    windows.drain(windows.tumbling(rows, "1 hour"), f"{top}/out", f"{top}/log")
    return spark.read.parquet(f"{top}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, folder):
    return windows.sessions(table(spark, folder, "events"), "2 hours")
