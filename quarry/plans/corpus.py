"""Stock programs and curated views over the given tables, in the SQL that both engines share; where they differ, one text each.

Events stand for tool calls of sessions (users), conversations for messages, documents for chunks of sources, pages for
files, labels for sidecars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import programs
from quarry.sources.tables import table, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def program(name: str, tables: list[str], sql: str, duck: str | None = None, **args) -> None:
    """A one-query program, run through its parser and the read-only policy; arguments are bound, not pasted."""
    parsed = programs.parse(f"-- @name: {name}\n{sql}", name)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        views(spark, folder, tables)
        programs.read_only(spark, parsed.queries[0][1])
        return spark.sql(parsed.queries[0][1], args=args or None)

    run.__name__ = name
    QUERIES[name] = run
    text = duck or sql
    for k, v in args.items():
        text = text.replace(f":{k}", "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v))
    ORACLES[name] = text


# ---- programs ------------------------------------------------------------------------------------------------------

_DAYS = "SELECT max(ts) AS now FROM events"
program("digest_recent", ["events"], f"""SELECT user_id, count(*) AS ops, count(DISTINCT event_type) AS kinds, min(ts) AS first, max(ts) AS last FROM events, ({_DAYS}) d
    WHERE ts >= now - INTERVAL 7 DAYS GROUP BY user_id HAVING count(*) >= :least""", least=2)
program("digest_kinds", ["events"], f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events, ({_DAYS}) d WHERE ts >= now - INTERVAL 7 DAYS GROUP BY event_type")
program("story_head", ["conversations"], """SELECT c.conv_id, n, u.text AS opening FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c
    LEFT JOIN (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') u ON c.conv_id = u.conv_id AND u.k = 1""")
program("story_missing", ["conversations"], """SELECT conv_id, 'found' AS state FROM conversations WHERE conv_id = :conv AND turn = 0 UNION ALL
    SELECT CAST(:conv AS BIGINT), 'no such session' WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE conv_id = :conv)""", conv=-5)
program("message_index", ["conversations"], """SELECT conv_id, turn, role, total, greatest(total - 4, 0) AS omitted FROM (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS total,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tail FROM conversations) x WHERE head <= 2 OR tail <= 2""")
program("sprint_list", ["events"], """WITH g AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sprint FROM g)
    SELECT user_id, CAST(sprint AS BIGINT) AS sprint, count(*) AS ops, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, sprint HAVING count(*) >= 5""")
program("health_counters", ["documents", "labels"], """SELECT count(*) AS chunks, CAST(sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_chunks, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unlabelled,
    round(CAST(100 * count(l.doc_id) AS DOUBLE) / count(*), 1) AS pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
program("genealogy", ["pages"], "SELECT page_id, url FROM pages WHERE url ILIKE concat('%', :term, '%') ORDER BY url, page_id LIMIT 20", term="HTTP")
program("open_issues", ["documents"], "SELECT doc_id, source, lang FROM documents WHERE (:source IS NULL OR source = :source) AND (:lang IS NULL OR lang = :lang) ORDER BY doc_id LIMIT 50", "SELECT doc_id, source, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 50", source=None, lang="fr")
program("reply_targets", ["conversations"], "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (text ILIKE '%?%' OR text ILIKE 'how %' OR text ILIKE '% why %')")
program("landscape", ["documents", "pages", "benchmark"], """SELECT 'documents' AS metric, CAST((SELECT count(*) FROM documents) AS VARCHAR(20)) AS value UNION ALL SELECT 'languages', CAST((SELECT count(DISTINCT lang) FROM documents) AS VARCHAR(20))
    UNION ALL SELECT 'first_source', (SELECT min(source) FROM documents) UNION ALL SELECT 'pages', CAST((SELECT count(*) FROM pages) AS VARCHAR(20)) UNION ALL SELECT 'benchmark', CAST((SELECT count(*) FROM benchmark) AS VARCHAR(20))""")
program("me_summary", ["events"], "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE user_id IN (1, 2, 3) GROUP BY event_type")
program("orphan_docs", ["documents", "labels"], "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
program("community_list", ["documents"], """SELECT lang, array_join(array_sort(collect_set(source)), ', ') AS sources, array_join(array_sort(collect_set(CASE WHEN n_chars > 5000 THEN source END)), ', ') AS long_sources FROM documents GROUP BY lang""",
    """SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources, array_to_string(list_sort(coalesce(list(DISTINCT source) FILTER (n_chars > 5000), [])), ', ') AS long_sources FROM documents GROUP BY lang""")
program("delegation_children", ["nation", "customer"], "SELECT n_nationkey AS node, count(c_custkey) AS children, CASE WHEN count(c_custkey) > 5 THEN 1 ELSE 0 END AS orchestrator FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
program("file_history", ["events"], """SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 'first'
    WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 'same' ELSE 'moved' END AS change FROM events""")
program("provenance_tiers", ["documents", "labels"], """SELECT d.doc_id, 1 AS tier, 'label' AS evidence FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1
    UNION ALL SELECT d.doc_id, 2, 'length' FROM documents d WHERE n_chars > 2000 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) UNION ALL SELECT doc_id, 3, 'source' FROM documents WHERE source = 'src1'""")
program("footprints", ["events"], """SELECT user_id, concat(CAST(count(*) AS STRING), ' ops, ', CAST(count(DISTINCT event_type) AS STRING), ' kinds, ', date_format(min(ts), 'yyyy-MM-dd'), ' to ', date_format(max(ts), 'yyyy-MM-dd')) AS footprint FROM events GROUP BY user_id""",
    """SELECT user_id, count(*) || ' ops, ' || count(DISTINCT event_type) || ' kinds, ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS footprint FROM events GROUP BY user_id""")
program("hydrate_page", ["conversations"], """SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
    FROM conversations WHERE turn > :cursor) x WHERE used <= :most OR k = 1""", cursor=1, most=600)
program("annotation_index", ["events"], """SELECT user_id, event_id, n, total - row_number() OVER (ORDER BY n DESC, user_id) AS omitted FROM (SELECT user_id, max(event_id) AS event_id, count(*) AS n, count(*) OVER () AS total FROM events GROUP BY user_id) x""")


def orient_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog as a table: table_name, column_name and place of every column, from the files' schemas."""
    found = [(t, f.name, k) for t in ("documents", "embeddings", "events", "labels", "pages") for k, f in enumerate(table(spark, folder, t).schema)]
    return spark.createDataFrame(found, "table_name string, column_name string, place int")


QUERIES["orient_columns"] = orient_columns
ORACLES["orient_columns"] = "SELECT table_name, column_name, CAST(ordinal_position - 1 AS INTEGER) AS place FROM information_schema.columns WHERE table_name IN ('documents', 'embeddings', 'events', 'labels', 'pages')"

# ---- curated views ---------------------------------------------------------------------------------------------------

program("view_messages", ["conversations"], """SELECT conv_id, turn, role, concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS message_id, length(text) AS chars, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'reply' ELSE 'note' END AS kind,
    max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt_turn FROM conversations""",
    """SELECT conv_id, turn, role, conv_id || ':' || turn AS message_id, CAST(length(text) AS INTEGER) AS chars, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'reply' ELSE 'note' END AS kind,
    max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt_turn FROM conversations""")
program("view_sessions", ["conversations"], """SELECT conv_id, count(*) AS messages, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS prompts, CAST(sum(length(text)) AS BIGINT) AS chars, min(turn) AS first_turn, max(turn) AS last_turn,
    CASE WHEN count(*) < 5 THEN 1 ELSE 0 END AS warmup FROM conversations GROUP BY conv_id""")
program("view_files", ["pages"], r"SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, length(coalesce(html, '')) AS chars FROM pages", r"SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, CAST(length(coalesce(html, '')) AS INTEGER) AS chars FROM pages")
program("view_notes", ["orders", "customer"], "SELECT c_custkey, c_name, coalesce(o.n, 0) AS links_out, coalesce(o.last, 0) AS last_link FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey")
program("view_threads", ["conversations"], "SELECT conv_id, count(DISTINCT turn) AS chunks, count(DISTINCT role) AS roles, max(length(text)) AS longest FROM conversations GROUP BY conv_id", "SELECT conv_id, count(DISTINCT turn) AS chunks, count(DISTINCT role) AS roles, CAST(max(length(text)) AS INTEGER) AS longest FROM conversations GROUP BY conv_id")
program("view_key_chunks", ["documents", "labels"], """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'flagged' WHEN l.quality = 1 AND n_chars > 2000 THEN 'long_good' WHEN l.quality = 1 THEN 'good' WHEN text ILIKE '%license%' THEN 'boilerplate' ELSE 'plain' END AS reason,
    CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 AND n_chars > 2000 THEN 3 WHEN l.quality = 1 THEN 2 WHEN text ILIKE '%license%' THEN 0 ELSE 1 END AS weight FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
program("view_evidence", ["events", "customer"], """SELECT user_id, count(*) AS touched, CASE WHEN max(c_custkey) IS NULL THEN 'none' WHEN count(*) > 50 THEN 'strong' ELSE 'weak' END AS evidence FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY user_id""")
program("view_documents", ["documents"], "SELECT doc_id, concat(lang, '.', source) AS tag, split_part(concat(lang, '.', source), '.', 1) AS category, split_part(concat(lang, '.', source), '.', 2) AS subtype FROM documents")
program("view_chunk_types", ["documents"], "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'stub' WHEN n_chars > 20000 THEN 'book' WHEN text LIKE '#%' THEN 'section' ELSE 'body' END AS type FROM documents")
program("view_annotations", ["events"], """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1 AND event_type <> 'click'""", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1 AND event_type <> 'click'""")
program("view_papers", ["benchmark"], "SELECT item_id, CASE WHEN lower(text) LIKE '%introduc%' THEN 'introduction' WHEN lower(text) LIKE '%method%' THEN 'method' WHEN lower(text) LIKE '%result%' THEN 'results' ELSE 'body' END AS section_type FROM benchmark")
program("view_events_typed", ["events"], "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'terminal_create' WHEN event_type IN ('click', 'view') THEN 'tool_call' ELSE 'message' END AS kind FROM events")
program("event_coverage", ["events"], "SELECT CASE WHEN event_type = 'purchase' THEN 'terminal_create' WHEN event_type IN ('click', 'view') THEN 'tool_call' ELSE 'message' END AS kind, count(*) AS n, count(DISTINCT user_id) AS sources, count(DISTINCT event_type) AS types FROM events GROUP BY 1")
program("view_multiplication", ["documents", "labels"], "SELECT count(*) AS joined, (SELECT count(*) FROM documents) AS base, CASE WHEN count(*) = (SELECT count(*) FROM documents) THEN 'ok' ELSE 'multiplied' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")

# ---- joins, aggregates, windows --------------------------------------------------------------------------------------

program("rollup_json", ["events"], "SELECT user_id, to_json(array_sort(collect_set(event_type))) AS kinds FROM events GROUP BY user_id", "SELECT user_id, CAST(to_json(list_sort(list(DISTINCT event_type))) AS VARCHAR) AS kinds FROM events GROUP BY user_id")
program("longest_prefix", ["part"], """WITH roots AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS root FROM part UNION SELECT DISTINCT concat(split_part(p_type, ' ', 1), ' ', split_part(p_type, ' ', 2)) FROM part)
    SELECT p_partkey, max_by(root, length(root)) AS root FROM part JOIN roots ON startswith(p_type, root) GROUP BY p_partkey""", """WITH roots AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS root FROM part UNION SELECT DISTINCT concat(split_part(p_type, ' ', 1), ' ', split_part(p_type, ' ', 2)) FROM part)
    SELECT p_partkey, max_by(root, length(root)) AS root FROM part JOIN roots ON starts_with(p_type, root) GROUP BY p_partkey""")
program("first_bodies", ["conversations"], "SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS prompt, min_by(text, turn) FILTER (WHERE role = 'assistant') AS reply FROM conversations GROUP BY conv_id")
program("nearest_turn", ["conversations"], """SELECT conv_id, turn, near FROM (SELECT a.conv_id, a.turn, b.turn AS near, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY abs(a.turn - b.turn), b.turn) AS k
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND b.role = 'user') x WHERE k = 1""")
program("budgeted_gap", ["documents", "labels"], "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality IS NOT NULL WHERE l.doc_id IS NULL ORDER BY d.doc_id LIMIT :budget", budget=25)
program("union_distinct", ["conversations", "labels"], "SELECT conv_id AS id FROM conversations UNION SELECT doc_id FROM labels")
program("fenced_runs", ["events"], """WITH a AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS fence, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(CASE WHEN p = event_type AND event_type <> 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, CAST(min(fence) AS BIGINT) AS fence, count(*) AS n FROM b GROUP BY user_id, run, event_type""")
program("stopword_top_n", ["documents"], """WITH t AS (SELECT lang, explode(split(lower(text), ' ')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM t WHERE length(word) > 3 AND word NOT IN ('that', 'this', 'with', 'from', 'dans', 'avec', 'nicht', 'para') GROUP BY lang, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM c) SELECT lang, word, n FROM r WHERE place <= 10""", """WITH t AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM t WHERE length(word) > 3 AND word NOT IN ('that', 'this', 'with', 'from', 'dans', 'avec', 'nicht', 'para') GROUP BY lang, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM c) SELECT lang, word, n FROM r WHERE place <= 10""")
program("graph_density", ["customer", "nation"], "SELECT count(DISTINCT c_nationkey) AS communities, count(*) AS nodes, CASE WHEN CAST(count(DISTINCT c_nationkey) AS DOUBLE) / count(*) > 0.6 THEN 'degenerate' ELSE 'ok' END AS state FROM customer")
program("community_labels", ["documents", "customer"], """WITH m AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY lang, source)
    SELECT lang, array_join(transform(array_sort(collect_list(named_struct('k', k, 's', source))), x -> x.s), ' · ') AS label FROM m WHERE k <= 3 GROUP BY lang""", """WITH m AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY lang, source) SELECT lang, string_agg(source, ' · ' ORDER BY k) AS label FROM m WHERE k <= 3 GROUP BY lang""")
program("warmups", ["conversations"], "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) < 3")
program("graph_eligible", ["documents", "labels"], "SELECT source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY source HAVING count(*) >= 5")
program("attribution_tiers", ["documents", "labels"], """WITH v AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents WHERE lang <> 'en' GROUP BY source, lang)
    SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN d.lang END, v.lang, d.lang) AS project, CASE WHEN l.quality = 1 THEN 1 WHEN v.lang IS NOT NULL THEN 2 ELSE 3 END AS tier FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN v ON v.source = d.source AND v.k = 1""")
program("observations", ["events"], """SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'mutation' WHEN event_type = 'view' THEN 'read' ELSE 'observation' END AS operation, get_json_object(props, '$.k') AS target FROM events""", """SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'mutation' WHEN event_type = 'view' THEN 'read' ELSE 'observation' END AS operation, json_extract_string(props, '$.k') AS target FROM events""")
program("rollup_missing", ["documents", "labels"], "SELECT d.doc_id, d.n_chars FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, d.n_chars FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
program("content_store", ["documents"], "SELECT sha2(text, 256) AS hash, count(*) AS refs, min(doc_id) AS first_id, max(doc_id) AS latest_id, min(length(text)) AS chars FROM documents GROUP BY sha2(text, 256)", "SELECT sha256(text) AS hash, count(*) AS refs, min(doc_id) AS first_id, max(doc_id) AS latest_id, CAST(min(length(text)) AS INTEGER) AS chars FROM documents GROUP BY sha256(text)")
program("audit_append", ["events"], "SELECT e.event_id, e.event_type FROM events e LEFT ANTI JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) seen ON seen.event_id = e.event_id", "SELECT e.event_id, e.event_type FROM events e ANTI JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) seen ON seen.event_id = e.event_id")
program("edge_validators", ["lineitem", "orders"], """SELECT 'orphan' AS defect, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey) UNION ALL
    SELECT 'repeated', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x""")
program("meta_threshold", ["documents"], "WITH meta AS (SELECT 'least_chars' AS key, '1500' AS value) SELECT doc_id FROM documents WHERE n_chars >= (SELECT CAST(value AS BIGINT) FROM meta WHERE key = 'least_chars')")
program("json_membership", ["events"], "SELECT event_id FROM events WHERE array_contains(from_json('[1, 3, 5]', 'array<int>'), CAST(get_json_object(props, '$.k') AS INT))", "SELECT event_id FROM events WHERE list_contains([1, 3, 5], CAST(json_extract_string(props, '$.k') AS INTEGER))")
program("lenient_cast", ["pages"], r"SELECT page_id, coalesce(try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT), 0) AS n FROM pages", r"SELECT page_id, coalesce(try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT), 0) AS n FROM pages")
program("padded_keys", ["supplier"], "SELECT s_suppkey, lpad(CAST(s_suppkey AS STRING), 8, '0') AS key, rtrim('0123456789', s_name) AS bare FROM supplier", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS key, rtrim(s_name, '0123456789') AS bare FROM supplier")
program("negative_substr", ["customer"], "SELECT c_custkey, substr(c_name, -4) AS tail, instr(c_name, '#') AS at FROM customer", "SELECT c_custkey, substr(c_name, -4) AS tail, CAST(instr(c_name, '#') AS INTEGER) AS at FROM customer")
program("day_parts", ["events"], "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS shown, unix_timestamp(ts) AS epoch, datediff(ts, timestamp'2024-01-01 00:00:00') AS days FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, CAST(date_diff('day', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS days FROM events")
program("null_safe_changes", ["labels", "documents"], "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT (l.quality <=> 1)", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS DISTINCT FROM 1")
