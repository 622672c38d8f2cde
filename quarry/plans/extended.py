"""Registered queries over searches in SQL, density clusters, projections, stores and sections, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import density, identity
from quarry.operators.state import new_folder, stored
from quarry.operators.vector_store import VectorStore
from quarry.plans.catalog import _bm25, _vec
from quarry.plans.projection import Spec, compile_projection, read_objects
from quarry.plans.searches import Searches
from quarry.sources.lines import Lines, messages
from quarry.sources.tables import table, views
from quarry.streaming.replace import ReplacedFiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _searches(spark: SparkSession, folder: str) -> Searches:
    views(spark, folder, ["documents", "embeddings"])
    return Searches(spark, table(spark, folder, "embeddings"), table(spark, folder, "documents"))


# ---- searches in SQL -----------------------------------------------------------------------------------------------


@query(f"SELECT r.vec_id, label, score, z FROM ({_vec('list_inner_product(v, q)', 'raw - 0.5 * list_inner_product(v, (SELECT v FROM u WHERE vec_id = 4))', 'label IN (1, 2)', 40)}) r JOIN embeddings USING (vec_id)")
def search_join(spark, folder):
    """Vector search with a pre-filter as a table of a query; the quoted and the commented call are none."""
    return _searches(spark, folder).sql(
        """SELECT v.id AS vec_id, e.label, v.score, v._z AS z -- not vec_ops('similar:this')
           FROM vec_ops(:q, 'SELECT vec_id FROM embeddings WHERE label IN (1, 2)') v JOIN embeddings e ON e.vec_id = v.id WHERE 'vec_ops(1)' <> ''""",
        {"q": "centroid:1,2,3 suppress:4 pool:40"},
    )


@query(f"""WITH k AS ({_bm25(['thing', 'erth'], "lang = 'en'")}), v AS ({_vec('list_inner_product(v, q)', 'raw', limit=500)})
    SELECT doc_id, source, round(0.5 * rank + 0.5 * score, 4) AS hybrid FROM k JOIN v ON k.doc_id = v.vec_id JOIN documents USING (doc_id)""")
def search_hybrid(spark, folder):
    """Keyword and vector search joined with each other and with documents in one query."""
    return _searches(spark, folder).sql(
        """SELECT d.doc_id, d.source, round(0.5 * k.rank + 0.5 * v.score, 4) AS hybrid
           FROM keyword('thing erth', 'SELECT doc_id FROM documents WHERE lang = ''en''') k JOIN vec_ops('centroid:1,2,3') v ON v.id = k.id JOIN documents d ON d.doc_id = k.id"""
    )


# ---- density clusters ----------------------------------------------------------------------------------------------


@query()
def density_clusters(spark, folder):
    """Each vector's density cluster inside its label, and whether it represents the cluster (the farthest from its centre)."""
    vectors = table(spark, folder, "embeddings")
    found = density.clusters(vectors, density.neighbour_graph(vectors, "label", k=15), "label", least=5, samples=3)
    picks = density.representatives(vectors, found).select("vec_id", F.lit(True).alias("represents"))
    return found.join(picks, "vec_id", "left").select("label", "vec_id", "cluster", F.round("core", 6).alias("core"), F.coalesce("represents", F.lit(False)).alias("represents"))


# ---- states that are kept ----------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS object_key, CASE WHEN source = 'src3' THEN 2 ELSE 1 END AS version, md5(coalesce(text, '') || CASE WHEN source = 'src3' THEN '!' ELSE '' END) AS content FROM documents WHERE coalesce(lang, '?') <> 'es'")
def projection_objects(spark, folder):
    """Documents projected twice: a source changes and a language goes in between, so only that source's rows are written again."""
    views(spark, folder, ["documents"])
    path = new_folder(spark, "projection")
    refs = "SELECT CAST(doc_id AS STRING) AS object_key, 'benchmark' AS target_cell_id, CAST(doc_id % 50 AS STRING) AS target_object_id, 'near' AS relation FROM documents"
    rows = "SELECT CAST(doc_id AS STRING) AS object_key, {} AS content, coalesce(lang, '?') AS object_kind, doc_id AS source_order FROM documents"
    targets = table(spark, folder, "benchmark").select(F.lit("benchmark").alias("target_cell_id"), F.col("item_id").alias("target_object_id"))
    compile_projection(spark, path, Spec("docs", rows.format("coalesce(text, '')"), refs, targets=targets))
    now = rows.format("concat(coalesce(text, ''), CASE WHEN source = 'src3' THEN '!' ELSE '' END)") + " WHERE coalesce(lang, '?') <> 'es'"
    compile_projection(spark, path, Spec("docs", now, refs + " WHERE coalesce(lang, '?') <> 'es'", targets=targets))
    return read_objects(spark, path).select("object_key", F.col("version").cast("int").alias("version"), F.md5(F.col("content").cast("binary")).alias("content"))


@query(
    """WITH v AS (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND vec_id IS NOT NULL), m AS (SELECT avg(vec_id) AS middle FROM v),
    n AS (SELECT count(*) FILTER (vec_id <= middle) AS held, count(*) FILTER (vec_id > middle) AS fresh FROM v, m)
    SELECT vec_id, CASE WHEN vec_id > middle AND fresh <= greatest(10000, held * 0.25) THEN 2 ELSE 1 END AS segment FROM v, m, n"""
)
def vector_store_append(spark, folder):
    """Vectors stored in two steps, as they come: those above the highest key are a segment of their own, unless they are many."""
    source = table(spark, folder, "embeddings")
    store = VectorStore(spark, new_folder(spark, "vectors"))
    middle = source.where("embedding IS NOT NULL AND size(embedding) = 64").agg(F.avg("vec_id")).first()[0]
    store.refresh(source.where(F.col("vec_id") <= (middle or 0)))
    store.refresh(source)
    return store.read().select("vec_id", "segment")


@query(
    """SELECT source || '/' || lang AS path, doc_id, CASE WHEN lang = 'en' AND source <> 'src3' THEN 2 ELSE 1 END AS arrival, CASE WHEN lang = 'en' AND source <> 'src3' THEN md5(upper(lang) || doc_id) ELSE md5(coalesce(text, '')) END AS content
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND lang <> 'fr'"""
)
def replaced_files(spark, folder):
    """A file for each source and language, then a batch that replaces the English ones (one of them broken) and removes the French."""
    docs = table(spark, folder, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    rows = docs.select(F.concat_ws("/", "source", "lang").alias("path"), F.lit(1).alias("arrival"), "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), F.lit(True).alias("ok"), F.lit(False).alias("gone"), "lang", "source")
    files = ReplacedFiles(spark, new_folder(spark, "files"), good=F.col("ok"), removed="gone", buckets=16)
    files(rows.drop("lang", "source"), 0)
    again = rows.where("lang IN ('en', 'fr')").withColumns({"arrival": F.lit(2), "content": F.md5(F.concat(F.upper("lang"), "doc_id").cast("binary")), "ok": F.col("source") != "src3", "gone": F.col("lang") == "fr"})
    again = again.withColumn("ok", F.col("ok") | F.col("gone"))
    files(again.drop("lang", "source"), 1)
    return files.read().select("path", "doc_id", "arrival", "content")


@query("SELECT conv_id, turn, role, md5(coalesce(text, '')) AS text FROM conversations")
def stream_lines(spark, folder):
    """Conversations written as JSON lines and read back by the line source as a stream."""
    spark.dataSource.register(Lines)
    top = new_folder(spark, "lines")
    table(spark, folder, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text"))).write.text(f"{top}/in")
    rows = spark.readStream.format("lines").options(path=f"{top}/in", suffix=".txt").load()
    rows.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start().awaitTermination()
    read = messages(spark.read.parquet(f"{top}/out"), "conv_id bigint, turn bigint, role string, text string").where("broken IS NULL")
    return read.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))


# Three snapshots of pages: the address without its query; some hosts get another one; then contents change.
_PATHS = """p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path, md5(coalesce(html, '')) AS hash FROM pages WHERE url IS NOT NULL),
    s1 AS (SELECT path, min(hash) AS hash FROM p GROUP BY path), s2 AS (SELECT replace(path, '//m.', '//mobile.') AS path, min(hash) AS hash FROM p GROUP BY 1)"""


@query(
    f"""WITH {_PATHS}, went AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM s1 WHERE path NOT IN (SELECT path FROM s2)), came AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM s2 WHERE path NOT IN (SELECT path FROM s1)),
    moved AS (SELECT came.path, came.hash, went.path AS old FROM came LEFT JOIN went USING (hash, n)),
    rows AS (SELECT s1.path AS first, s1.path AS path, s1.hash, 1 AS since, CASE WHEN s1.path IN (SELECT path FROM went) OR s1.hash <> s2.hash THEN 2 END AS until, 1 AS born FROM s1 LEFT JOIN s2 USING (path)
        UNION ALL SELECT coalesce(old, path), path, hash, 2, NULL, CASE WHEN old IS NULL THEN 2 ELSE 1 END FROM moved UNION ALL SELECT s1.path, s1.path, s2.hash, 2, NULL, 1 FROM s1 JOIN s2 USING (path) WHERE s1.hash <> s2.hash)
    SELECT substr(sha256(first || '|' || born), 1, 16) AS file_id, path, hash, CAST(since AS BIGINT) AS since, CAST(until AS BIGINT) AS until FROM rows"""
)
def file_identities(spark, folder):
    """Pages as files: the identities of addresses when the mobile hosts are renamed, told by content."""
    pages = table(spark, folder, "pages").where("url IS NOT NULL").select(F.regexp_extract("url", "^[^?#]*", 0).alias("path"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("hash"))
    first = stored(identity.advance(identity.nothing(spark), pages, 1))
    return identity.advance(first, pages.withColumn("path", F.replace("path", F.lit("//m."), F.lit("//mobile."))), 2)
