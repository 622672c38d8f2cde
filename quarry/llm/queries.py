"""The thin queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import archive, concurrency, divergence, jaccard_join, lm_score, mixing, near_dedup, packing, pii, quality, sharding, topk, whitening
from quarry.llm.common import read

HELD_OUT = 5
THRESHOLD = 0.3
#: Tokens of the domain 'good' are kept with this margin, so that clean documents stay.
MARGIN = 1.02


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(HELD_OUT))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(read(spark, sf_dir, "documents"), tokenizer_path()))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"), where=_fold() != 0)
    out = quality.score(docs, model)
    return out.select("doc_id", (_fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_texts(read(spark, sf_dir, "documents"), n=4, threshold="0.85")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(read(spark, sf_dir, "documents"))


def op7_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(read(spark, sf_dir, "pages"))


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [n(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), shards=24)


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(read(spark, sf_dir, "labels"))
    return mixing.rates(read(spark, sf_dir, "documents"), labels, mixing.TARGETS, hold="good", margin=MARGIN)


def op11_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.rules(read(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op12_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = concurrency.open_sales(*(read(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients")))
    return concurrency.sweep(sales, total=-2).withColumnsRenamed({"key": "nation_id", "open_amount": "open_cents"})


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_ngram_jaccard_join, op4_exact_top_k, op5_embedding_near_dedup, op6_lm_scoring, op7_legacy_archives, op8_pii_boosting, op9_hash_tree_sharding, op10_soft_mixing, op11_distribution_divergence, op12_peak_concurrency, op13_jacobi_whitening)}

def _divergence_sql() -> str:
    """Op11 by text functions and lists: two rounds of mean histograms, the second without what the first rejects."""
    vocabulary = sorted({w for own in divergence.COMMON.values() for w in own})
    listed = ", ".join(f"('{w}', {k + 1})" for k, w in enumerate(vocabulary))
    langs = ", ".join(f"'{g}'" for g in divergence.COMMON)
    only = lambda c: f"length(regexp_replace(t, '[^{c}]', '', 'g'))"
    part = "CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(z[{0}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
    js = lambda a, b: f"sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda z: {part.format(1)} + {part.format(2)})) / 2, 0))"
    mean = lambda name, rows: f"""{name}_p AS (SELECT lang, list(a ORDER BY k) AS p FROM (SELECT lang, k, avg(x) AS a FROM (SELECT lang, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM {rows}) GROUP BY lang, k) GROUP BY lang),
        {name}_w AS (SELECT lang, list(a ORDER BY k) AS w FROM (SELECT lang, k, avg(x) AS a FROM (SELECT lang, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM {rows}) GROUP BY lang, k) GROUP BY lang)"""  # noqa: E731
    judge = lambda name, rows, refs: f"""{name}_d AS (SELECT h.id, min(CASE WHEN n_chars >= 200 THEN {js('h.p', 'a.p')} END) AS cd, min(CASE WHEN n_words >= 50 THEN {js('h.w', 'b.w')} END) AS wd FROM {rows} h, {refs}_p a JOIN {refs}_w b USING (lang) GROUP BY h.id),
        {name} AS (SELECT h.*, cd, wd, coalesce(cd > 0.13 + 0.6 / sqrt(n_chars), false) OR coalesce(wd > 0.25 + 1.3 / sqrt(n_words), false) AS far FROM {rows} h LEFT JOIN {name}_d USING (id))"""  # noqa: E731
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
        e AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)),
        g AS (SELECT id, k, word, lead(word) OVER x AS b, lead(word, 2) OVER x AS c FROM e WINDOW x AS (PARTITION BY id ORDER BY k)),
        again AS (SELECT id, k FROM (SELECT id, k, count(*) OVER (PARTITION BY id, word, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
        hit AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, unnest([k, k + 1, k + 2]) AS k FROM again) GROUP BY id),
        lines AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
        counts AS (SELECT id, count(*) AS n, sum(length(word)) AS chars FROM e GROUP BY id), v AS (SELECT * FROM (VALUES {listed}) v(word, j)),
        low AS (SELECT id, CASE WHEN right(x, 1) IN (',', '.') THEN left(x, -1) ELSE x END AS word FROM (SELECT id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM e)),
        known AS (SELECT id, j, count(*) AS n FROM low JOIN v USING (word) GROUP BY id, j), grid AS (SELECT d.id, v.j, coalesce(known.n, 0) AS n FROM d CROSS JOIN v LEFT JOIN known ON known.id = d.id AND known.j = v.j),
        common AS (SELECT id, list(n ORDER BY j) AS l, sum(n) AS n FROM grid GROUP BY id),
        classes AS (SELECT id, [length(regexp_replace(t, '[\x00-\x7F]', '', 'g')), {only('a-z')}, {only('A-Z')}, {only(chr(92) + 'x20')}, {only(chr(92) + 'x09-' + chr(92) + 'x0D')}, {only(".,;:''" + chr(92) + '-')}, {only('#*$%&|<>')}] AS l, length(regexp_replace(t, '[0-9]', '', 'g')) AS n, {only('#*$%&|<>')} AS symbols FROM d),
        h AS (SELECT d.id, doc_id, lang, coalesce(counts.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, symbols AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, classes.n AS n_chars,
                     list_transform(list_append(classes.l, classes.n - list_sum(classes.l)), lambda x: x / greatest(classes.n, 1)) AS p, list_transform(list_append(common.l, coalesce(counts.n, 0) - common.n), lambda x: x / greatest(coalesce(counts.n, 0), 1)) AS w
              FROM d JOIN classes USING (id) JOIN common USING (id) LEFT JOIN counts USING (id) LEFT JOIN lines USING (id) LEFT JOIN hit USING (id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h),
        sound AS (SELECT min(id) AS id, lang, n_words, n_chars, p, w FROM f WHERE NOT base_failed AND lang IN ({langs}) GROUP BY lang, n_words, word_chars, n_chars, p, w),
        {mean('first', 'sound')}, {judge('tried', 'sound', 'first')}, close AS (SELECT * FROM tried WHERE NOT far), {mean('second', 'close')}, {judge('done', 'f', 'second')}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM done"""


ORACLES = {
    "op11_distribution_divergence": _divergence_sql(),
    "op7_legacy_archives": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op12_peak_concurrency": """
        WITH shipped AS (SELECT sale_id, max(shipped_at) AS last FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id),
        nations AS (SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id),
        s AS (SELECT coalesce(nation_id, -1) AS nation_id, CAST(floor(epoch(sold_at) / 60) AS BIGINT) * 60 AS a, CAST(floor(epoch(last) / 60) AS BIGINT) * 60 + 604800 AS b,
                     coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents
              FROM sales LEFT JOIN shipped USING (sale_id) LEFT JOIN nations USING (client_id) WHERE sold_at IS NOT NULL),
        own AS (SELECT * FROM s WHERE b IS NULL OR b > a),
        ends AS (SELECT nation_id, a AS t, 1 AS n, cents FROM own UNION ALL SELECT nation_id, b, -1, -cents FROM own WHERE b IS NOT NULL),
        twice AS (SELECT * FROM ends UNION ALL SELECT -2, t, n, cents FROM ends),
        steps AS (SELECT nation_id, t, CAST(sum(n) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM twice GROUP BY nation_id, t),
        runs AS (SELECT nation_id, t AS from_s, lead(t) OVER w AS to_s, CAST(sum(n) OVER w AS BIGINT) AS n_open, CAST(sum(cents) OVER w AS BIGINT) AS open_cents
                 FROM steps WHERE n <> 0 OR cents <> 0 WINDOW w AS (PARTITION BY nation_id ORDER BY t))
        SELECT CAST(nation_id AS INTEGER) AS nation_id, from_s, to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s) AS high_open,
               n_open = max(n_open) OVER (PARTITION BY nation_id) AS is_peak FROM runs""",
}
