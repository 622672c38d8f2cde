"""Keyword search with BM25. Statistics are of the whole index, a pre-filter only restricts what is ranked."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import bare, folded, lowered, sanitise, split_terms, terms
from quarry.operators.semantic import once
from quarry.operators.state import stored

K1, B = 1.2, 0.75
#: Bytes of terms that a task turns into posting lists at a time.
CHUNK = 64 << 20


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: term, key, tf, dl; terms of a document are counted before anything is shuffled."""
    rows = docs.select(key, terms(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    return rows.select(key, "dl", F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def keyword(docs: DataFrame, query: str, where: Column | DataFrame | None = None, key: str = "doc_id", text: str = "text", limit: int = 200) -> DataFrame:
    """key, bm25, rank in [0, 1], matched_tokens, dropped_tokens of the best ``limit`` rows, by a scan of all texts.

    All terms must occur; if no row of the scope (a condition, or a table of keys) has all, any may. The texts are read
    once; their lengths and frequencies are kept for the statistics and the ranking. ``ranked`` reads a written index instead.
    Only texts that hold a term as a substring are split into terms, once. Rank is min-max over what is returned; a single or equal score gives 0.5.
    """
    words = list(dict.fromkeys(sanitise(query)))
    rows = docs.withColumn("_f", folded(F.col(text)))
    if isinstance(where, DataFrame):
        rows = rows.join(where.select(F.col(where.columns[0]).alias(key)).distinct().withColumn("_in", F.lit(True)), key, "left").select(key, F.coalesce("_in", F.lit(False)).alias("_in"), "_f")
    else:
        rows = rows.select(key, (F.lit(True) if where is None else where).alias("_in"), "_f")
    terms_ = lambda f: F.when(_any(f.contains(w) for w in words), split_terms(f)).otherwise(F.array().cast("array<string>"))
    counts = lambda t: F.array(*(F.size(F.filter(t, _is(w))) for w in words)).cast("array<int>")
    found = once(F.col("_f"), lambda f: F.struct(F.regexp_count(f, F.lit(r"[\p{L}\p{N}]+")).alias("dl"), once(terms_(f), counts).alias("tf")))
    rows = rows.select(key, "_in", found.alias("_c")).select(key, "_in", F.col("_c.dl").alias("_dl"), F.col("_c.tf").alias("_tfs"))
    rows = stored(rows).select(key, "_in", "_dl", *(F.element_at("_tfs", i + 1).alias(f"_tf{i}") for i in range(len(words))))  # a few numbers a text
    known = rows.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *(F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(words))), *_hits(words))
    return _best(rows.where("_in").crossJoin(F.broadcast(known)), words, key, limit or 200)


def _hits(words: list[str]) -> list[Column]:
    """Whether a row of the scope has all words, and each of them."""
    in_scope = F.col("_in")
    every = F.lit(bool(words))
    for i in range(len(words)):
        every = every & (F.col(f"_tf{i}") > 0)
    return [F.coalesce(F.bool_or(in_scope & every), F.lit(False)).alias("_and"), *(F.coalesce(F.bool_or(in_scope & (F.col(f"_tf{i}") > 0)), F.lit(False)).alias(f"_hit{i}") for i in range(len(words)))]


def _best(rows: DataFrame, words: list[str], key: str, limit: int) -> DataFrame:
    """Scores of rows that carry _dl, the frequencies _tf and the statistics _n, _avg, _df, _and and _hit."""
    n = len(words)
    score, some, every = F.lit(0.0), F.lit(False), F.lit(True)
    for i in range(n):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
        some, every = some | (tf > 0), every & (tf > 0)
    found = rows.where(some & (~F.col("_and") | every))
    pick = lambda on: F.array_compact(F.array(*(F.when(F.col(f"_hit{i}") == on, w) for i, w in enumerate(words)))) if n else F.array().cast("array<string>")
    best = found.select(key, score.alias("bm25"), pick(True).alias("matched_tokens"), pick(False).alias("dropped_tokens")).orderBy(F.desc("bm25"), key).limit(limit)
    whole = Window.partitionBy()  # at most `limit` rows
    low, high = F.min("bm25").over(whole), F.max("bm25").over(whole)
    rank = F.when(high > low, (F.col("bm25") - low) / (high - low)).otherwise(0.5)
    return best.select(key, F.round("bm25", 6).alias("bm25"), F.round(rank, 6).alias("rank"), F.array_join("matched_tokens", ",").alias("matched_tokens"), F.array_join("dropped_tokens", ",").alias("dropped_tokens"))


def _is(word: str):
    return lambda x: x == word


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def term_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What an index keeps of each term: df, cf and the longest document that holds it."""
    return postings(docs, key, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("dl").alias("longest"))


@dataclass(frozen=True)
class Index:
    """A written index below ``path``: postings and terms in folders by a hash of the term, documents, totals."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def read(self, part: str) -> DataFrame:
        """documents, terms and totals as they are; of the lists of postings a row for each posting."""
        rows = self.spark.read.parquet(f"{self.path}/{part}")
        rows = rows.where("bucket >= 0") if "bucket" in rows.columns else rows
        if part != "postings":
            return rows
        key = next(c for c in rows.columns if c not in ("term", "_n", "tf", "dl", "_batch", "bucket"))
        return rows.select("term", "bucket", F.inline(F.arrays_zip(key, "dl", "tf"))).select("term", key, "dl", F.col("tf").cast("long").alias("tf"), "bucket")

    def of(self, part: str, words: list[str]) -> DataFrame:
        """Rows of a few terms; other folders aren't read, and of the files in them only the row groups that may hold the terms."""
        asked = set(self.spark.range(1).select(*(_bucket(self.buckets, F.lit(w)) for w in words)).first()) if words else []
        return self.read(part).where(F.col("bucket").isin(asked) & F.col("term").isin(words)).drop("bucket")


def _bucket(buckets: int, term: str | Column = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


def _lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Posting lists of chunks of documents, made without a shuffle: term, _n (their length), key, tf, dl. A row without a term lists all documents of a chunk.

    Marks are taken off the different words of a chunk, not off its texts.
    """
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("_n", T.LongType()), T.StructField(key, T.ArrayType(docs.schema[key].dataType)), T.StructField("tf", numbers), T.StructField("dl", numbers)])

    def lists(batches):
        keys, found = pa.Table.from_batches(batches).columns
        batches.clear()  # the texts' words go once they are numbers
        keys, n, dl, marked = keys.combine_chunks(), len(keys), pc.list_value_length(found).to_numpy(), pc.list_flatten(found).dictionary_encode().combine_chunks()
        del found
        words = bare(marked.dictionary).dictionary_encode()
        size = len(words.dictionary)
        word = words.indices.to_numpy(zero_copy_only=False)[marked.indices.to_numpy(zero_copy_only=False)]
        pairs, tf = np.unique(word.astype(np.int64) * n + np.repeat(np.arange(n, dtype=np.int32), dl), return_counts=True)
        word, doc, tf = np.append(pairs // n, np.full(n, size)), np.append(pairs % n, np.arange(n)), np.append(tf, dl)
        cuts = np.searchsorted(word, np.arange(size + 2))
        listed = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x)
        terms_ = pa.concat_arrays([words.dictionary, pa.nulls(1, words.dictionary.type)])
        return pa.RecordBatch.from_arrays([terms_, pa.array(np.diff(cuts), pa.int64()), listed(keys.take(pa.array(doc))), listed(pa.array(tf, pa.int32())), listed(pa.array(dl[doc], pa.int32()))], names=schema.names)

    def chunks(batches):
        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + b.nbytes
            if size >= CHUNK:
                yield lists(held)
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield lists(held)

    return docs.select(key, split_terms(lowered(F.col(text))).alias("t")).mapInArrow(chunks, schema)


def write_index(docs: DataFrame, path: str, buckets: int = 64, spread: int = 8, key: str = "doc_id", text: str = "text", mode: str = "overwrite") -> Index:
    """Write postings (lists of key, tf, dl for each term), document counts of terms, documents (key, dl) and totals.

    Tasks put chunks of documents into posting lists, so the texts are read and split once and a list is shuffled, not its
    postings; the other parts are made of the written lists. A bucket's lists are dealt to ``spread`` tasks by the tasks
    that made them, as one frequent term can be most of them, and sorted by term there. Bucket -1 has the lists of all documents.
    Keys are told apart by value: repeated or null keys are refused by ``index_drift``, not here.
    """
    spark, index, batch = docs.sparkSession, Index(docs.sparkSession, path, buckets), uuid.uuid4().hex
    lists = _lists(docs, key, text).withColumns({"_batch": F.lit(batch), "bucket": F.when(F.col("term").isNull(), -1).otherwise(_bucket(buckets)), "_from": F.spark_partition_id() % spread})
    lists.repartition("bucket", "_from").drop("_from").sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    own = spark.read.parquet(f"{path}/postings").where(F.col("_batch") == batch)
    written = own.where("bucket = -1").select(F.inline(F.arrays_zip(key, "dl")))
    written.write.mode(mode).parquet(f"{path}/docs")
    own.groupBy("term", "bucket").agg(F.sum("_n").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/terms")
    written.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).write.mode(mode).parquet(f"{path}/totals")
    return index


def read_index(spark: SparkSession, path: str, words: list[str], buckets: int = 64) -> DataFrame:
    """Postings of a few terms from a written index."""
    return Index(spark, path, buckets).of("postings", words)


def append_index(index: Index, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Add the documents whose keys the index doesn't hold; what is there isn't rewritten."""
    fresh = docs.join(index.read("docs").select(key), key, "left_anti")
    fresh = fresh.join(fresh.groupBy(key).count().where("count = 1").select(key), key, "left_semi")
    keys = [r for r in fresh.select(key).limit(1).collect()]
    return write_index(fresh.select(key, text), index.path, index.buckets, key=key, text=text, mode="append") if keys else index


def index_drift(index: Index, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: documents the index lacks, those it holds in vain, those whose length differs, and keys that are null or repeated."""
    now = docs.select(key, F.size(terms(F.col(text))).alias("now")).groupBy(key).agg(F.count("*").alias("rows"), F.first("now").alias("now"))
    both = now.join(index.read("docs").withColumn("held", F.lit(True)), key, "full_outer")
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(
        total(F.col("held").isNull()).alias("missing"), total(F.col("rows").isNull()).alias("orphaned"),
        total(F.coalesce(F.col("now") != F.col("dl"), F.lit(False))).alias("changed"), total(F.coalesce(F.col("rows") > 1, F.lit(False)) | F.col(key).isNull()).alias("unusable"),
    )


def ranked(index: Index, query: str, scope: DataFrame | None = None, key: str = "doc_id", limit: int = 200) -> DataFrame:
    """As ``keyword``, from a written index: only the folders of the query's terms are read.

    The statistics are three small reads (totals, and the document counts of the query's terms). ``scope`` is a table of
    keys that the postings are semi-joined with before anything is summed.
    """
    words = list(dict.fromkeys(sanitise(query)))
    n, length = index.read("totals").agg(F.sum("n"), F.sum("length")).first()
    df = {r[0]: r[1] for r in index.of("terms", words).groupBy("term").agg(F.sum("df")).collect()} if words else {}
    rows = index.of("postings", words) if words else index.read("postings").drop("bucket").limit(0)
    if scope is not None:
        rows = rows.join(scope.select(F.col(scope.columns[0]).alias(key)), key, "left_semi")
    tfs = [F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, w in enumerate(words)]
    rows = rows.groupBy(key, F.col("dl").alias("_dl")).agg(F.count("*").alias("_held"), *tfs).withColumn("_in", F.lit(True))
    rows = rows.crossJoin(F.broadcast(rows.agg(*_hits(words))))
    known = {"_n": F.lit(n or 0), "_avg": F.lit((length or 0) / max(n or 0, 1))} | {f"_df{i}": F.lit(df.get(w, 0)) for i, w in enumerate(words)}
    return _best(rows.withColumns(known), words, key, limit or 200)


def matches(t: Column, query: str, whole: bool = False) -> Column:
    """With ``whole``: whether a folded text may answer the query, by its substrings. Else: whether an array of terms answers a query of words, "phrases", pre*, NEAR(a b c, n), AND, OR, NOT and brackets.

    Words side by side must both occur; NOT binds tighter than AND, AND than OR. NEAR: at most n other terms between the
    outermost. A query that lacks a term or a bracket raises ValueError.
    """
    tokens = re.findall(r'NEAR\([^)]*\)|"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def atom() -> Column:
        nonlocal at
        if at >= len(tokens) or tokens[at] in (")", "AND", "OR"):
            raise ValueError(f"a term is missing {'before ' + tokens[at] if at < len(tokens) else 'at the end'} of {query!r}")
        x = tokens[at]
        at += 1
        if x == "(":
            inner = either()
            if at >= len(tokens):
                raise ValueError(f"a bracket is open in {query!r}")
            at += 1
            return inner
        if x == "NOT":
            inner = atom()
            return F.lit(True) if whole else ~inner
        if x.startswith("NEAR("):
            body, _, n = x[5:-1].partition(",")
            near = [sanitise_word(w) for w in body.split()]
            if len(near) < 2:
                raise ValueError(f"NEAR takes two terms or more: {x}")
            if whole:
                return _all(t.contains(w) for w in near)
            # all within n terms between the first and the last: some window that starts at a hit holds them all
            width = int(n or 10) + len(near)
            hit = F.filter(F.transform(t, lambda y, i: F.when(y.isin(near), i + 1)), lambda i: i.isNotNull())
            return F.exists(hit, lambda i: _all(F.array_contains(F.slice(t, i, width), w) for w in near))
        if x.startswith('"'):
            words = [w for w in (sanitise_word(w) for w in x.strip('"').split()) if w]
            if whole:
                return _all(t.contains(w) for w in words)
            return F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")  # terms hold no blanks
        if whole:
            return t.contains(sanitise_word(x))
        if x.endswith("*"):
            return F.exists(t, lambda y: y.startswith(sanitise_word(x[:-1])))
        return F.array_contains(t, sanitise_word(x))

    def both() -> Column:
        nonlocal at
        out = atom()
        while at < len(tokens) and tokens[at] not in (")", "OR"):
            at += tokens[at] == "AND"
            out = out & atom()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            out = out | both()
        return out

    if not tokens:
        return F.lit(False)
    out = either()
    if at < len(tokens):
        raise ValueError(f"a bracket is closed but not opened in {query!r}")
    return out


def sanitise_word(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


def search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the rows that answer an explicit query (see ``matches``); only texts that hold what it asks for as substrings are split, once."""
    answers = lambda f: F.when(matches(f, query, whole=True), once(split_terms(f), lambda t: matches(t, query))).otherwise(False)
    return docs.select(key, once(folded(F.col(text)), answers).alias("_hit")).where("_hit").select(key)


def snippet(t: Column, words: list[str], size: int = 30) -> Column:
    """``size`` terms around the first hit, hits marked, dots where something is cut."""
    hits = F.filter(F.transform(t, lambda y, i: F.when(y.isin(words), i + 1)), lambda i: i.isNotNull())
    start = F.greatest(F.least(F.element_at(F.concat(hits, F.array(F.lit(1))), 1) - size // 2, F.size(t) - size + 1), F.lit(1))
    shown = F.array_join(F.transform(F.slice(t, start, size), lambda y: F.when(y.isin(words), F.concat(F.lit(">>>"), y, F.lit("<<<"))).otherwise(y)), " ")
    return F.concat(F.when(start > 1, "...").otherwise(""), shown, F.when(start + size - 1 < F.size(t), "...").otherwise(""))
