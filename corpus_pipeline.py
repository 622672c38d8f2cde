"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what the next reads from Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard_join, mixing, packing, pii, quality
from quarry.llm.common import checkpoint_dir, cut, read, remove
from quarry.llm.queries import MARGIN, THRESHOLD, tokenizer_path


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = "_" + name
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts are scored like any other, repeated rows alike.

    Without labels, or with an empty table, nothing is rejected.
    """
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    name = free(docs, "_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: one with the smallest doc_id (null last). Texts without words all stay.

    Rows are told apart by doc_id and text; of rows that have both in common any one stays.
    """
    groups = cut(jaccard_join.similar_texts(docs, n=5, threshold="0.8", keepers=True))
    node = free(docs, "_node")
    left = docs.withColumn(node, F.unhex(F.md5(F.coalesce("text", F.lit("")))))

    def same(pairs: DataFrame) -> tuple[DataFrame, Column]:
        pairs = pairs.select(F.col("doc_id").alias("_id"), F.col("node").alias("_of"))
        return pairs, (left[node] == pairs["_of"]) & left["doc_id"].eqNullSafe(pairs["_id"])

    out = left.join(*same(groups.where(~F.col("keep")).select("doc_id", "node").distinct()), "left_anti")
    repeated = groups.where(F.col("keep") & (F.col("n_shingles") > 0)).groupBy("doc_id", "node").count().where("count > 1")
    if not repeated.isEmpty():
        once = left.join(*same(repeated), "left_semi").dropDuplicates(["doc_id", node])
        out = out.join(*same(repeated), "left_anti").unionByName(once)
    return out.select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text. All rows stay; null texts stay null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that domains meet their target weights; those likely good all stay, others only go.

    Null and empty texts have no tokens and a posterior like any other; repeated rows count each; an empty table stays empty.
    """
    labels = mixing.quality_domains(read(spark, sf_dir, "labels"))
    return mixing.resample(docs, labels, mixing.TARGETS, hold="good", margin=MARGIN, keep=0.5, fill=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: each piece with its ids and place. A null or empty text is one id; none, no rows."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path(), with_ids=True))


STAGES = [("quality", keep_quality), ("similar", drop_similar), ("pii", redact), ("mix", mix), ("pack", pack)]

#: SQL can't express the classifier, the boosted trees, the fit or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared checkpoint folder and read again.

    What a stage read is removed once its result is written, so only the last result stays, which the rows returned read.
    """
    checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
