"""Stored vectors that grow by segments: append what is new, notice what went, rebuild where that is cheaper; move to another model.

A state names its segments, the highest key, the count and the length of vectors and the model that made them. Searches
read the segments of one state, so a refresh or a move never shows them half done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.semantic import unit
from quarry.operators.state import stored
from quarry.sources.versions import Versions


@dataclass(frozen=True)
class Refreshed:
    """``action``: rebuilt, appended or fresh; ``reason`` of a rebuild; rows written."""

    action: str
    reason: str
    rows: int
    version: int


class Refused(ValueError):
    """A staged set of vectors failed its checks; the one in use stays."""


class VectorStore:
    """Unit vectors (key, vector, segment) below ``path``. Keys are whole numbers that grow with time, as row numbers do."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", column: str = "embedding", most_rows: int = 10_000, most_share: float = 0.25) -> None:
        self.spark, self.key, self.column = spark, key, column
        self.versions = Versions(spark, path)
        self.most_rows, self.most_share = most_rows, most_share

    def usable(self, source: DataFrame, dims: int | None) -> DataFrame:
        v = F.col(self.column)
        rows = source.where(F.col(self.key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))))
        return rows if dims is None else rows.where(F.size(v) == dims)

    def _unit(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(self.key).cast("long").alias(self.key), unit(F.transform(self.column, lambda x: x.cast("double"))).alias(self.column))

    def _write(self, rows: DataFrame, segment: int) -> tuple[dict, DataFrame]:
        folder = self.versions.folder()
        self._unit(rows).withColumn("segment", F.lit(segment)).write.parquet(self.versions.at(folder))
        back = self.spark.read.parquet(self.versions.at(folder))
        n, low, high = back.agg(F.count("*"), F.min(self.key), F.max(self.key)).first()
        return {"folder": folder, "rows": n, "low": low, "high": high}, back

    def rebuild(self, source: DataFrame, reason: str, model: str | None = None) -> Refreshed:
        """Write all of ``source`` as one segment. Vectors have the most common length (of two, the longer); a repeated key counts once."""
        number, state = self.versions.latest()
        common = self.usable(source, None).groupBy(F.size(self.column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims = common["d"] if common else 0
        segment, _ = self._write(self.usable(source, dims).dropDuplicates([self.key]), 1)
        state = {"segments": [segment], "high": segment["high"], "count": segment["rows"], "dims": dims, "model": model or state.get("model")}
        return Refreshed("rebuilt", reason, segment["rows"], self.versions.commit(state, number))

    def refresh(self, source: DataFrame) -> Refreshed:
        """Bring the store up to ``source``: rows above the highest key are appended as a segment.

        All is rebuilt if nothing is stored yet, if ``source`` holds fewer usable vectors than the store (some went, and which
        is not known), or if more came than ``most_rows`` and than ``most_share`` of those stored. A row that goes while another
        comes keeps the count and is found at the next rebuild only.
        """
        number, state = self.versions.latest()
        if not number or not state["count"]:
            return self.rebuild(source, "nothing stored")
        rows = self.usable(source, state["dims"])
        total, fresh = rows.agg(F.countDistinct(self.key), F.countDistinct(F.when(F.col(self.key) > state["high"], F.col(self.key)))).first()
        if total < state["count"]:
            return self.rebuild(source, "vectors went")
        if not fresh:
            return Refreshed("fresh", "", 0, number)
        if fresh > max(self.most_rows, state["count"] * self.most_share):
            return self.rebuild(source, "many are new")
        segment, _ = self._write(rows.where(F.col(self.key) > state["high"]).dropDuplicates([self.key]), len(state["segments"]) + 1)
        after = state | {"segments": [*state["segments"], segment], "high": segment["high"], "count": state["count"] + segment["rows"]}
        return Refreshed("appended", "", segment["rows"], self.versions.commit(after, number))

    def read(self) -> DataFrame:
        """The vectors of the last state."""
        number, state = self.versions.latest()
        if not number:
            raise ValueError("nothing is stored here")
        return self.spark.read.parquet(*(self.versions.at(s["folder"]) for s in state["segments"]))

    def drift(self, source: DataFrame) -> DataFrame:
        """One row: keys of ``source`` that the store lacks, and keys it holds that ``source`` lost (which searches may still return)."""
        dims = self.versions.latest()[1]["dims"]
        both = self.usable(source, dims).select(F.col(self.key).cast("long").alias("k")).distinct().withColumn("a", F.lit(1)).join(self.read().select(F.col(self.key).alias("k"), F.lit(1).alias("b")), "k", "full_outer")
        return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("ghosts"))

    def move(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, probes: int = 64, alike: float = 0.999) -> Refreshed:
        """Embed all of ``texts`` (key, text) by another model into a staged segment, check it, and only then serve it.

        The stage must hold every key once, vectors of one length without zeros or non-finite entries; of ``probes`` keys
        spread by hash, embedding the text again must give a vector of cosine ``alike`` or more to the stored one, and the
        stored one must have itself as its nearest. Otherwise ``Refused`` is raised and the former vectors go on serving.
        """
        number, state = self.versions.latest()
        made = stored(embed(texts).select(F.col(self.key).cast("long").alias(self.key), F.col(self.column).cast("array<double>").alias(self.column)))
        want = texts.select(F.col(self.key).cast("long").alias(self.key)).where(F.col(self.key).isNotNull())
        lacking = want.distinct().join(made, self.key, "left_anti").count()
        extra = made.count() - want.distinct().count()
        if lacking or extra:
            raise Refused(f"{lacking} keys without a vector, {extra} vectors too many")
        length, shape = made.agg(F.max(F.size(self.column)), F.countDistinct(F.size(self.column))).first()
        broken = made.where(~F.forall(self.column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) | ~F.exists(self.column, lambda x: x != 0)).count()
        if shape != 1 or not length or broken:
            raise Refused(f"{shape} lengths of vectors, {broken} of them broken")
        segment, back = self._write(made, 1)
        picked = back.orderBy(F.xxhash64(self.key), self.key).limit(probes)  # bounded by `probes`
        again = self._unit(embed(texts.join(F.broadcast(picked.select(self.key)), self.key, "left_semi"))).withColumnRenamed(self.column, "_again")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        apart = picked.join(again, self.key).where(dot(F.col(self.column), F.col("_again")) < alike).count()
        if apart or picked.join(again, self.key).count() < picked.count():
            raise Refused(f"{apart} of {probes} probes embed to another vector now")
        lost = self._lost(picked, back)
        if lost:
            raise Refused(f"{lost} of {probes} probes don't find themselves")
        after = {"segments": [segment], "high": segment["high"], "count": segment["rows"], "dims": length, "model": model}
        return Refreshed("rebuilt", "another model", segment["rows"], self.versions.commit(after, number))

    def _lost(self, picked: DataFrame, back: DataFrame) -> int:
        """How many of the picked vectors (a bounded number, shipped as a matrix) have another vector nearer than themselves."""
        rows = picked.select(self.key, self.column).collect()
        if not rows:
            return 0
        ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        key, column = self.key, self.column

        def nearest(batches):
            import pyarrow as pa

            best, own = np.full(len(q), -2.0), np.full(len(q), -2.0)
            for b in batches:
                if len(b):
                    k = b.column(key).to_numpy()
                    cosine = q @ b.column(column).flatten().to_numpy().reshape(len(k), -1).T
                    same = ids[:, None] == k[None, :]
                    best = np.maximum(best, np.where(same, -2, cosine).max(1))
                    own = np.maximum(own, np.where(same, cosine, -2).max(1))
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(q), dtype=np.int32), "best": best, "own": own})

        met = back.select(key, column).mapInArrow(nearest, "i int, best double, own double").groupBy("i").agg(F.max("best").alias("best"), F.max("own").alias("own"))
        return met.where(F.col("best") > F.col("own") + 1e-9).count()
