"""Whole files replaced by a stream: readers see each file's last good rows, before, during and after a batch.

Rows lie in buckets by a hash of their file. A batch writes the buckets it touches anew, without the files it brings and with
their new rows, and then commits a state that names them; the others stay. A batch that dies leaves the former state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.versions import Versions


class ReplacedFiles:
    """Rows of files below ``path``; ``file`` names the file of a row, ``order`` tells which of a file's arrivals in a batch is the last.

    ``good``: a condition on rows; a file of which a row fails it isn't replaced, its last good rows stay. A batch may hold
    several arrivals of a file; the last good one counts. A row with ``removed`` true drops its file.
    """

    def __init__(self, spark: SparkSession, path: str, file: str = "path", order: str = "arrival", good: Column | None = None, removed: str | None = None, buckets: int = 64) -> None:
        self.spark, self.file, self.order, self.removed, self.buckets = spark, file, order, removed, buckets
        self.good = F.lit(True) if good is None else good
        self.versions = Versions(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.file), F.lit(self.buckets)).cast("int")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``; a batch that was committed before is skipped, so a restart repeats nothing."""
        number, state = self.versions.latest()
        if batch_id <= state.get("batch", -1):
            return
        rows = batch.where(F.col(self.file).isNotNull()).withColumns({"_good": F.coalesce(self.good, F.lit(False)), "_bucket": self._bucket()})
        arrivals = rows.groupBy(self.file, self.order, "_bucket").agg(F.min("_good").alias("_good"))
        last = arrivals.where("_good").groupBy(self.file, "_bucket").agg(F.max(self.order).alias(self.order))
        fresh = rows.join(last, [self.file, self.order, "_bucket"])
        if self.removed is not None:
            fresh = fresh.where(~F.coalesce(F.col(self.removed), F.lit(False)))
        fresh = fresh.drop("_good")
        touched = [r[0] for r in last.select("_bucket").distinct().collect()]  # at most `buckets`
        held = dict(state.get("buckets", {}))
        if touched:
            old = [self.versions.at(f"{held[str(b)]}/_bucket={b}") for b in touched if str(b) in held]
            if old:
                stay = self.spark.read.parquet(*old).withColumn("_bucket", self._bucket()).join(last.select(self.file), self.file, "left_anti")
                fresh = fresh.unionByName(stay, allowMissingColumns=True)
            folder = self.versions.folder()
            fresh.repartition("_bucket").write.partitionBy("_bucket").parquet(self.versions.at(folder))
            written = {str(r[0]) for r in self.spark.read.schema(fresh.schema).parquet(self.versions.at(folder)).select("_bucket").distinct().collect()}
            for b in map(str, touched):
                held.pop(b, None)
                if b in written:
                    held[b] = folder
        self.versions.commit({"batch": batch_id, "buckets": held, "schema": fresh.drop("_bucket").schema.jsonValue()}, number)

    def read(self) -> DataFrame:
        """The rows of the last committed state; a reader keeps it while later ones are committed."""
        state = self.versions.latest()[1]
        if not state:
            raise ValueError("nothing is committed here")
        held = state["buckets"]
        schema = T.StructType.fromJson(state["schema"])
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.versions.at(f"{f}/_bucket={b}") for b, f in held.items()))
