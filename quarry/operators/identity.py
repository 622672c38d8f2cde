"""Identity of files through renames: what was seen where, as intervals, and how unknown mentions are led back to a file.

History rows: file_id, path, hash, since, until (null: now). A snapshot is the set of (path, hash) seen at one time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "file_id string, path string, hash string, since bigint, until bigint"


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def new_id(path, at):
    """An identity that follows from where and when a file was first seen, so that a repeated run gives the same."""
    return F.substring(F.sha2(F.concat_ws("|", path, F.lit(at).cast("string")), 256), 1, 16)


def advance(history: DataFrame, snapshot: DataFrame, at: int) -> DataFrame:
    """History after a snapshot (path, hash) at time ``at``.

    A path that is still there keeps its file, whatever its content. Of the paths that went and those that came, those of
    equal content are renames: with several of one content the first by path that went becomes the first that came, and
    so on, so a file has one path and a path one file. Other paths that came are new files, others that went are closed.
    Of a path that the snapshot holds twice the smallest hash counts; null paths and hashes are not seen.
    """
    seen = snapshot.where("path IS NOT NULL AND hash IS NOT NULL").groupBy("path").agg(F.min("hash").alias("hash"))
    open_, closed = history.where("until IS NULL"), history.where("until IS NOT NULL")
    both = open_.select("file_id", "path", F.col("hash").alias("was"), "since").join(seen, "path", "full_outer")
    went, came = both.where("hash IS NULL"), both.where("file_id IS NULL")
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("path"))  # copies of one content; ties have different paths
    old = went.select("file_id", F.col("path").alias("old_path"), F.col("was").alias("hash")).withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("old_path")))
    named = came.select("path", "hash").withColumn("n", nth).join(old, ["hash", "n"], "left")
    stay = both.where("file_id IS NOT NULL AND hash IS NOT NULL")
    moved = F.col("was") != F.col("hash")
    kept = stay.where(~moved).select("file_id", "path", "hash", "since", F.lit(None).cast("bigint").alias("until"))
    changed_before = stay.where(moved).select("file_id", "path", F.col("was").alias("hash"), "since", F.lit(at).cast("bigint").alias("until"))
    changed_now = stay.where(moved).select("file_id", "path", "hash", F.lit(at).cast("bigint").alias("since"), F.lit(None).cast("bigint").alias("until"))
    ended = went.select("file_id", "path", F.col("was").alias("hash"), "since", F.lit(at).cast("bigint").alias("until"))
    begun = named.select(F.coalesce("file_id", new_id("path", at)).alias("file_id"), "path", "hash", F.lit(at).cast("bigint").alias("since"), F.lit(None).cast("bigint").alias("until"))
    out = closed.select("file_id", "path", "hash", "since", "until")
    for part in (kept, changed_before, changed_now, ended, begun):
        out = out.unionByName(part)
    return out


def locate(mentions: DataFrame, history: DataFrame, path: str = "path", hash_: str = "hash", at: str = "at") -> DataFrame:
    """Mentions with file_id and how it was found: by the path at that time, by content, by a path it had at another time; else null.

    Content counts only where one file has ever had it, a path of another time only where one file has ever had that path.
    A mention without time is located by the present. Intervals include their start and exclude their end; a path's intervals
    don't overlap, so each mention keeps one row.
    """
    m = mentions.withColumn("_m", F.monotonically_increasing_id())
    m = m.withColumn("_key", F.struct(*mentions.columns))
    when = F.col(at) if at in mentions.columns else F.lit(None).cast("bigint")
    m = m.select("_key", F.col(path).alias("path"), (F.col(hash_) if hash_ in mentions.columns else F.lit(None)).cast("string").alias("hash"), when.alias("at"))
    spans = history.select("path", "since", "until", F.col("file_id").alias("by_path")).withColumn("path_", F.col("path")).drop("path")
    inside = F.when(m["at"].isNull(), F.col("until").isNull()).otherwise((m["at"] >= F.col("since")) & (F.col("until").isNull() | (m["at"] < F.col("until"))))
    m = m.join(spans, (m["path"] == F.col("path_")) & inside, "left").drop("path_", "since", "until")
    one = lambda c, name: history.groupBy(c).agg(F.min("file_id").alias(name), F.max("file_id").alias("_x")).where(F.col(name) == F.col("_x")).drop("_x")
    m = m.join(one("hash", "by_hash"), "hash", "left").join(one("path", "by_past"), "path", "left")
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_hash").isNotNull(), "content").when(F.col("by_past").isNotNull(), "past path")
    return m.select("_key.*", F.coalesce("by_path", "by_hash", "by_past").alias("file_id"), how.alias("how"))


def heal(rows: DataFrame, history: DataFrame, path: str = "path", hash_: str = "hash", at: str = "at") -> DataFrame:
    """``rows`` with their null file_id filled where it can be located; what is set stays."""
    lost = rows.where("file_id IS NULL").drop("file_id")
    found = locate(lost, history, path, hash_, at).drop("how").select(*rows.columns)
    return rows.where("file_id IS NOT NULL").unionByName(found)


def audit(rows: DataFrame, history: DataFrame) -> DataFrame:
    """One row: rows, those without an identity, with one that history doesn't know, share covered, files and files ever renamed."""
    known = history.select("file_id").distinct().withColumn("_known", F.lit(True))
    each = rows.select("file_id").join(known, "file_id", "left")
    cover = each.agg(F.count("*").alias("rows"), F.count_if(F.col("file_id").isNull()).alias("missing"), F.count_if(F.col("file_id").isNotNull() & F.col("_known").isNull()).alias("unknown"))
    files = history.groupBy("file_id").agg(F.countDistinct("path").alias("paths")).agg(F.count("*").alias("files"), F.count_if(F.col("paths") > 1).alias("renamed"))
    share = F.round(F.when(F.col("rows") > 0, (F.col("rows") - F.col("missing") - F.col("unknown")) / F.col("rows")).otherwise(1.0), 4)
    return cover.crossJoin(files).select("rows", "missing", "unknown", share.alias("covered"), "files", "renamed")  # one row each
