"""Scans and sinks: Parquet tables, folders of text, session lines, JSON results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


#: Folders that hold nothing to read, and kinds of files by their extension.
PRUNED = ("node_modules", "__pycache__", "venv", "dist", "build", "target")
KINDS = {"md": "note", "txt": "note", "rst": "note", "py": "code", "js": "code", "ts": "code", "sql": "code", "json": "data", "csv": "data", "yaml": "data", "tex": "paper"}


def text_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt", "rst"), most_bytes: int = 1 << 20, excludes: tuple[str, ...] = (), pruned: tuple[str, ...] = ()) -> DataFrame:
    """path, content, size, modified, kind of the allowed files below a folder.

    Hidden paths, larger files, files in folders named in ``pruned`` at any depth (see ``PRUNED``) and files whose path below
    the folder matches one of ``excludes`` (* within a name, ** across names) are left out. Contents are read after that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/")) + "/", "")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    keep = extension.isin(*extensions) & (F.col("length") <= most_bytes) & ~F.concat(F.lit("/"), below).rlike(r"/\.[^/]")
    if pruned:
        keep = keep & ~F.arrays_overlap(F.slice(F.split(below, "/"), 1, F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0))), F.array(*map(F.lit, pruned)))
    for glob in excludes:
        parts = re.split(r"(\*\*|\*)", glob)
        keep = keep & ~below.rlike("^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + "$")
    table_ = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return files.where(keep).select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.coalesce(table_[extension], F.lit("other")).alias("kind"))


def session_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def mount(docs: DataFrame, scope: str, allowed: Column, most: int = 40_000) -> DataFrame:
    """Allow-listed documents as (scope, name, path, chars, content), content clipped."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return docs.where(allowed).select(F.lit(scope).alias("scope"), name.alias("name"), "path", F.length("content").alias("chars"), F.substring("content", 1, most).alias("content"))
