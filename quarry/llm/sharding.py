"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

Every shard draws -ln(u) / weight from the hash of the key and its own path; a rack's draw is the least of its shards,
a region's the least of its racks, and a key descends to the least draw level by level. The least of exponential draws
is itself exponential with the summed weight, so each level is chosen in proportion to the weight below it, and a
changed weight moves keys only into or out of the subtree where it changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. The number is what results carry; the path names region, rack and shard."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def tree(shards: int, regions: int = 3, racks: int = 2) -> list[Shard]:
    """Equal shards dealt to regions and racks in turn, so that a tree of one more shard only adds a leaf."""
    return [Shard(n, f"r{n % regions}", f"k{n // regions % racks}") for n in range(shards)]


def _draw(key: Column, shard: Shard) -> Column:
    """Of -ln(u) / weight, u uniform in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{shard.region}/{shard.rack}/{shard.number}")), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(shard.weight)


def choose(key: Column, shards: list[Shard]) -> Column:
    """Number of the shard to which a key descends; ties go to the smaller number. Shards of weight 0 get no keys."""
    shards = [s for s in shards if s.weight > 0]  # a weight of 0 draws nothing
    if not shards:
        raise ValueError("a tree needs a shard of positive weight")
    level: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        level.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    leaf = lambda s: F.struct(_draw(key, s).alias("draw"), F.lit(s.number).alias("shard"))
    least = lambda draws: F.least(*draws) if len(draws) > 1 else draws[0]
    return least([least([least([leaf(s) for s in own]) for own in racks.values()]) for racks in level.values()])["shard"]


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """Per row: key, size, text_crc32, law ('key'), shard, slot and grown_shard (the shard with one more in the tree).

    The key and the tree alone decide, so rows with one key share a shard; a null key is a key like any other. Size is
    the text's UTF-8 bytes (null: none) plus 8, the crc32 that of its bytes (null: of none). Slots number each shard's
    rows from 0 without gaps: rows are ranked within the partitions of the checkpointed input and a table of their
    sizes supplies the offsets, so no task holds a shard, and copies or repeated keys don't gather. Repeated rows each get a slot. An empty table stays empty.
    """
    now, then = ([Shard(s.number, s.region, s.rack, (weights or {}).get(s.number, 1.0)) for s in tree(n)] for n in (shards, shards + 1))
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = cut(rows.withColumns({"shard": choose(name, now), "grown_shard": choose(name, then)}))
    rows = rows.withColumn("_block", F.spark_partition_id())
    sums = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    base = sums.withColumn("_base", F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("_rank", inside)
        .join(base, ["shard", "_block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_base") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
