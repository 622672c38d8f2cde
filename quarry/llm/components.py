"""Connected components by contraction: each round every node joins its smallest neighbour and edges shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, partitions


def hot_keys(rows: DataFrame, key: str, n: int, weight: str | None = None) -> list:
    """Keys that hold more than two tasks' share of the ``n`` rows each, so fewer than half as many keys as partitions.

    ``weight``: a column that tells how many rows a row stands for.
    """
    held = F.sum(weight) if weight else F.count("*")
    bound = max(2 * n // partitions(rows.sparkSession), 64)
    return [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).agg(held.alias("_held")).where(F.col("_held") > bound).select(key).collect()]


def look_up(rows: DataFrame, key: str, table: DataFrame, hot: list) -> DataFrame:
    """Left join of ``rows`` with ``table``, whose keys are unique.

    Rows of the ``hot`` keys (see ``hot_keys``) stay where they are and meet theirs by a broadcast of that many rows at most;
    the others meet by a shuffle. Null keys find nothing.
    """
    if not hot:
        return rows.join(table.hint("merge"), key, "left")
    few = rows.sparkSession.createDataFrame(table.where(F.col(key).isin(hot)).collect(), table.schema)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(~is_hot).join(table.hint("merge"), key, "left").unionByName(rows.where(is_hot).join(F.broadcast(few), key, "left"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): one for each node of ``edges``, label the smallest node it reaches.

    Null ends and loops are ignored, repeated edges count once; an empty input gives an empty result. Pointers are
    followed by doubling, so a round merges whole trees. Both sides of every join grow with the edges, so none is
    broadcast but for the few nodes at which many rows meet. Only those and counts reach the driver.
    """
    live = cut(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    )
    label, total = None, 0
    while edges := live.count():
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = cut(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")))
        nodes = up.count()
        while True:
            to = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = cut(look_up(up, "label", to, hot_keys(up, "label", nodes)).select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
            up = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label, total = up, nodes
        else:
            step = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            label = look_up(label, "label", step, hot_keys(label, "label", total)).select("node", F.coalesce("next", "label").alias("label"))
        label = cut(label)
        hot_a, hot_b = hot_keys(live, "a", edges), hot_keys(live, "b", edges)
        live = look_up(live, "a", up.select(F.col("node").alias("a"), F.col("label").alias("la")), hot_a)
        live = look_up(live, "b", up.select(F.col("node").alias("b"), F.col("label").alias("lb")), hot_b)
        live = cut(
            live.where("la != lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct()
        )
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label
