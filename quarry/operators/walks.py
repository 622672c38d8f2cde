"""Walks over edges by frontiers: callers, redirects, branches, lineage, link graphs, delegation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.state import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    """Drop the lineage that a loop builds up, by way of the folder in spark.checkpoint.dir, which a cluster has to name."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def state(n):
    """How a name resolves, by the number of its definitions."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "unresolved").when(n == 1, "unique").otherwise("ambiguous")


def impact(symbols: DataFrame, calls: DataFrame, symbol: str, depth: int) -> DataFrame:
    """Transitive callers of ``symbol``: id, name, least depth, resolution_state, truncated.

    ``symbols``: def_id, name; ``calls``: caller_id, callee_name. The first wave counts whatever the name means; later
    ones follow only where the root and the caller's name each have one definition. ``truncated`` says whether callers
    not seen lie beyond ``depth``.
    """
    defined = symbols.groupBy("name").agg(F.count("*").alias("n"))
    roots = symbols.where(F.col("name") == symbol).select(F.col("def_id").alias("caller_id"))
    safe = symbols.join(defined.where("n = 1"), "name").select(F.col("def_id").alias("id"), F.col("name").alias("callee_name"))
    alone = roots.count() == 1
    first = calls.where(F.col("callee_name") == symbol).join(roots, "caller_id", "left_anti")
    wave = _cut(first.select(F.col("caller_id").alias("id")).distinct())
    seen, at, more = wave.withColumn("depth", F.lit(1)), 1, False
    while alone:
        step = wave.join(safe, "id").join(calls, "callee_name").join(roots, "caller_id", "left_anti").select(F.col("caller_id").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        step = _cut(step)
        if step.isEmpty():
            break
        if at == depth:
            more = True
            break
        at += 1
        seen, wave = _cut(seen.unionByName(step.withColumn("depth", F.lit(at)))), step
    named = seen.join(symbols.select(F.col("def_id").alias("id"), "name"), "id").join(defined, "name", "left")
    return named.select("id", "name", "depth", state(F.col("n")).alias("resolution_state"), F.lit(more).alias("truncated"))


def callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call with how its name resolves: caller_id, callee_name, candidates, state and the definition where it is the only one."""
    defined = symbols.groupBy("name").agg(F.count("*").alias("candidates"), F.min("def_id").alias("one"))
    out = calls.join(defined, calls["callee_name"] == defined["name"], "left")
    return out.select("caller_id", "callee_name", F.coalesce("candidates", F.lit(0)).alias("candidates"), state(F.col("candidates")).alias("state"), F.when(F.col("candidates") == 1, F.col("one")).alias("def_id"))


def follow(redirects: DataFrame, most: int = 10) -> DataFrame:
    """source, final and hops of each redirect chain; a loop or ``most`` hops end it where it is."""
    step = redirects.select(F.col("source").alias("at"), F.col("target").alias("next"))
    live = redirects.select("source", F.col("target").alias("at"), F.lit(1).alias("hops"), F.array("source", "target").alias("path"))
    done = None
    for _ in range(most):
        on = live.join(step, "at", "left")
        ended = F.col("next").isNull() | F.array_contains("path", F.col("next")) | (F.col("hops") >= most)
        over = on.where(ended).select("source", F.col("at").alias("final"), "hops")
        done = over if done is None else done.unionByName(over)
        live = _cut(on.where(~ended).select("source", F.col("next").alias("at"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("next")).alias("path")))
        if live.isEmpty():
            break
    return done


def lineage(edges: DataFrame, node: str, most: int = 63) -> DataFrame:
    """node and distance of all that stands above ``node`` in a tree (columns child, parent), itself included."""
    at = edges.sparkSession.createDataFrame([(node, 0)], "node string, distance int")
    out = at
    for k in range(1, most):
        at = _cut(at.join(edges, at["node"] == edges["child"]).where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.lit(k).alias("distance")).join(out.select("node"), "node", "left_anti"))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out


def branches(messages: DataFrame, session: str = "session", node: str = "id", parent: str = "parent", order: str = "at") -> DataFrame:
    """Rows with branch (0 is the first) and forks of their session.

    The first child goes on with its parent's branch, each further child opens the next one, wave by wave and in order.
    Messages whose parent is not known start the walk. One wave is one join.
    """
    among = Window.partitionBy(session, parent).orderBy(order, node)
    known = messages.select(F.col(session).alias("_s"), F.col(node).alias("_p"))
    rows = messages.join(known, (messages[session] == known["_s"]) & (messages[parent] == known["_p"]), "left").withColumn("_root", F.col("_p").isNull()).drop("_s", "_p")
    rows = _cut(rows.withColumn("_k", F.when(F.col("_root"), F.row_number().over(Window.partitionBy(session, "_root").orderBy(order, node))).otherwise(F.row_number().over(among))))
    forks = rows.where(~F.col("_root")).groupBy(session, parent).count().where("count > 1").groupBy(session).agg(F.count("*").alias("forks"))
    wave = rows.where(F.col("_root")).select(session, F.col(node).alias("_n"), (F.col("_k") - 1).alias("branch"))
    used = wave.groupBy(session).agg(F.max("branch").alias("_used"))
    out = wave
    while True:
        step = rows.where(~F.col("_root")).select(session, F.col(node).alias("_n"), F.col(parent).alias("_up"), order, "_k").join(wave.select(session, F.col("_n").alias("_up"), F.col("branch").alias("_b")), [session, "_up"])
        opened = F.sum((F.col("_k") > 1).cast("int")).over(Window.partitionBy(session).orderBy("_b", "_up", "_k").rowsBetween(Window.unboundedPreceding, 0))
        step = step.join(used, session).withColumn("branch", F.when(F.col("_k") == 1, F.col("_b")).otherwise(F.col("_used") + opened))
        wave = _cut(step.select(session, "_n", F.col("branch").cast("int").alias("branch")))
        if wave.isEmpty():
            break
        used = used.unionByName(wave.groupBy(session).agg(F.max("branch").alias("_used"))).groupBy(session).agg(F.max("_used").alias("_used"))
        out = out.unionByName(wave)
    named = out.select(F.col(session), F.col("_n").alias(node), F.col("branch").cast("int").alias("branch"))
    return messages.select(session, node).join(named, [session, node], "left").join(forks, session, "left").withColumn("forks", F.coalesce("forks", F.lit(0)))


def delegation(edges: DataFrame, busy: int = 5) -> DataFrame:
    """node, parent, depth (-1: not reached from a root), children and orchestrator (more than ``busy``) of edges parent, child."""
    nodes = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).where("node IS NOT NULL").distinct()
    degree = edges.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.countDistinct("child").alias("children"))
    up = edges.where("parent IS NOT NULL").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    seen = wave = _cut(nodes.join(up, "node", "left_anti").withColumn("depth", F.lit(0)))
    depth = 0
    while not wave.isEmpty():
        depth += 1
        wave = _cut(wave.select(F.col("node").alias("parent")).join(edges, "parent").select(F.col("child").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(wave)
    out = nodes.join(seen, "node", "left").join(degree, "node", "left").join(up, "node", "left")
    return out.select("node", "parent", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("children", F.lit(0)).alias("children"), (F.coalesce("children", F.lit(0)) > busy).cast("int").alias("orchestrator"))


def tree_defects(tree: DataFrame) -> DataFrame:
    """(id, defect) of a tree (id, parent_id, depth, position): all seven kinds."""
    one = tree.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("parent_id", "depth", "position")).alias("r")).select("id", "n", "r.*")
    bad = lambda rows, name: rows.select("id", F.lit(name).alias("defect"))
    above = one.select(F.col("id").alias("parent_id"), F.col("depth").alias("above"), F.lit(1).alias("there"))
    placed = one.join(above, "parent_id", "left")
    out = bad(one.where("n > 1"), "duplicate").unionByName(bad(one.where("id = parent_id"), "self_parent"))
    out = out.unionByName(bad(placed.where("parent_id IS NOT NULL AND there IS NULL"), "missing_parent"))
    out = out.unionByName(bad(one.where("depth < 0"), "invalid_depth")).unionByName(bad(placed.where("above IS NOT NULL AND depth <> above + 1 AND id <> parent_id"), "depth_mismatch"))
    twice = one.where("position IS NOT NULL").groupBy("parent_id", "position").count().where("count > 1")
    out = out.unionByName(bad(one.alias("a").join(twice.alias("b"), F.expr("a.parent_id <=> b.parent_id AND a.position = b.position")).select("a.id"), "duplicate_position"))
    # what is left when leaves are taken away again and again, downwards from the roots, lies on or below a cycle
    left = one.where("parent_id IS NOT NULL").select("id", "parent_id").join(one.select(F.col("id").alias("parent_id")), "parent_id")
    while True:
        on = _cut(left.join(left.select(F.col("id").alias("parent_id")), "parent_id", "left_semi"))
        kept = _cut(on.join(on.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi"))
        if kept.count() == left.count():
            return out.unionByName(bad(kept, "cycle"))
        left = kept
