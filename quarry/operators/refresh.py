"""Incremental upkeep of corpora: queues, cursors, reconciliation, health, pages of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import numbered, running_total
from quarry.sources.versions import Versions


def release(events: DataFrame, by: list[str], ts: str, quiet: float, latest: float, tie: str) -> DataFrame:
    """Replay of a debounced queue: a batch ends after ``quiet`` seconds without events or ``latest`` seconds after its first.

    by, batch, n, first, last and released, in the order of release when sorted by (released, by). Batches of one key
    are a fold over its times, so that each starts where the one before ended.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / 1e6
    times = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(seconds.alias("t"), F.col(tie).alias("id")))).alias("x"))
    zero = F.array().cast("array<struct<first:double,last:double,n:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    new = lambda e: F.array(F.struct(e["t"].alias("first"), e["t"].alias("last"), F.lit(1).cast("long").alias("n")))

    def step(acc, e):
        fits = (F.size(acc) > 0) & (e["t"] - last(acc)["last"] <= quiet) & (e["t"] - last(acc)["first"] < latest)
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["first"].alias("first"), e["t"].alias("last"), (last(acc)["n"] + 1).alias("n"))))
        return F.when(fits, grown).otherwise(F.concat(acc, new(e)))

    out = times.select(*by, F.posexplode(F.aggregate("x", zero, step)).alias("batch", "b"))
    return out.select(*by, "batch", "b.n", "b.first", "b.last", F.least(F.col("b.last") + quiet, F.col("b.first") + latest).alias("released"))


def overflow(queued: DataFrame, cell: str, order: str, room: int) -> DataFrame:
    """cell, kept and owes: what a queue of ``room`` entries holds of each cell, and whether it owes a reconciliation."""
    placed = numbered(queued, [order, cell], "_k")
    return placed.groupBy(cell).agg(F.sum((F.col("_k") <= room).cast("long")).alias("kept"), F.max((F.col("_k") > room).cast("int")).alias("owes"))


def prune(stored: DataFrame, walked: DataFrame, key: str) -> DataFrame:
    """Stored rows to delete: those whose key the walk did not meet. An empty walk deletes nothing."""
    some = walked.limit(1).select(F.lit(1).alias("_some"))
    return stored.join(walked.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(some)).drop("_some")  # one row or none


def ingest(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """Arriving rows whose keys are not stored, one of each key."""
    return arriving.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def resume(lines: DataFrame, stored: DataFrame, session: str, number: str) -> DataFrame:
    """Lines past each session's highest stored number; lines that are no JSON are skipped."""
    top = stored.groupBy(session).agg(F.max(number).alias("_top"))
    return lines.join(top, session, "left").where((F.col(number) > F.coalesce("_top", F.lit(-1))) & F.get_json_object("line", "$").isNotNull()).drop("_top")


def within_bytes(rows: DataFrame, order: str, size: str, after: int, most: int) -> DataFrame:
    """Rows past the cursor ``after`` as far as ``most`` bytes go; the first is always taken. One sequence: a unit's log."""
    past = rows.where(F.col(order) > after)
    run = running_total(past, [order], F.col(size), "_used")
    first = past.agg(F.min(order).alias("_first"))
    return run.crossJoin(F.broadcast(first)).where((F.col("_used") <= most) | (F.col(order) == F.col("_first"))).drop("_used", "_first")  # one row


def orphans(bodies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks made of bodies that lost theirs: the id is session_line, tools are listed, the first time holds."""
    lost = bodies.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    part = lambda k: F.regexp_extract("chunk_id", r"^(.+)_(\d+)$", k)
    lost = lost.where(part(1) != "")
    found = lost.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.min("ts").alias("ts"))
    return found.select("chunk_id", part(1).alias("session"), part(2).cast("int").alias("line"), "tools", "ts")


def graph_stale(ops: DataFrame, least: int = 50) -> DataFrame:
    """cell, since (sources added after the last build) and stale: never built, or at least ``least`` since."""
    last = ops.where("operation = 'build'").groupBy("cell").agg(F.max("at").alias("built"))
    out = ops.select("cell").distinct().join(last, "cell", "left")
    added = ops.where("operation = 'add'").select("cell", "at", "rows")
    since = added.join(last, "cell", "left").where(F.col("built").isNull() | (F.col("at") > F.col("built"))).groupBy("cell").agg(F.sum("rows").alias("since"))
    return out.join(since, "cell", "left").select("cell", F.coalesce("since", F.lit(0)).alias("since"), (F.col("built").isNull() | (F.coalesce("since", F.lit(0)) >= least)).cast("int").alias("stale"))


def fair_batch(units: DataFrame, key: str, cursor: str, n: int) -> DataFrame:
    """The next ``n`` units after the cursor, from the start again where the end is reached."""
    return units.orderBy(F.col(key) <= cursor, key).limit(n)


def pieces(value, path: tuple = (), most: int = 1200, part: int = 900):
    """Lossless ordered pieces of a JSON value: whole where it is short, else its members, long texts in parts."""
    if len(json.dumps(value, ensure_ascii=False, separators=(",", ":"))) <= most or not isinstance(value, dict | list | str):
        yield {"path": list(path), "value": value}
    elif isinstance(value, str):
        for at in range(0, len(value), part):
            yield {"path": list(path), "string_fragment": value[at : at + part], "char_start": at, "char_end": min(at + part, len(value)), "value_chars": len(value)}
    else:
        members = list(value.items()) if isinstance(value, dict) else list(enumerate(value))
        yield {"path": list(path), "container": "object" if isinstance(value, dict) else "array", "length": len(members)}
        for name, member in members:
            yield from pieces(member, (*path, name), most, part)


def rebuilt(parts):
    """The value that ``pieces`` took apart."""
    root: list = [None]

    def put(path, value):
        at, key = root, 0
        for step in path:
            at, key = at[key], step
        if isinstance(at, list) and key == len(at):
            at.append(value)
        else:
            at[key] = value

    for p in parts:
        if "container" in p:
            put(p["path"], {} if p["container"] == "object" else [])
        elif "string_fragment" in p:
            whole = p["string_fragment"] if p["char_start"] == 0 else _get(root, p["path"]) + p["string_fragment"]
            put(p["path"], whole)
        else:
            put(p["path"], p["value"])
    return root[0]


def _get(root, path):
    at = root[0]
    for step in path:
        at = at[step]
    return at


def audit(log: Versions, snapshot: DataFrame, keys: list[str], at: int) -> int:
    """Append to an audit log what a snapshot shows that the last look at its keys did not: a row of what is seen, how and since when.

    Rows of the log: the snapshot's columns, change (new, changed or gone) and at. Nothing is rewritten: a look is one more
    segment. Returns how many rows came. A repeated key counts once, by its smallest row; null keys are no observations.
    """
    number, state = log.latest()
    row = F.struct(*sorted(snapshot.columns))
    seen = snapshot.where(F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)).groupBy(*keys).agg(F.min(row).alias("_r")).select("_r.*")
    marked = seen.withColumn("_now", F.xxhash64(*sorted(snapshot.columns)))
    if not number:
        fresh = marked.drop("_now").withColumn("change", F.lit("new"))
    else:
        last = current(log, keys).withColumn("_was", F.xxhash64(*sorted(snapshot.columns)))
        both = marked.join(last.select(*keys, "_was"), keys, "left")
        come = both.where(~F.col("_was").eqNullSafe(F.col("_now"))).withColumn("change", F.when(F.col("_was").isNull(), "new").otherwise("changed")).drop("_now", "_was")
        fresh = come.unionByName(last.drop("_was").join(seen.select(*keys), keys, "left_anti").withColumn("change", F.lit("gone")))
    folder = log.folder()
    fresh.withColumn("at", F.lit(at).cast("long")).write.parquet(log.at(folder))
    log.commit({"segments": [*state.get("segments", []), folder]}, number)
    return log.spark.read.parquet(log.at(folder)).count()


def observations(log: Versions) -> DataFrame:
    """All rows of an audit log."""
    return log.spark.read.parquet(*(log.at(s) for s in log.latest()[1]["segments"]))


def current(log: Versions, keys: list[str]) -> DataFrame:
    """What the log says is there now: of each key the row of the last look, if it isn't gone."""
    rows = observations(log)
    names = [c for c in rows.columns if c not in ("change", "at")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "at").alias("_r"))
    return last.where("_r.change <> 'gone'").select(*(F.col(f"_r.{c}").alias(c) for c in names))
