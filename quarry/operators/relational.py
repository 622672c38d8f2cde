"""Windows, joins and incremental operators that knowledge queries are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.state import stored

#: Pairs that one task makes or counts, about.
PAIRS = 4_000_000


def sessions(df: DataFrame, by: str, ts: str, tie: str, hours: float) -> DataFrame:
    """df with sprint: a number that grows where the gap to the row before exceeds ``hours``."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    new = df.withColumn("_new", F.when(gap > hours * 3600, 1).otherwise(0))
    return new.withColumn("sprint", F.sum("_new").over(w)).drop("_new")


def runs(df: DataFrame, by: str, order: Sequence[str], kind: str) -> DataFrame:
    """Consecutive rows of one kind as a run: by, run, kind, n, first and last of the first order column."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = df.withColumn("_new", (~F.col(kind).eqNullSafe(F.lag(kind).over(w))).cast("int")).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(by, "run", kind).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def budget(df: DataFrame, by: str, order: str, size: Column, most: int) -> DataFrame:
    """Leading rows of each group whose running size stays within ``most``; the first always stays."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.withColumn("used", F.sum(size).over(w)).withColumn("_n", F.count("*").over(w))
    return run.where((F.col("used") <= most) | (F.col("_n") == 1)).drop("_n")


def last_before(df: DataFrame, by: str, order: str, wanted: Column, value: str, name: str) -> DataFrame:
    """As-of lookup inside groups: each row with ``value`` of the last earlier row that is wanted. One sort, no join."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(w))


def shared(df: DataFrame, node: str, attribute: str, hub: int, least: int = 1) -> DataFrame:
    """Pairs of nodes that share attribute values, with how many; values of more than ``hub`` nodes are left out.

    The pairs are counted before they are made, and as many parts are made of them as keep one to PAIRS of them or so: a task
    holds no more on a larger table.
    """
    edges = stored(df.select(node, attribute).where(F.col(attribute).isNotNull()).distinct())
    sizes = edges.groupBy(attribute).agg(F.count("*").alias("_n")).where(F.col("_n").between(2, hub))
    total = sizes.agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2)).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -int(-total // PAIRS))
    kept = edges.join(sizes.select(attribute), attribute).repartition(parts, attribute)
    other = kept.select(attribute, F.col(node).alias("target"))
    pairs = kept.select(attribute, F.col(node).alias("source")).join(other, attribute).where("source < target").select("source", "target")
    return pairs.repartition(parts, "source", "target").groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def snapshot_diff(local: DataFrame, remote: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status: new (remote only), orphan (local only), stale (digests differ) or current."""
    a, b = local.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_l")), remote.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_r"))
    status = F.when(F.col("_l").isNull(), "new").when(F.col("_r").isNull(), "orphan").when(F.col("_a").eqNullSafe(F.col("_b")), "current").otherwise("stale")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def keep_first(df: DataFrame, by: Sequence[Column], order: str) -> DataFrame:
    """The row of the smallest ``order`` of each null-safe key, by a partial aggregate rather than a window."""
    names = [f"_k{i}" for i in range(len(by))]
    keyed = df.select(F.struct(*[F.col(order), *(F.col(c) for c in df.columns if c != order)]).alias("_row"), *(c.alias(n) for c, n in zip(by, names)))
    return keyed.groupBy(*names).agg(F.min("_row").alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in df.columns))


def upsert(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the highest ``seq`` of each key among both."""
    both = base.unionByName(changes)
    row = F.struct(*(F.col(c) for c in both.columns))
    return both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.col(seq)).alias("_row")).select("_row.*")


def history(events: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Revisions: key, revision, value, from, until (null: current). Rows that repeat the value are no revision."""
    w = Window.partitionBy(key).orderBy(seq)
    changed = events.withColumn("_p", F.lag(value).over(w)).withColumn("_i", F.row_number().over(w))
    changed = changed.where((F.col("_i") == 1) | ~F.col(value).eqNullSafe(F.col("_p")))
    return changed.select(key, F.row_number().over(w).cast("long").alias("revision"), value, F.col(seq).alias("valid_from"), F.lead(seq).over(w).alias("valid_until"))


def debounce(events: DataFrame, by: Sequence[str], ts: str, quiet: float, tie: str) -> DataFrame:
    """Replay of coalescing: one row for each burst, which a quiet time of more than ``quiet`` seconds ends."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    burst = events.withColumn("_new", F.when(gap > quiet, 1).otherwise(0)).withColumn("burst", F.sum("_new").over(w))
    return burst.groupBy(*by, "burst").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def refresh_state(registry: DataFrame, as_of: str, stale_hours: float = 6) -> DataFrame:
    """Registry with state: running, stale-running, never-run, overdue, due or fresh."""
    now = F.lit(as_of).cast("timestamp").cast("double")
    age = now - F.col("last_refresh_at").cast("timestamp").cast("double")
    running = F.col("refresh_status") == "running"
    late = now - F.col("refresh_started_at").cast("timestamp").cast("double") > stale_hours * 3600
    state = F.when(running & late, "stale-running").when(running, "running").when(F.col("last_refresh_at").isNull(), "never-run").when(age > 2 * F.col("refresh_interval"), "overdue").when(age > F.col("refresh_interval"), "due").otherwise("fresh")
    return registry.withColumn("state", state)


def star(base: DataFrame, sidecars: Sequence[DataFrame], key: str) -> DataFrame:
    """base with the columns of its sidecars (left joins by ``key``); of columns with one name the first holds.

    A sidecar that has a key twice would multiply rows, so it is refused: one aggregate over its keys, before the plan.
    """
    seen, out = list(base.columns), base
    for side in sidecars:
        if not side.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty():
            raise ValueError(f"a sidecar repeats values of {key}")
        new = [c for c in side.columns if c not in seen]
        out, seen = out.join(side.select(key, *new), key, "left"), seen + new
    return out.select(*seen)


def longest_prefix(rows: DataFrame, text: str, roots: DataFrame, root: str) -> DataFrame:
    """``rows`` with the longest value of ``roots`` that ``text`` begins with (null: none).

    A text is joined once for each length that roots have, by equality of the beginning, and rows look their text up: they have
    no numbers of their own, which a second reading could deal anew. The lengths, at most as many as the longest root has
    characters, come to the driver. A repeated root counts once.
    """
    known = roots.where(F.length(root) > 0).select(F.col(root).alias("_root")).distinct()
    lengths = sorted(r[0] for r in known.select(F.length("_root")).distinct().collect())
    texts = rows.select(F.col(text).alias("_t")).distinct()
    each = texts.select("_t", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_n")).where(F.length("_t") >= F.col("_n"))
    found = each.select("_t", F.expr("substr(_t, 1, _n)").alias("_root")).join(known, "_root").groupBy("_t").agg(F.max_by("_root", F.length("_root")).alias(root))
    return rows.join(found.withColumnRenamed("_t", text), text, "left").select(*rows.columns, root)


def nearest(rows: DataFrame, by: str, order: str, wanted: Column, name: str = "near") -> DataFrame:
    """(by, order, name): for each place of a group the nearest other place that holds a wanted row; the smaller of two, null where none is.

    Two running looks, back and ahead, over one sort; no row meets another.
    """
    at = rows.groupBy(by, order).agg(F.bool_or(F.coalesce(wanted, F.lit(False))).alias("_w"))
    w = Window.partitionBy(by).orderBy(order)
    hit = F.when(F.col("_w"), F.col(order))
    both = at.select(by, order, F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_back"), F.first(hit, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_on"))
    near = F.when(F.col("_on").isNull() | (F.col(order) - F.col("_back") <= F.col("_on") - F.col(order)), F.col("_back")).otherwise(F.col("_on"))
    return both.select(by, order, near.alias(name))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the order of a hash of seed and key: the same for the same rows, whatever their order; a partial top-n, no sort of all."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)
