"""Peak concurrency: open intervals at every moment of change, by dyadic decomposition of time.

An interval of ticks is the disjoint union of at most two dyadic nodes a level, so the intervals that hold a moment are
those with a node among the moment's ancestors. Node values are summed once; moments then meet their ancestors by an
equi-join, a few levels at a time: a tier's sums stand for all levels above it in the next. Nodes are numbered as in a
heap (root 1, the parent of i is i >> 1). Running maxima are taken inside blocks of ticks and carried over between blocks.
Nothing sorts the moments of a key in one task: a block has a bounded number of ticks, and a key has as many rows of
block maxima as its time span has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import stored
from quarry.llm.components import hot_keys, look_up


def minute(df: DataFrame, column: str) -> Column:
    """A timestamp's UTC seconds since 1970, rounded down to a multiple of 60. One without a zone is read as UTC."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60
    return F.floor(F.unix_seconds(c) / 60) * 60


def cover(spans: DataFrame, bits: int) -> DataFrame:
    """Rows (key, id, n, amount): the dyadic nodes that make up each [s, e), summed by key and node; 0 <= s < e <= 2**bits."""
    at = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("e") - F.col("s")) + 1e-9).cast("int"))))
    at = at.withColumns({"left": F.expr("shiftright(s + shiftleft(1L, level) - 1, level)"), "right": F.expr("shiftright(e, level)")}).where(F.col("left") < F.col("right"))
    ends = F.array(F.when(F.col("left") % 2 == 1, F.col("left")), F.when(F.col("right") % 2 == 1, F.col("right") - 1))
    nodes = at.select("key", "level", "n", "amount", F.explode(ends).alias("node")).where(F.col("node").isNotNull())
    return nodes.groupBy("key", (F.expr(f"shiftleft(1L, {bits} - level)") + F.col("node")).alias("id")).agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def sums_of_ancestors(moments: DataFrame, nodes: DataFrame, bits: int, tier: int = 4) -> DataFrame:
    """Rows (key, id, n, amount) for the leaves ``id`` of ``moments`` (key, id): sums over the nodes on the way to the root."""
    high = bits + 1
    above = moments.select("key", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("amount")).distinct()
    while high > 0:
        low = max(0, high - tier)
        points = moments.select("key", F.shiftright("id", low).alias("id"))
        points = points.distinct() if low else points
        own = nodes.where((F.col("id") >= 1 << (bits + 1 - high)) & (F.col("id") < 1 << (bits + 1 - low))).unionByName(above)
        ways = points.select("key", F.col("id").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(high - low))).alias("up")).select("key", "of", F.expr("shiftright(of, up)").alias("id"))
        above = ways.join(own, ["key", "id"]).groupBy("key", F.col("of").alias("id")).agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
        high = low
    return above


def sweep(intervals: DataFrame, total: int | None = None, tick: int = 60, block: int = 1024) -> DataFrame:
    """Per key and moment of change: key, from_s, to_s, n_open, open_amount, high_open, is_peak.

    ``intervals`` has key, start and end in seconds (both rounded down to ``tick``; end excluded, null: never) and a whole
    amount (null: 0). Those with a null start or an end not after the start take no part. A null key is a key. ``total``
    counts every interval again under that key. A moment is where the starts and ends of a key together change the number
    of open intervals or the sum of their amounts; repeated intervals count each. to_s is the key's next moment (null for
    the last), high_open the most open so far, is_peak whether n_open is the key's most over all its moments. Equal
    intervals are summed before anything is decomposed, so a hot key weighs as much as it has different intervals. No
    intervals, no rows.
    """
    unit = lambda c: F.floor(F.col(c) / tick).cast("long")
    rows = intervals.select("key", unit("start").alias("s"), unit("end").alias("e"), F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"))
    rows = rows.where("s IS NOT NULL AND (e IS NULL OR e > s)")
    spans = stored(rows.groupBy("key", "s", "e").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")))
    first, last_s, last_e = spans.agg(F.min("s"), F.max("s"), F.max("e")).first()
    first = first or 0
    bits = (max(last_s or 0, last_e or 0, first) - first + 1).bit_length()
    spans = spans.withColumns({"s": F.col("s") - first, "end": F.col("e") - first, "e": F.coalesce(F.col("e") - first, F.lit(1 << bits))})

    def with_total(sums: DataFrame, by: str) -> DataFrame:
        if total is None:
            return sums
        every = sums.groupBy(by).agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")).select(F.lit(total).cast(sums.schema["key"].dataType).alias("key"), by, "n", "amount")
        return sums.unionByName(every)

    ends = F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("sign")))
    steps = spans.select("key", "n", "amount", F.inline(ends)).where("t IS NOT NULL")
    steps = steps.groupBy("key", "t").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum(F.col("amount") * F.col("sign")).alias("amount"))
    # a null key would find nothing in joins: it travels as a flag beside a stand-in
    kind = intervals.schema["key"].dataType
    moments = with_total(steps, "t").where("n <> 0 OR amount <> 0").select("key", (F.col("t") + (1 << bits)).alias("id"))
    whole = lambda df: df.withColumn("key", F.struct(F.col("key").isNull().alias("none"), F.coalesce("key", F.lit(0).cast(kind)).alias("key")))
    swept = stored(sums_of_ancestors(whole(stored(moments)), whole(with_total(cover(spans, bits), "id")), bits))
    swept = swept.withColumns({"t": F.col("id") - (1 << bits), "block": F.floor((F.col("id") - (1 << bits)) / block)})
    inside = Window.partitionBy("key", "block").orderBy("t")
    between = Window.partitionBy("key").orderBy("block")
    blocks = swept.groupBy("key", "block").agg(F.max("n").alias("top"), F.min("t").alias("t"))
    blocks = blocks.select(
        "key", "block", F.lead("t").over(between).alias("after"), F.max("top").over(between.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.max("top").over(Window.partitionBy("key")).alias("most")
    )
    out = swept.withColumns({"next": F.lead("t").over(inside), "high": F.max("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(blocks, ["key", "block"])
    seconds = lambda c: ((c + first) * tick).cast("long")
    return out.select(
        F.when(~F.col("key.none"), F.col("key.key")).alias("key"),
        seconds(F.col("t")).alias("from_s"),
        seconds(F.coalesce("next", "after")).alias("to_s"),
        F.col("n").alias("n_open"),
        F.col("amount").alias("open_amount"),
        F.greatest("high", "before").alias("high_open"),
        (F.col("n") == F.col("most")).alias("is_peak"),
    )


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, grace_days: int = 7) -> DataFrame:
    """Rows (key, start, end, amount) of ``sales``: from the sale until the last shipping of its lines plus ``grace_days``.

    key is the client's nation (-1 if it or the client isn't known; the smallest, if a client has several), amount the
    total in cents (null or not finite: 0). Sales with a null id or without shipped lines never end. Clients with more than
    two tasks' share of the sales, fewer than half as many as partitions, are looked up without moving their sales.
    """
    shipped = lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").groupBy("sale_id").agg(F.max(minute(lines, "shipped_at")).alias("last"))
    nations = clients.where("client_id IS NOT NULL").groupBy("client_id").agg(F.min("nation_id").alias("nation_id"))
    total = F.col("total").cast("double")
    cents = F.when(total.isNull() | F.isnan(total) | (F.abs(total) == float("inf")), F.lit(0)).otherwise(F.floor(100 * total + 0.5)).cast("long")
    sold = sales.where("sold_at IS NOT NULL").select("sale_id", "client_id", minute(sales, "sold_at").alias("start"), cents.alias("amount"))
    hot = hot_keys(sold, "client_id", sales.count())
    met = look_up(sold.join(shipped, "sale_id", "left"), "client_id", nations, hot)
    return met.select(F.coalesce(F.col("nation_id").cast("int"), F.lit(-1)).alias("key"), "start", (F.col("last") + grace_days * 86400).alias("end"), "amount")
