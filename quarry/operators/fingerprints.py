"""What a session was about, in a few lines: its telling texts in order, and the runs of tool calls between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

#: Most lines of a fingerprint, least characters of a text that counts.
MOST_LINES, LEAST_CHARS = 70, 50


def fingerprints(messages: DataFrame, session: str, picked: DataFrame | None = None, most: int = MOST_LINES, least: int = LEAST_CHARS) -> DataFrame:
    """(session, lines, fingerprint) of messages (session, position, tie, text, line); ``line`` is set for tool calls (see ``scalars.tool_line``).

    A text is shown by its first sentences if they have more than ``least`` characters, as [position] "text"; with ``picked``
    (session, position; representatives of clusters, say) only those are. Tool calls without a shown text between them are one
    line: a single one as it is, several by tool with their numbers, the most frequent first. If there are more than ``most``
    lines, the texts of most word entropy stay beside all tool lines, one at least. Sessions without lines have no row.
    """
    own = messages.where(F.col("position").isNotNull()).select(F.col(session).alias("s"), F.col("position").cast("long").alias("p"), "tie", "text", "line")
    texts = own.where("line IS NULL").withColumn("shown", X.sentences(F.trim("text"))).where(F.length("shown") > least)
    if picked is not None:
        texts = texts.join(picked.select(F.col(session).alias("s"), F.col("position").cast("long").alias("p")).distinct(), ["s", "p"], "left_semi")
    both = texts.select("s", "p", "tie", F.concat(F.lit("["), "p", F.lit('] "'), "shown", F.lit('"')).alias("line"), F.lit(0).alias("tool")).unionByName(own.where("line IS NOT NULL").select("s", "p", "tie", "line", F.lit(1).alias("tool")))
    at = Window.partitionBy("s").orderBy("p")
    content = F.sum(1 - F.col("tool"))
    upto = content.over(at.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.coalesce(content.over(at.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = both.withColumns({"_upto": upto, "_before": before})
    calls = Window.partitionBy("s").orderBy("p", "tie")
    tools = both.where("tool = 1").withColumn("_cut", F.coalesce((F.col("_before") > F.lag("_upto").over(calls)).cast("int"), F.lit(0))).withColumn("run", F.sum("_cut").over(calls))
    tools = tools.withColumn("name", F.regexp_extract("line", r"^op:(\w+)", 1))
    named = tools.groupBy("s", "run", "name").agg(F.count("*").alias("n"), F.min(F.struct("p", "tie")).alias("first"), F.max("p").alias("last"), F.min("line").alias("line"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", F.concat("n", F.lit("x op:"), "name").alias("part"))))
    runs = named.groupBy("s", "run").agg(F.sum("n").alias("n"), F.min("first.p").alias("p"), F.max("last").alias("last"), order.alias("parts"), F.min("line").alias("line"))
    span = F.concat(F.lit("> ["), "p", F.when(F.col("p") == F.col("last"), "").otherwise(F.concat(F.lit("-"), "last")), F.lit("] "))
    shown = runs.select("s", "p", F.lit(None).cast(own.schema["tie"].dataType).alias("tie"), F.concat(span, F.when(F.col("n") == 1, F.col("line")).otherwise(F.array_join(F.transform("parts", lambda x: x["part"]), ", "))).alias("line"), F.lit(1).alias("tool"))
    room = shown.groupBy("s").agg(F.count("*").alias("_tools"))
    rank = Window.partitionBy("s").orderBy(F.desc("_entropy"), "p", "tie")
    kept = both.where("tool = 0").select("s", "p", "tie", "line", "tool", F.round(X.entropy(X.split_terms(F.lower("line"))), 9).alias("_entropy"))
    kept = kept.withColumn("_k", F.row_number().over(rank)).join(room, "s", "left").where(F.col("_k") <= F.greatest(F.lit(most) - F.coalesce("_tools", F.lit(0)), F.lit(1)))
    lines = kept.select("s", "p", "tie", "line", "tool").unionByName(shown)
    out = lines.groupBy("s").agg(F.count("*").cast("int").alias("lines"), F.array_sort(F.collect_list(F.struct("p", "tool", "tie", "line"))).alias("l"))
    return out.select(F.col("s").alias(session), "lines", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("fingerprint"))
