"""Projections: objects, references and a tree selected by SQL, kept as a table of which only changed rows are rewritten.

A compile selects all rows, checks them, and compares a signature of every object (its row, its references and its place in
the tree) with what the last state holds. Changed and new objects and the keys of those that went form one segment; the rest
stays in the segments where it was written, vectors included. A state is committed whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.state import stored
from quarry.plans.policy import read_only
from quarry.sources.versions import Versions

OBJECTS = "object_key string, content string, object_kind string, timestamp bigint, source_order bigint"
REFERENCES = "object_key string, target_cell_id string, target_object_id string, target_object_type string, relation string, source_order bigint, evidence_basis string"
TREE = "child_key string, parent_key string, relation string, position bigint"


class ProjectionError(ValueError):
    """What was selected breaks the contract; the last state stays."""


@dataclass(frozen=True)
class Spec:
    """``targets`` is a table of (target_cell_id, target_object_id) that references may lead to; without it all are unresolved."""

    projection_id: str
    objects_sql: str
    references_sql: str | None = None
    tree_sql: str | None = None
    targets: DataFrame | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Receipt:
    projection_id: str
    version: int
    objects: int
    references: int
    unresolved: int
    tree_edges: int
    written: int
    removed: int
    kept: int
    vectors_reused: int
    vector_debt: int
    content_signature: str


def _selected(spark: SparkSession, sql: str | None, schema: str) -> DataFrame:
    if sql is None:
        return spark.createDataFrame([], schema)
    read_only(spark, sql)
    rows = spark.sql(sql)
    want = spark.createDataFrame([], schema).schema
    if lacking := [f.name for f in want if f.name not in rows.columns and f.name not in ("timestamp", "source_order", "position", "evidence_basis", "target_object_type")]:
        raise ProjectionError(f"the query lacks {', '.join(lacking)}")
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


def _refuse(bad: DataFrame, what: str) -> None:
    found = bad.limit(3).collect()  # enough for a message
    if found:
        raise ProjectionError(f"{what}: {', '.join(str(r[0]) for r in found)}")


def _checked(objects: DataFrame, references: DataFrame, tree: DataFrame) -> None:
    _refuse(objects.where("object_key IS NULL OR trim(object_key) = '' OR content IS NULL OR object_kind IS NULL").select(F.coalesce("object_key", F.lit("(null)"))), "objects without key, content or kind")
    _refuse(objects.groupBy("object_key").count().where("count > 1"), "keys that are selected twice")
    keys = objects.select("object_key")
    _refuse(references.where("target_cell_id IS NULL OR target_object_id IS NULL OR relation IS NULL").select("object_key"), "references without target or relation")
    _refuse(references.join(keys, "object_key", "left_anti").select("object_key"), "references from unknown objects")
    for end in ("child_key", "parent_key"):
        _refuse(tree.join(keys.withColumnRenamed("object_key", end), end, "left_anti").select(end), f"tree edges with an unknown {end}")
    _refuse(tree.where("child_key = parent_key").select("child_key"), "objects that are their own parent")
    _refuse(tree.groupBy("child_key").count().where("count > 1"), "objects with two parents")
    _refuse(looped(tree), "objects in a loop")


def looped(tree: DataFrame) -> DataFrame:
    """Objects (child_key) whose parents never end, by doubling: after k rounds a pointer leads 2**k parents up, so it must have left."""
    at = stored(tree.select(F.col("child_key").alias("node"), F.col("parent_key").alias("up")))
    rounds = max(at.count(), 1).bit_length()
    for _ in range(rounds):
        at = stored(at.join(at.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
        if at.isEmpty():
            break
    return at.select("node")


def signatures(objects: DataFrame, references: DataFrame, tree: DataFrame) -> DataFrame:
    """(object_key, signature, content_hash): what a change of the object, its references or its tree edges changes."""
    text = lambda *c: F.to_json(F.array(*(F.col(x).cast("string") for x in c)))
    own = lambda df, key, *c: df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(text(*c), 256))), ""), 256).alias("h"))
    links = own(references, "object_key", "target_cell_id", "target_object_id", "target_object_type", "relation", "source_order", "evidence_basis", "resolution_state").withColumnRenamed("h", "links")
    place = tree.select(F.col("child_key").alias("object_key"), F.sha2(text("parent_key", "relation", "position"), 256).alias("place"))
    under = own(tree, "parent_key", "child_key", "relation", "position").select(F.col("parent_key").alias("object_key"), F.col("h").alias("under"))
    rows = objects.select("object_key", F.sha2(text("content", "object_kind", "timestamp", "source_order"), 256).alias("row"), F.sha2("content", 256).alias("content_hash"))
    all_ = rows.join(links, "object_key", "left").join(place, "object_key", "left").join(under, "object_key", "left")
    parts = [F.coalesce(c, F.lit("-")) for c in ("row", "links", "place", "under")]
    return all_.select("object_key", F.sha2(F.concat_ws("|", *parts), 256).alias("signature"), "content_hash")


def _content_signature(signed: DataFrame) -> str:
    """Of all signatures, whatever their order: their number and the sums of four pieces of each."""
    pieces = [F.coalesce(F.sum(F.conv(F.substring("signature", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    return signed.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *pieces), 256)).first()[0]


def read_objects(spark: SparkSession, path: str, number: int | None = None, columns: list[str] | None = None) -> DataFrame | None:
    """Objects of the last state (or of ``number``): those columns, signature, content_hash, vector and the version that wrote the row; only ``columns`` travel, if given."""
    versions = Versions(spark, path)
    n, state = versions.latest() if number is None else (number, versions.state(number))
    if not n:
        return None
    rows = spark.read.parquet(*(versions.at(s) for s in state["segments"]))
    if columns is not None:
        rows = rows.select("object_key", *(c for c in columns if c not in ("object_key", "gone", "version")), "gone", "version")
    return rows.groupBy("object_key").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "object_key")), "version").alias("r")).select("object_key", "r.*").where("NOT gone").drop("gone")


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """References or tree edges of the last state."""
    versions = Versions(spark, path)
    return spark.read.parquet(versions.at(versions.latest()[1][part]))


def compile_projection(spark: SparkSession, path: str, spec: Spec, most_segments: int = 16) -> Receipt:
    """Bring the projection at ``path`` up to what its queries select now.

    Raises ``ProjectionError`` and leaves the last state, if the selection breaks the contract: keys are unique and not
    null, references and tree edges join known objects, a tree has one parent a child and no loops. A vector stays while
    the object's content does; objects without one are debt, which ``embed`` (rows object_key, content -> object_key,
    vector) pays if it can; if it fails, the state is committed without. Beyond ``most_segments`` all rows are written anew.
    """
    objects = stored(_selected(spark, spec.objects_sql, OBJECTS))
    references, tree = stored(_selected(spark, spec.references_sql, REFERENCES)), stored(_selected(spark, spec.tree_sql, TREE))
    _checked(objects, references, tree)
    if spec.targets is None:
        references = references.withColumn("resolution_state", F.lit("unresolved"))
    else:
        known = spec.targets.select(*(F.col(c).cast("string").alias(c) for c in ("target_cell_id", "target_object_id"))).distinct().withColumn("_known", F.lit(True))
        references = references.join(known, ["target_cell_id", "target_object_id"], "left").withColumn("resolution_state", F.when(F.col("_known"), "resolved").otherwise("unresolved")).drop("_known")
    references = stored(references)
    signed = stored(signatures(objects, references, tree))
    versions = Versions(spark, path)
    number, state = versions.latest()
    now = signed.join(objects, "object_key")
    before = read_objects(spark, path, columns=["signature", "content_hash", "vector"])
    empty = F.lit(None).cast("array<float>")
    if before is None:
        changed = now.withColumn("vector", empty)
        gone = None
    else:
        old = stored(before.select("object_key", F.col("signature").alias("was"), F.col("content_hash").alias("held"), "vector"))
        met = now.join(old, "object_key", "left")
        changed = met.where(~F.col("was").eqNullSafe(F.col("signature"))).withColumn("vector", F.when(F.col("held") == F.col("content_hash"), F.col("vector"))).drop("was", "held")
        gone = old.select("object_key").join(objects, "object_key", "left_anti")
    paid = None
    if spec.embed is not None:
        changed = stored(changed)  # read again by the embedding; else it goes straight into its segment
    if spec.embed is not None:
        try:
            owed = changed.where("vector IS NULL").select("object_key", "content")
            got = stored(spec.embed(owed).select("object_key", F.col("vector").cast("array<float>").alias("made")))
            paid = changed.join(got, "object_key", "left").withColumn("vector", F.coalesce("vector", "made")).drop("made")
        except Exception:  # noqa: BLE001  the vectors stay debt
            paid = None
    segment = (changed if paid is None else paid).withColumns({"gone": F.lit(False), "version": F.lit(number + 1)})
    columns = ["object_key", "content", "object_kind", "timestamp", "source_order", "signature", "content_hash", "vector", "gone", "version"]
    segment = segment.select(*columns)
    removed = 0
    if gone is not None:
        lost = gone.select("object_key", *(F.lit(None).cast(segment.schema[c].dataType).alias(c) for c in columns[1:-2]), F.lit(True).alias("gone"), F.lit(number + 1).alias("version"))
        removed = lost.count()
        segment = segment.unionByName(lost)
    total = objects.count()
    folder = versions.folder()
    segment.write.parquet(versions.at(folder))  # no state names it yet
    segment = spark.read.schema(segment.schema).parquet(versions.at(folder))
    changed = segment.where("NOT gone") if spec.embed is None else changed
    written = changed.count()
    segments = state.get("segments", [])
    if written or removed or not number:
        whole = len(segments) + 1 > most_segments
        if whole:
            keep = read_objects(spark, path).join(segment.select("object_key"), "object_key", "left_anti").withColumn("gone", F.lit(False)).select(*columns)
            folder = versions.folder()
            keep.unionByName(segment.where("NOT gone")).write.parquet(versions.at(folder))
        parts = {}
        for part, df in (("references", references), ("tree", tree)):
            parts[part] = versions.folder()
            df.write.parquet(versions.at(parts[part]))
        state = {"segments": [folder] if whole else [*segments, folder], "projection_id": spec.projection_id} | parts
        number = versions.commit(state, number)
    final = read_objects(spark, path, columns=["vector"])
    reused = changed.where("vector IS NOT NULL").count()
    counts = references.agg(F.count("*"), F.coalesce(F.sum((F.col("resolution_state") == "unresolved").cast("long")), F.lit(0))).first()
    return Receipt(spec.projection_id, number, total, counts[0], counts[1], tree.count(), written, removed, total - written, reused, final.where("vector IS NULL").count(), _content_signature(signed))


def receipt_row(spark: SparkSession, receipt: Receipt) -> DataFrame:
    return spark.createDataFrame([asdict(receipt)])
