"""Writes to a graph as tables of mutations, applied a batch at a time; a batch applies whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import drop, keep
from ..functions.lineage import cut
from ..model import Graph

VALUE = ("vtype", "l", "d", "b", "t")


def same_value(a: str, b: str) -> Column:
    """Equal type and value; doubles by their text, so that -0.0 is not 0.0 and NaN is NaN."""
    out = F.lit(True)
    for c in VALUE:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        out = out & (x.cast("string").eqNullSafe(y.cast("string")) if c == "d" else x.eqNullSafe(y))
    return out


def last_writes(writes: DataFrame) -> DataFrame:
    """The last write to each (object_id, key) by ``seq``; a null vtype removes the property."""
    fields = [c for c in writes.columns if c not in ("object_id", "key", "seq")]
    return writes.groupBy("object_id", "key").agg(F.max_by(F.struct(*fields), "seq").alias("w")).select("object_id", "key", "w.*")


def changes(properties: DataFrame, writes: DataFrame) -> DataFrame:
    """What the writes change: (object_id, key, vtype, l, d, b, t, source_id); equal writes are dropped."""
    old = properties.select("object_id", "key", F.struct(*VALUE).alias("o"))
    new = last_writes(writes).select("object_id", "key", F.struct(*VALUE).alias("n"), "source_id")
    joined = new.join(old, ["object_id", "key"], "left")
    differs = F.when(F.col("o").isNull(), F.col("n.vtype").isNotNull()).otherwise(~same_value("n", "o"))
    return joined.where(differs).select("object_id", "key", "n.*", "source_id")


def apply(properties: DataFrame, writes: DataFrame) -> DataFrame:
    """Properties after the writes; the last writer is the source even of a write that changes nothing."""
    new = last_writes(writes).select("object_id", "key", F.struct(*VALUE, "source_id").alias("n"))
    old = properties.select("object_id", "key", F.struct(*VALUE, "source_id").alias("o"))
    joined = old.join(new, ["object_id", "key"], "full")
    value = F.when(F.col("n").isNull(), F.col("o")).otherwise(F.col("n")).alias("v")
    return joined.select("object_id", "key", value).where("v.vtype is not null").select("object_id", "key", "v.*")


def closure(objects: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids that go with the removed ones: ports of nodes and links of ports; children stay."""
    gone = removed.select("object_id").distinct()
    own = objects.select("object_id", "kind", "node_id", "from_id", "to_id")
    ports = keep(own.where(F.col("kind").isin("INPUT", "OUTPUT")), gone, "node_id", distinct=False).select("object_id")
    first = gone.union(ports).distinct()
    links = own.where(F.col("kind") == "LINK")
    out, into = (keep(links, first, end, distinct=False).select("object_id") for end in ("from_id", "to_id"))
    return first.union(out).union(into).distinct()


def remove(graph: Graph, removed: DataFrame) -> Graph:
    # Every part of the graph is freed of them, so they are found once.
    gone = cut(closure(graph.objects, removed))
    without = lambda frame, column: drop(frame, gone, column, distinct=False)
    return graph.with_(
        objects=without(graph.objects, "object_id"),
        properties=None if graph.properties is None else without(graph.properties, "object_id"),
        contain=without(without(graph.contain, "parent_id"), "child_id"),
        declared=None if graph.declared is None else without(graph.declared, "port_id"),
        levels={},
        holders={},
    )


def retarget(objects: DataFrame, moves: DataFrame) -> DataFrame:
    """Objects with link ends moved by (link_id, from_id, to_id), null where an end stays; derived links are refused."""
    new = moves.select(F.col("link_id").alias("_link"), F.col("from_id").alias("_from"), F.col("to_id").alias("_to"))
    joined = objects.join(new, F.col("object_id") == F.col("_link"), "left")
    moved = F.col("_link").isNotNull()
    refused = F.raise_error(F.concat(F.lit("link cannot be moved: "), F.col("object_id").cast("string"))).cast("long")
    guard = moved & ((F.col("kind") != "LINK") | F.coalesce(F.col("derived"), F.lit(False)))
    end = lambda c: F.when(guard, refused).when(moved, F.coalesce(f"_{c}", f"{c}_id")).otherwise(F.col(f"{c}_id"))
    return joined.withColumns({"from_id": end("from"), "to_id": end("to")}).select(*objects.columns)


def move(contain: DataFrame, placed: DataFrame) -> DataFrame:
    """Containment after (axis, parent_id, child_id) were placed: a child leaves its old parent on that axis."""
    gone = placed.select("axis", "child_id").distinct()
    return contain.join(gone, ["axis", "child_id"], "left_anti").select("axis", "parent_id", "child_id").unionByName(placed.select("axis", "parent_id", "child_id"))


def identity_faults(objects: DataFrame) -> DataFrame:
    """(external_id, n) that are not unique or are blank."""
    own = objects.where(F.col("external_id").isNotNull())
    return own.groupBy("external_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.trim("external_id") == ""))


def port_external_id(node_external_id: Column, kind: Column, name: Column) -> Column:
    """``node<in`` or ``node>out``, where the node has an external id."""
    return F.concat(node_external_id, F.when(kind == "INPUT", "<").otherwise(">"), name)
