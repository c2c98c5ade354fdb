"""What writes may not ask for: each check gives the offending rows, and none where all is well.

The objects are those after the writes. Checks join the written rows with the
few columns that they need, so their cost follows the writes and one pass over
ids and kinds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derived import DERIVED, GROUPED


def _kinds(objects: DataFrame, name: str) -> DataFrame:
    return objects.select(F.col("object_id").alias(f"_{name}"), F.col("kind").alias(f"{name}_kind"))


def _told(frame: DataFrame, fault: str, *columns: str) -> DataFrame:
    return frame.select(F.lit(fault).alias("fault"), "object_id", *columns)


def _ends(rows: DataFrame, objects: DataFrame, *ends) -> DataFrame:
    """A row for each end (name, id, wanted kind) of each of the ``rows``, with the kind of what is there."""
    each = F.array(*[F.struct(F.lit(name).alias("name"), id_.alias("id"), F.lit(kind).alias("want")) for name, id_, kind in ends])
    told = rows.withColumn("_e", F.explode(each)).select(*rows.columns, "_e.*")
    return told.join(_kinds(objects, "end"), F.col("id") == F.col("_end"), "left")


def link_faults(links: DataFrame, objects: DataFrame) -> DataFrame:
    """(fault, object_id) of links (object_id, from_id, to_id) that do not lead from an output to an input."""
    ends = _ends(links.select("object_id", "from_id", "to_id"), objects, ("from", F.col("from_id"), "OUTPUT"), ("to", F.col("to_id"), "INPUT"))
    kind = F.col("end_kind")
    fault = F.when(kind.isNull(), F.concat("name", F.lit(" nothing"))).when(kind != F.col("want"), F.concat("name", F.lit(" no "), F.lower("want")))
    return ends.select(fault.alias("fault"), "object_id").where("fault is not null")


def port_faults(ports: DataFrame, objects: DataFrame) -> DataFrame:
    """(fault, object_id) of ports (object_id, node_id) that are not on a node."""
    joined = ports.join(_kinds(objects, "node"), F.col("node_id") == F.col("_node"), "left")
    return _told(joined.where("node_kind is null or node_kind <> 'NODE'"), "on no node")


def placement_faults(placed: DataFrame, objects: DataFrame) -> DataFrame:
    """(fault, object_id) of pairs (parent_id, child_id) that are not of nodes, or of one node with itself; ``object_id`` is the offending end."""
    pairs = placed.select("parent_id", "child_id").distinct()
    ends = _ends(pairs, objects, ("parent", F.col("parent_id"), "NODE"), ("child", F.col("child_id"), "NODE"))
    kind = F.col("end_kind")
    there = F.when(kind.isNull(), F.concat("name", F.lit(" is nothing"))).when(kind != "NODE", F.concat("name", F.lit(" is no node")))
    itself = F.when((F.col("name") == "child") & (F.col("parent_id") == F.col("child_id")), F.lit("in itself"))
    return ends.select(F.explode(F.array_compact(F.array(there, itself))).alias("fault"), F.col("id").alias("object_id")).distinct()


def write_faults(writes: DataFrame, objects: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """(fault, object_id, key) of writes to nothing, to reserved or blank keys, and to what the graph itself derives."""
    own = writes.select("object_id", "key").distinct()
    joined = own.join(_kinds(objects, "object"), F.col("object_id") == F.col("_object"), "left")
    unknown = F.when(F.col("object_kind").isNull(), F.lit("no such object"))
    reserved = F.when(F.expr("key is null or startswith(key, '$') or trim(key) = ''"), F.lit("reserved key"))
    out = joined.select(F.explode(F.array_compact(F.array(unknown, reserved))).alias("fault"), "object_id", "key")
    if properties is None:
        return out
    kept = properties.where(F.col("source_id").isin(DERIVED, GROUPED)).select("object_id", "key", "source_id")
    met = own.join(kept, ["object_id", "key"])
    return out.unionAll(met.select(F.when(F.col("source_id") == DERIVED, "derived").otherwise("of a group").alias("fault"), "object_id", "key"))


def removal_faults(removed: DataFrame, objects: DataFrame) -> DataFrame:
    """(fault, object_id) of ids to be removed that the graph itself made: derived links and nodes of groups."""
    made = objects.where("coalesce(derived, false)").select("object_id", "kind")
    met = removed.select("object_id").distinct().join(made, "object_id")
    return met.where("kind in ('LINK', 'NODE')").select(F.when(F.col("kind") == "LINK", "derived link").otherwise("group").alias("fault"), "object_id")


def name_faults(objects: DataFrame, groupings: Sequence[str]) -> DataFrame:
    """(fault, object_id) of written objects whose external ids lie under the name of a grouping."""
    written = objects.where("not coalesce(derived, false)")
    under = reduce(lambda a, b: a | b, [F.col("external_id").startswith(f"{g}:") for g in groupings], F.lit(False))
    return _told(written.where(F.coalesce(under, F.lit(False))), "name of a grouping")
