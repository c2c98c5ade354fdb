"""Views: what a selector holds, as ordered records of snapshots and of differences.

Records have one order that keeps "both ends are stated before a pair": within
a batch ADDED, UNCONTAINED, CONTAINED, REMOVED, then PROPERTY_CHANGED, each by
id and key. ``ord`` is that rank with the id; it is not a global row number, so
no task has to see all records. ``kind`` is the object's, null at pairs and at
properties that do not come from its own row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.joins import drop, keep
from ..model import FIELD, INTRINSIC, Graph
from ..plans.selector import parse
from .mutations import VALUE, same_value
from .select import matched

RANK = {"ADDED": 0, "UNCONTAINED": 1, "CONTAINED": 2, "REMOVED": 3, "PROPERTY_CHANGED": 4}
RECORD = ("change", "rank", "object_id", "kind", "parent_id", "key", *VALUE)


def members(graph: Graph, selector: str) -> DataFrame:
    """Objects of a view: those that the selector holds and the ports of the links among them."""
    own = matched(graph, selector)
    term = parse(selector)
    if "LINK" not in term.kinds():
        return own
    links = own.where(F.col("kind") == "LINK")
    ends = links.select(F.col("from_id").alias("object_id")).union(links.select(F.col("to_id").alias("object_id"))).distinct()
    ports = keep(graph.objects.where(F.col("kind").isin("INPUT", "OUTPUT")), ends, "object_id", distinct=False)
    if term.kinds() & {"INPUT", "OUTPUT"}:
        ports = drop(ports, own.where(F.col("kind").isin("INPUT", "OUTPUT")).select("object_id"), "object_id", distinct=False)
    return own.unionByName(ports)


def entries(graph: Graph, objects: DataFrame, keys: Sequence[str] | None = None, kinds: bool = False) -> DataFrame:
    """(object_id, key, vtype, l, d, b, t) of every value; ``keys`` limits all but intrinsic ones.

    With ``kinds``, also the ``kind`` of the object, but for loose properties.
    """
    items = []
    names = [*INTRINSIC, *[k for k in graph.bound if not keys or k in keys]]
    for name in names:
        kind = "TEXT" if name in ("$address", "$domain") else INTRINSIC[name][1] if name in INTRINSIC else graph.bound[name]
        cell = graph.cell(name)
        column = cell.parts()[0]
        typed = {t: column if FIELD[kind] == t else None for t in ("long", "double", "boolean", "text")}
        value = lambda t, sql: (F.lit(None) if typed[t] is None else typed[t]).cast(sql)  # noqa: B023, E731
        items.append(
            F.when(column.isNotNull(), F.struct(F.lit(name).alias("key"), F.lit(kind).alias("vtype"), value("long", "long").alias("l"), value("double", "double").alias("d"), value("boolean", "boolean").alias("b"), value("text", "string").alias("t")))
        )
    wide = objects.select("object_id", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("_e"), *(["kind"] if kinds else [])).select("object_id", "_e.*", *(["kind"] if kinds else []))
    if graph.properties is None:
        return wide
    loose = graph.properties if not keys else graph.properties.where(F.col("key").isin(*keys))
    return wide.unionByName(keep(loose.select("object_id", "key", *VALUE), objects.select("object_id"), "object_id", distinct=False), allowMissingColumns=kinds)


def _record(frame: DataFrame, change: str, **given) -> DataFrame:
    types = {"kind": "string", "parent_id": "long", "key": "string", "vtype": "string", "l": "long", "d": "double", "b": "boolean", "t": "string"}
    column = lambda c: given[c] if c in given else F.col(c) if c in frame.columns else F.lit(None)
    return frame.select(
        F.lit(change).alias("change"), F.lit(RANK[change]).alias("rank"), F.col("object_id"), *[column(c).cast(t).alias(c) for c, t in types.items()]
    )


def pairs(graph: Graph, objects: DataFrame) -> DataFrame:
    """(axis, parent_id, child_id) with both ends in the view."""
    ids = objects.where(F.col("kind") == "NODE").select("object_id")
    return keep(keep(graph.contain, ids, "parent_id", distinct=False), ids, "child_id", distinct=False)


def snapshot(graph: Graph, selector: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Records that build the view from nothing."""
    own = members(graph, selector)
    out = _record(own, "ADDED")
    out = out.unionByName(_record(entries(graph, own, keys, kinds=True), "PROPERTY_CHANGED"))
    return out.unionByName(_record(pairs(graph, own).select(F.col("child_id").alias("object_id"), "parent_id"), "CONTAINED"))


def delta(before: Graph, after: Graph, selector: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Records that lead from the view of one graph to that of the next."""
    old, new = cut(members(before, selector)), cut(members(after, selector))
    return difference(before, after, old, new, pairs(before, old), pairs(after, new), new.select("object_id"), keys)


def difference(before: Graph, after: Graph, old: DataFrame, new: DataFrame, pairs_old: DataFrame, pairs_new: DataFrame, staying: DataFrame, keys: Sequence[str] | None) -> DataFrame:
    """Records that lead from members and pairs to others; ``staying`` are the ids that the new state holds."""
    ids_old, ids_new = old.select("object_id"), new.select("object_id")
    added = drop(new, ids_old, "object_id", distinct=False)
    removed = drop(old, ids_new, "object_id", distinct=False)
    e_old = keep(entries(before, old, keys).select("object_id", "key", F.struct(*VALUE).alias("o")), ids_new, "object_id", distinct=False)
    e_new = entries(after, new, keys, kinds=True).select("object_id", "key", "kind", F.struct(*VALUE).alias("n"))
    both = e_new.join(e_old, ["object_id", "key"], "full")
    differs = F.col("o").isNull() | F.col("n").isNull() | ~same_value("n", "o")
    changed = both.where(differs).select("object_id", "key", "kind", *[F.col(f"n.{c}").alias(c) for c in VALUE])
    names = ["axis", "parent_id", "child_id"]
    p_old, p_new = pairs_old.select(*names), pairs_new.select(*names)
    both_pairs = p_new.withColumn("_new", F.lit(True)).join(p_old.withColumn("_old", F.lit(True)), names, "full")
    came = both_pairs.where("_old is null").select(*names)
    # A pair ends by itself only while both ends stay; one that leaves says so alone.
    went = both_pairs.where("_new is null").select(*names)
    went = keep(keep(went, staying, "parent_id", distinct=False), staying, "child_id", distinct=False)
    out = _record(added, "ADDED").unionByName(_record(removed, "REMOVED")).unionByName(_record(changed, "PROPERTY_CHANGED"))
    for frame, change in ((came, "CONTAINED"), (went, "UNCONTAINED")):
        out = out.unionByName(_record(frame.select(F.col("child_id").alias("object_id"), "parent_id"), change))
    return out


def touched(graph: Graph, object_id: int) -> DataFrame:
    """Records that state all properties of one object again."""
    return stated(graph, graph.one(object_id))


def stated(graph: Graph, objects: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Records that state the properties of objects."""
    return _record(entries(graph, objects, keys, kinds=True), "PROPERTY_CHANGED")


def replica(records: DataFrame) -> DataFrame:
    """(object_id, key, vtype, l, d, b, t) that a client holds after records with a ``seq``."""
    last = records.where("change = 'PROPERTY_CHANGED'").groupBy("object_id", "key").agg(F.max_by(F.struct(*VALUE, "seq"), "seq").alias("v"))
    state = records.where("change in ('ADDED', 'REMOVED')").groupBy("object_id").agg(F.max_by("change", F.struct("seq", F.when(F.col("change") == "ADDED", 1).otherwise(0))).alias("_state"), F.max(F.when(F.col("change") == "ADDED", F.col("seq"))).alias("_since"))
    return last.join(state.where("_state = 'ADDED'"), "object_id").where("v.vtype is not null and v.seq >= _since").select("object_id", "key", *[f"v.{c}" for c in VALUE])


def snapshot_object(graph: Graph, object_id: int) -> DataFrame:
    """One row with a map of all properties of an object, as text."""
    own = entries(graph, graph.one(object_id))
    text = F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"), F.col("t"))
    return own.groupBy("object_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", text.alias("value"))))).alias("properties"))


def query(graph: Graph, selector: str) -> DataFrame:
    """(object_id, key, vtype, l, d, b, t) of every object that the selector holds."""
    return entries(graph, matched(graph, selector))
