"""Groupings: objects that a selector holds, grouped by key paths into nodes of their own.

A key path is ``key``, ``$from.key``, ``$to.key``, ``$node.key``,
``parent(axis)`` or ``parent(axis).key``: one hop at most.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.values import Cell, canonical
from ..model import INTRINSIC, Graph
from .derived import GROUPED
from .folds import folded
from .select import matched

HOP = re.compile(r"(?:(\$from|\$to|\$node)\.|parent\(([^)]+)\)\.?)?(.*)")


class KeyPath:
    def __init__(self, text: str) -> None:
        port, axis, key = HOP.fullmatch(text).groups()
        self.text, self.axis, self.key = text, axis, key or None
        self.end = {"$from": "from_id", "$to": "to_id", "$node": "node_id"}.get(port)
        if self.key is None and axis is None:
            raise ValueError(f"a key path names a key: {text!r}")
        if self.key and re.match(r"(\$from|\$to|\$node)\.|parent\(", self.key):
            raise ValueError(f"a key path has one hop at most: {text!r}")


def with_paths(graph: Graph, members: DataFrame, paths: Sequence[str]) -> tuple[DataFrame, dict[str, Cell]]:
    """``members`` joined with what the paths lead to, and a cell for each path."""
    cells: dict[str, Cell] = {}
    parsed = [KeyPath(p) for p in paths]
    frame = graph.widened(members, {p.key for p in parsed if p.end is None and p.axis is None})
    for i, p in enumerate(parsed):
        if p.end is None and p.axis is None:
            cells[p.text] = graph.cell(p.key)
            continue
        if p.axis is not None:
            up = graph.contain.where(F.col("axis") == p.axis).select(F.col("child_id").alias(f"_child{i}"), F.col("parent_id").alias(f"_parent{i}"))
            frame = frame.join(up, F.col("object_id") == F.col(f"_child{i}"), "left").drop(f"_child{i}")
            if p.key is None:
                cells[p.text] = Cell(long=F.col(f"_parent{i}"))
                continue
            at = f"_parent{i}"
        else:
            at = p.end
        cell = graph.cell(p.key)
        own = graph.widened(graph.objects, {p.key}).select(
            F.col("object_id").alias(f"_hop{i}"),
            *[c.alias(f"_value{i}_{t}") for t, c in (("long", cell.long), ("double", cell.double), ("boolean", cell.boolean), ("text", cell.text)) if c is not None],
        )
        kinds = [t for t, c in (("long", cell.long), ("double", cell.double), ("boolean", cell.boolean), ("text", cell.text)) if c is not None]
        frame = frame.join(own, F.col(at) == F.col(f"_hop{i}"), "left").drop(f"_hop{i}")
        cells[p.text] = Cell(**{t: F.col(f"_value{i}_{t}") for t in kinds})
    return frame, cells


def group_by(graph: Graph, selector: str, by: Sequence[str], over: Sequence[tuple[str, str, str]] = (), parts: bool = False) -> DataFrame:
    """Groups of the members: ``name`` (the canonical key), one column per key path, members, and folds.

    ``over`` lists (column, fold, path): ``column_l``, ``column_d``,
    ``column_known`` and ``column_total`` fold the path over the members. A
    member without a value for a key path is in no group. Group nodes are
    never members. With ``parts`` the typed values of the key are kept as
    structs ``part0``, ``part1``, ..
    """
    members = matched(graph, selector).where(~(F.col("kind") == "NODE") | ~F.coalesce(F.col("derived"), F.lit(False)))
    frame, cells = with_paths(graph, members, [*by, *[p for _, _, p in over]])
    keys = [canonical(cells[p]).alias(f"_key{i}") for i, p in enumerate(by)]
    values: list[Column] = []
    for name, _, p in over:
        cell = cells[p]
        values.append((cell.long if cell.long is not None else F.lit(None)).cast("long").alias(f"_l_{name}"))
        values.append((cell.double if cell.double is not None else F.lit(None)).cast("double").alias(f"_d_{name}"))
    typed = [F.struct(*[(F.lit(None) if c is None else c).cast(t).alias(n) for n, t, c in _typed(cells[p])]).alias(f"part{i}") for i, p in enumerate(by)] if parts else []
    rows = frame.select("object_id", *keys, *values, *typed)
    for i in range(len(by)):
        rows = rows.where(F.col(f"_key{i}").isNotNull())
    # The canonical key tells the typed value, so any member's will do.
    aggregates = [F.count(F.lit(1)).alias("members"), *[F.first(f"part{i}").alias(f"part{i}") for i in range(len(typed))]]
    for name, fold, _ in over:
        parts = folded(fold, F.col(f"_l_{name}"), F.col(f"_d_{name}"))
        aggregates += [c.alias(f"{name}_{part}") for c, part in zip(parts, ("l", "d", "known", "total"), strict=True)]
    grouped = rows.groupBy(*[f"_key{i}" for i in range(len(by))]).agg(*aggregates)
    name = F.concat_ws(",", *[f"_key{i}" for i in range(len(by))]).alias("name")
    return grouped.select(name, *[F.col(f"_key{i}").alias(f"key{i}") for i in range(len(by))], *[c for c in grouped.columns if not c.startswith("_key")])


def member_keys(graph: Graph, selector: str, by: Sequence[str], among: DataFrame | None = None) -> DataFrame:
    """(object_id, name): the group of each member, among the ids of ``among`` where they are given."""
    members = matched(graph, selector, among).where(~(F.col("kind") == "NODE") | ~F.coalesce(F.col("derived"), F.lit(False)))
    frame, cells = with_paths(graph, members, by)
    keys = [canonical(cells[p]) for p in by]
    there = [k.isNotNull() for k in keys]
    rows = frame.select("object_id", F.concat_ws(",", *keys).alias("name"), F.array(*there).alias("_there"))
    return rows.where(F.forall("_there", lambda x: x)).drop("_there")


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, members): signed counts of members (object_id, name) that left a group and that came to one."""
    old, new = before.select("object_id", F.col("name").alias("_old")), after.select("object_id", F.col("name").alias("_new"))
    both = old.join(new, "object_id", "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    signed = both.select(F.explode(F.array(F.struct(F.col("_old").alias("name"), F.lit(-1).alias("n")), F.struct(F.col("_new").alias("name"), F.lit(1).alias("n")))).alias("_m")).select("_m.*")
    return signed.where("name is not null").groupBy("name").agg(F.sum("n").alias("members")).where("members <> 0")


def moved(counts: DataFrame, moves: DataFrame) -> DataFrame:
    """(name, members, state) of the groups that moves change, over their counts (name, members) before: MADE with the first member, REMOVED with the last, or CHANGED."""
    old = counts.select("name", F.col("members").alias("_had"))
    joined = moves.join(old, "name", "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
    now = F.col("_had") + F.col("members")
    state = F.when(F.col("_had") == 0, "MADE").when(now == 0, "REMOVED").otherwise("CHANGED")
    return joined.select("name", now.alias("members"), state.alias("state"))


def _typed(cell: Cell):
    return [("l", "long", cell.long), ("d", "double", cell.double), ("b", "boolean", cell.boolean), ("t", "string", cell.text)]


def group_nodes(groups: DataFrame, grouping: str, type: str) -> DataFrame:
    """(name, type, external_id) of the node of each group."""
    if ":" in grouping:
        raise ValueError("a grouping's name has no ':'")
    return groups.select("name", F.lit(type).alias("type"), F.concat(F.lit(f"{grouping}:"), "name").alias("external_id"))


def as_nodes(graph: Graph, grouping: str, type: str, selector: str, by: Sequence[str], over: Sequence[tuple[str, str, str]] = ()) -> Graph:
    """The graph with a node for each group, which selectors and views hold like any other.

    The parts of the key are properties under the text of their paths (but for
    intrinsic keys, which a node answers from its own), folds under their name
    with ``.known`` and ``.total``. Nodes of groups are ``derived``; their ids
    follow from the external id alone, so that a group keeps its id.
    """
    if ":" in grouping:
        raise ValueError("a grouping's name has no ':'")
    for name, _, _ in over:
        if name in graph.bound or name in INTRINSIC:
            raise ValueError(f"{name!r} is a column of the objects")
    external = F.concat(F.lit(f"{grouping}:"), "name")
    made = F.shiftrightunsigned(F.xxhash64(external), 3).bitwiseOR(F.lit(1 << 61)).alias("object_id")
    found = cut(group_by(graph, selector, by, over, parts=True).select(made, external.alias("external_id"), "*"))
    column = {"LONG": "l", "DOUBLE": "d", "BOOLEAN": "b", "TEXT": "t"}
    bound = [F.col(f"part{i}.{column[graph.bound[p]]}").alias(p) for i, p in enumerate(by) if p in graph.bound]
    nodes = found.select("object_id", F.lit("NODE").alias("kind"), "name", F.lit(type).alias("type"), "external_id", F.lit(True).alias("derived"), *bound)
    null = {"l": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "b": F.lit(None).cast("boolean"), "t": F.lit(None).cast("string")}
    item = lambda key, **given: F.struct(F.lit(key).alias("key"), *[given.get(c, null[c]).alias(c) for c in null])
    items = [item(p, **{c: F.col(f"part{i}.{c}") for c in null}) for i, p in enumerate(by) if p not in graph.bound and p not in INTRINSIC]
    for name, _, _ in over:
        items += [item(name, l=F.col(f"{name}_l"), d=F.col(f"{name}_d")), item(f"{name}.known", l=F.col(f"{name}_known")), item(f"{name}.total", l=F.col(f"{name}_total"))]
    objects = graph.objects.unionByName(nodes, allowMissingColumns=True)
    if not items:
        return graph.with_(objects=objects)
    kind = F.when(F.col("l").isNotNull(), "LONG").when(F.col("d").isNotNull(), "DOUBLE").when(F.col("b").isNotNull(), "BOOLEAN").when(F.col("t").isNotNull(), "TEXT").alias("vtype")
    rows = found.select("object_id", F.explode(F.array(*items)).alias("_v")).select("object_id", "_v.*")
    rows = rows.select("object_id", "key", kind, "l", "d", "b", "t", F.lit(GROUPED).alias("source_id")).where("vtype is not null")
    return graph.with_(objects=objects, properties=rows if graph.properties is None else graph.properties.unionByName(rows))
