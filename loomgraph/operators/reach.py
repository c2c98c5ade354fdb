"""What a change reaches: differences of a view worked out from the ids of a change alone.

A change names the objects that came, went or have other columns, the
properties and the pairs of containment that differ. From the terms of a
selector follows whose membership can depend on these: the ports of a changed
node where the selector reads owners, the links at it where it reads ends,
what lies below it where it reads placement, and the ports of links, which a
view holds with them. Only those objects are selected in either state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import drop, keep
from ..functions.lineage import cut
from ..model import INTRINSIC, Graph
from ..plans import selector as s
from . import placement, views
from .mutations import VALUE, same_value
from .select import matched

PORTS = ("INPUT", "OUTPUT")


@dataclass(frozen=True)
class Change:
    """What two states of a graph differ in; None where a part is as it was."""

    objects: DataFrame | None = None  # (object_id)
    properties: DataFrame | None = None  # (object_id, key)
    contain: DataFrame | None = None  # (axis, parent_id, child_id)

    def ids(self, keys: frozenset[str] | None = None) -> DataFrame | None:
        """Objects that changed themselves; by properties only where one of ``keys`` is among them."""
        parts = [] if self.objects is None else [self.objects.select("object_id")]
        if self.properties is not None:
            own = self.properties if keys is None else self.properties.where(F.col("key").isin(*keys))
            parts.append(own.select("object_id"))
        return reduce(DataFrame.unionAll, parts).distinct() if parts else None


def between(before: Graph, after: Graph) -> Change:
    """The change between two states, of the parts that are not the same frame."""
    objects = properties = contain = None
    if after.objects is not before.objects:
        names = [c for c in after.objects.columns if c != "object_id"]
        plain = lambda g: F.to_json(F.struct(*[F.col(c) for c in names if c in g.objects.columns]))
        old = before.objects.select("object_id", plain(before).alias("_o"))
        new = after.objects.select("object_id", plain(after).alias("_n"))
        objects = cut(old.join(new, "object_id", "full").where(~F.col("_o").eqNullSafe(F.col("_n"))).select("object_id"))
    if after.properties is not before.properties:
        item = lambda g, name: g.properties.select("object_id", "key", F.struct(*VALUE).alias(name))
        empty = lambda g: g.properties is None
        if empty(before) or empty(after):
            properties = cut((after if empty(before) else before).properties.select("object_id", "key"))
        else:
            both = item(before, "o").join(item(after, "n"), ["object_id", "key"], "full")
            properties = cut(both.where(F.col("o").isNull() | F.col("n").isNull() | ~same_value("n", "o")).select("object_id", "key"))
    if after.contain is not before.contain:
        names = ["axis", "parent_id", "child_id"]
        old, new = before.contain.select(*names).distinct(), after.contain.select(*names).distinct()
        contain = cut(old.exceptAll(new).unionAll(new.exceptAll(old)))
    return Change(objects, properties, contain)


def _union(parts: Sequence[DataFrame | None]) -> DataFrame | None:
    own = [p.select("object_id") for p in parts if p is not None]
    return reduce(DataFrame.unionAll, own).distinct() if own else None


def affected(graph: Graph, term: s.Term, change: Change, held: s.Term = s.Everything()) -> DataFrame | None:
    """Objects whose membership a change can turn beyond those that changed themselves; links only where ``held`` holds."""
    if isinstance(term, s.Under):
        moved = [change.objects, None if change.contain is None else change.contain.select(F.col("child_id").alias("object_id"))]
        moved = _union(moved)
        return None if moved is None else placement.under(graph, moved).unionAll(moved)
    if isinstance(term, (s.On, s.Ends)):
        nodes = _union([change.ids(term.inner()[0].keys()), affected(graph, term.inner()[0], change, held)])
        if nodes is None:
            return None
        ports = keep(graph.objects.where(F.col("kind").isin(*PORTS)), nodes, "node_id", distinct=False).select("object_id")
        return ports if isinstance(term, s.On) else _at(_links(graph, held), ports).select("object_id").distinct()
    return _union([affected(graph, t, change, held) for t in term.inner()])


def by_itself(term: s.Term) -> s.Term:
    """What ``term`` asks of an object's own kind and values; it holds wherever ``term`` does, and in both states of what did not change itself."""
    match term:
        case s.And(terms):
            return s.And(tuple(map(by_itself, terms)))
        case s.Or(terms):
            return s.Or(tuple(map(by_itself, terms)))
        case s.Ends() | s.On() | s.Under():
            return s.Or(tuple(s.Kind(k) for k in sorted(term.kinds())))
        case s.Not(inner) if any(isinstance(t, (s.Ends, s.On, s.Under)) for t in inner.walk()):
            return s.Everything()
    return term


def _links(graph: Graph, term: s.Term) -> DataFrame:
    return matched(graph, s.And((s.Kind("LINK"), term)))


def _at(links: DataFrame, ports: DataFrame) -> DataFrame:
    """Rows of links at the ports whose distinct ids are given; one that is at two of them comes twice."""
    return keep(links, ports, "from_id", distinct=False).unionAll(keep(links, ports, "to_id", distinct=False))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("from_id", "to_id")).alias("object_id"))


def _written(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames, written by one job, so that what they read alike is read once."""
    mark = lambda frame, new: frame.withColumn("_new", F.lit(new))
    both = cut(mark(old, False).unionByName(mark(new, True), allowMissingColumns=True))
    return both.where("not _new").select(*old.columns), both.where("_new").select(*new.columns)


def candidates(after: Graph, term: s.Term, change: Change) -> DataFrame:
    """Ids of the objects that changed or whose membership the change can turn; the ports that links carry are left to ``_linked``."""
    pairs = None if change.contain is None else change.contain.select(F.col("child_id").alias("object_id"))
    found = _union([change.ids(), pairs, affected(after, term, change, by_itself(term))])
    return after.spark.createDataFrame([], "object_id long") if found is None else cut(found)


def members_among(before: Graph, after: Graph, selector: str, ids: DataFrame, change: Change) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the distinct ``ids``, and of the ports of links among them that came, went or changed: what the view holds in each state, as rows of objects, and all those ids."""
    term = s.parse(selector)
    if "LINK" not in term.kinds():
        return *(cut(matched(g, selector, ids)) for g in (before, after)), ids
    states = (before, after)
    own = by_itself(term)
    rows = _written(*(keep(_links(g, own), ids, "object_id", distinct=False) for g in states))
    old, new = _written(*(matched(g, term, rows=r) for g, r in zip(states, rows, strict=True)))
    # A link that both states hold alike carries its ports in both.
    turned = _union([drop(old, new, "object_id", distinct=False), drop(new, old, "object_id", distinct=False), *([] if (changed := change.ids()) is None else [changed])])
    ends = [_ends(keep(r, turned, "object_id", distinct=False)) for r in rows]
    ids = cut(_union([ids, *ends]))
    ports = [keep(g.objects.where(F.col("kind").isin(*PORTS)), ids, "object_id", distinct=False) for g in states]
    needed = lambda g: [c for c in ("object_id", "kind", "node_id", "from_id", "to_id", "from_node", "to_node", *(_column(k) for k in term.keys())) if c in g.objects.columns]
    at = _written(*(_at(_links(g, own).select(*dict.fromkeys(needed(g))), p.select("object_id")).distinct() for g, p in zip(states, ports, strict=True)))
    held = [matched(g, term, rows=r) for g, r in zip(states, at, strict=True)]
    out = []
    for g, links, p, h in zip(states, (old, new), ports, held, strict=True):
        rest = term.kinds() - {"LINK"}
        if rest:
            links = links.unionByName(matched(g, s.And((s.Or(tuple(s.Kind(k) for k in sorted(rest))), term)), ids))
        carried = keep(p, _ends(h), "object_id")
        if rest & set(PORTS):
            carried = drop(carried, links.select("object_id"), "object_id", distinct=False)
        out.append(links.unionByName(carried))
    return *_written(*out), ids


def _column(key: str) -> str:
    return INTRINSIC[key][0] if key in INTRINSIC else key


def delta(before: Graph, after: Graph, selector: str, change: Change, keys: Sequence[str] | None = None) -> DataFrame:
    """The records of ``views.delta``, by selecting only what the change reaches."""
    term = s.parse(selector)
    old, new, ids = members_among(before, after, selector, candidates(after, term, change), change)
    names = ["axis", "parent_id", "child_id"]
    if "NODE" not in term.kinds():
        none = after.contain.select(*names).where(F.lit(False))
        return views.difference(before, after, old, new, none, none, new.select("object_id"), keys)
    # Pairs reach beyond: the other end may be a member that the change leaves alone.
    near = lambda g: keep(g.contain.select(*names), ids, "child_id", distinct=False).unionByName(keep(g.contain.select(*names), ids, "parent_id", distinct=False)).distinct()
    p_old, p_new = near(before), near(after)
    ends = p_old.unionByName(p_new).select(F.explode(F.array("parent_id", "child_id")).alias("object_id")).distinct()
    others = cut(drop(ends, ids, "object_id", distinct=False))
    standing = cut(matched(after, s.And((s.Kind("NODE"), term)), others).select("object_id", "kind"))
    nodes = lambda own: own.where("kind = 'NODE'").select("object_id").unionAll(standing.where("kind = 'NODE'").select("object_id"))
    within = lambda pairs, own: keep(keep(pairs, nodes(own), "parent_id", distinct=False), nodes(own), "child_id", distinct=False)
    return views.difference(before, after, old, new, within(p_old, old), within(p_new, new), nodes(new), keys)
