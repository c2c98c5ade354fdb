"""Selectors over a graph: terms to columns and joins.

Kinds and keys that the terms cannot need are pruned before anything is
joined. Conditions on other objects (placement, link ends, owners of ports)
are joined as sets of ids with a mark, so that a term stays one column under
``&``, ``,`` and ``!``; Catalyst turns the outer joins of terms that must hold
into inner ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import keep
from ..functions.lineage import cut
from ..functions.values import Cell, any_of, matches, sure
from ..model import Graph
from ..plans import selector as s
from .placement import ancestors, below, climbed


def _addresses(compare: s.Compare) -> Column:
    """A port is compared one address at a time."""
    each = lambda op: F.coalesce(F.exists("address", lambda a: matches(Cell(text=a), op, compare.literal)), F.lit(False))
    there = F.coalesce(F.size("address") > 0, F.lit(False))
    if compare.op is None:
        return there
    return there & ~each("=") if compare.op == "!=" else each(compare.op)


class _Plan:
    def __init__(self, graph: Graph, frame: DataFrame, few: DataFrame | None = None) -> None:
        # Of few objects, by their ids, only what they hang on is looked at.
        self.graph, self.frame, self.marks, self.few = graph, frame, 0, few

    def mark(self, ids: DataFrame, key: str) -> Column:
        """Whether ``key`` of a row is one of the distinct ids in the column ``id``."""
        self.marks += 1
        name = f"_mark{self.marks}"
        found = ids.select(F.col("id").alias(f"{name}_id"), F.lit(True).alias(name))
        self.frame = self.frame.join(found, F.col(key) == F.col(f"{name}_id"), "left").drop(f"{name}_id")
        return F.coalesce(F.col(name), F.lit(False))

    def column(self, term: s.Term) -> Column:
        match term:
            case s.Everything():
                return F.lit(True)
            case s.Kind(kind):
                return F.col("kind") == kind
            case s.Compare(key="$address"):
                return _addresses(term)
            case s.Compare(key, op, literal):
                return matches(self.graph.cell(key), op, literal)
            case s.And(terms):
                out = F.lit(True)
                for t in terms:
                    out = out & self.column(t)
                return out
            case s.Or(terms):
                return any_of([self.column(t) for t in terms])
            case s.Not(inner):
                return ~sure(self.column(inner))
            case s.Under(axis, path):
                chains = ancestors(self.graph, axis) if self.few is None else climbed(self.graph, axis, self.few)
                found = chains.where(below(F.col("chain"), path)).select(F.col("object_id").alias("id")).distinct()
                return self.mark(found, "object_id")
            case s.On(inner):
                return F.col("kind").isin("INPUT", "OUTPUT") & self.mark(self.nodes(inner, "node_id"), "node_id")
            case s.Ends(both, inner):
                self.with_ends()
                ids = self.nodes(inner, "from_node", "to_node")
                a, b = self.mark(ids, "from_node"), self.mark(ids, "to_node")
                return (F.col("kind") == "LINK") & (a & b if both else a | b)
        raise TypeError(term)

    def nodes(self, inner: s.Term, *at: str) -> DataFrame:
        """Ids of the nodes that the inner term holds; those in the columns ``at`` alone, where rows are few."""
        among = None
        if self.few is not None:
            among = cut(self.frame.select(F.explode(F.array(*at)).alias("object_id")).where("object_id is not null").distinct())
        return matched(self.graph, s.And((s.Kind("NODE"), inner)), among).select(F.col("object_id").alias("id"))

    def with_ends(self) -> None:
        if "from_node" in self.frame.columns:
            return
        ports = self.graph.objects.where(F.col("kind").isin("INPUT", "OUTPUT")).select(F.col("object_id").alias("_port"), F.col("node_id").alias("_owner"))
        for end in ("from", "to"):
            side = ports.select(F.col("_port").alias(f"_{end}"), F.col("_owner").alias(f"{end}_node"))
            self.frame = self.frame.join(side, F.col(f"{end}_id") == F.col(f"_{end}"), "left").drop(f"_{end}")


def matched(graph: Graph, selector: str | s.Term, among: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Rows of ``objects`` that the selector holds, of those whose distinct ids are in ``among`` if that is given.

    ``rows`` are few rows of ``objects`` at hand, with the columns that the
    selector reads of them, to be looked at in place of all.
    """
    term = s.parse(selector) if isinstance(selector, str) else selector
    kinds = term.kinds()
    frame = graph.objects if rows is None else rows
    if kinds != s.KINDS:
        frame = frame.where(F.col("kind").isin(*sorted(kinds))) if kinds else frame.where(F.lit(False))
    if among is not None:
        frame = keep(frame, among, "object_id", distinct=False)
    # Terms inside sets of ids are read by their own plans.
    own = _own_keys(term)
    few = rows if among is None else among
    plan = _Plan(graph, graph.widened(frame, own), None if few is None else few.select("object_id"))
    column = plan.column(term)
    return plan.frame.where(column).select(*(graph.objects if rows is None else rows).columns)


def _own_keys(term: s.Term) -> set[str]:
    if isinstance(term, (s.Ends, s.On)):
        return set()
    return set(term.keys() if isinstance(term, s.Compare) else ()) | set().union(*(_own_keys(t) for t in term.inner()), set())


def matched_ids(graph: Graph, selector: str) -> DataFrame:
    return matched(graph, selector).select("object_id")
