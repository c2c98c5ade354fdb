"""Containment: ancestors, paths and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import drop, keep
from ..functions.lineage import cut
from ..model import Graph
from ..plans.path import SPECIAL, Path, Segment

MOST_LEVELS = 200
MOST_DOUBLINGS = 16


def ancestors(graph: Graph, axis: str) -> DataFrame:
    """(object_id, chain): the chain of ancestors of each placed object, root first.

    Where the graph knows the levels of the axis, they are joined one by one
    from the roots down, and only their edges and holders are read; otherwise
    chains are doubled, written once a round.
    """
    known = graph.levels.get(axis)
    holders = graph.holders.get(axis, graph.nodes())
    named = holders.select(F.col("object_id").alias("_id"), F.struct(F.col("object_id").alias("id"), "name", "type").alias("_step"))
    stepped = lambda edges: edges.select("parent_id", "child_id").join(named, F.col("parent_id") == F.col("_id")).select("parent_id", "child_id", "_step")
    root = lambda steps: steps.select(F.col("child_id").alias("object_id"), F.array("_step").alias("chain"))

    def next_level(steps: DataFrame, level: DataFrame) -> DataFrame:
        above = level.select(F.col("object_id").alias("_up"), F.col("chain").alias("_chain"))
        return steps.join(above, F.col("parent_id") == F.col("_up")).select(F.col("child_id").alias("object_id"), F.concat("_chain", F.array("_step")).alias("chain"))

    if known is not None:
        level = out = root(stepped(known[0]))
        for edges in known[1:]:
            level = next_level(stepped(edges), level)
            out = out.union(level)
        return out
    # Each round doubles how far up a chain leads: a chain of n levels takes log n of them.
    rows = cut(stepped(graph.contain.where(F.col("axis") == axis)).select(F.col("child_id").alias("object_id"), F.col("parent_id").alias("top"), F.array("_step").alias("chain")))
    for _ in range(MOST_DOUBLINGS):
        above = rows.select(F.col("object_id").alias("_up"), F.col("top").alias("_top"), F.col("chain").alias("_chain"))
        further = rows.join(above, F.col("top") == F.col("_up"), "left")
        rows = cut(further.select("object_id", F.coalesce("_top", "top").alias("top"), F.when(F.col("_up").isNull(), F.col("chain")).otherwise(F.concat("_chain", "chain")).alias("chain"), F.col("_up").isNotNull().alias("_moved")))
        if rows.where("_moved").isEmpty():
            return rows.select("object_id", "chain")
        rows = rows.drop("_moved")
    raise ValueError(f"more than {1 << MOST_DOUBLINGS} levels on {axis}, or a cycle")


def climbed(graph: Graph, axis: str, ids: DataFrame) -> DataFrame:
    """``ancestors`` of the objects in ``ids`` alone, followed upwards from them."""
    edges = graph.contain.where(F.col("axis") == axis).select(F.col("child_id").alias("_c"), F.col("parent_id").alias("_p"))
    holders = graph.holders.get(axis, graph.nodes())
    named = holders.select(F.col("object_id").alias("_id"), F.struct(F.col("object_id").alias("id"), "name", "type").alias("_step"))
    at = ids.select("object_id", F.col("object_id").alias("at"), F.expr("cast(array() as array<struct<id: bigint, name: string, type: string>>)").alias("chain"))
    levels = graph.levels.get(axis)
    out = None
    for n in range(MOST_LEVELS):
        at = keep(edges, at.select("at"), "_c").join(at, F.col("_c") == F.col("at"))
        at = at.join(named, F.col("_p") == F.col("_id")).select("object_id", F.col("_p").alias("at"), F.concat(F.array("_step"), "chain").alias("chain"))
        # A chain is whole where nothing is above; shorter ones give way to it.
        if levels is None:
            at = cut(at)
            if at.isEmpty():
                break
        out = at if out is None else out.unionAll(at)
        if levels is not None and n + 1 >= len(levels):
            break
    else:
        raise ValueError(f"more than {MOST_LEVELS} levels on {axis}, or a cycle")
    if out is None:
        return at.select("object_id", "chain")
    return out.groupBy("object_id").agg(F.max_by("chain", F.size("chain")).alias("chain"))


def under(graph: Graph, ids: DataFrame) -> DataFrame:
    """(object_id): what lies anywhere below the objects in ``ids``, on any axes."""
    edges = graph.contain.select("parent_id", F.col("child_id").alias("_below"))
    seen = at = cut(ids.select("object_id").distinct())
    while True:
        found = keep(edges, at, "parent_id", distinct=False).select(F.col("_below").alias("object_id")).distinct()
        at = cut(drop(found, seen, "object_id", distinct=False))
        if at.isEmpty():
            return drop(seen, ids, "object_id")
        seen = cut(seen.unionAll(at))


def fits(step: Column, segment: Segment) -> Column:
    if segment.id is not None:
        return step["id"] == segment.id
    found = F.lit(True)
    if segment.type is not None:
        found = found & (step["type"] == segment.type)
    if segment.name is not None:
        found = found & (step["name"] == segment.name)
    return found


def below(chain: Column, path: Path) -> Column:
    """Whether the chain of ancestors begins with what the path names."""
    found = F.size(chain) >= len(path)
    for i, segment in enumerate(path.segments):
        found = found & fits(F.get(chain, F.lit(i)), segment)
    return F.coalesce(found, F.lit(False))


def _written(name: Column) -> Column:
    return F.regexp_replace(name, "([" + "".join("\\" + c for c in SPECIAL) + "])", r"\\$1")


def path_text(chain: Column) -> Column:
    """``/type:name`` of each step, ``#id`` where a step has no name."""

    def step(s: Column) -> Column:
        own = F.concat(_written(s["type"]), F.lit(":"), _written(s["name"]))
        return F.when(s["name"].isNull() | (s["name"] == ""), F.concat(F.lit("#"), s["id"].cast("string"))).otherwise(own)

    return F.concat(F.lit("/"), F.array_join(F.transform(chain, step), "/"))


def _roots(graph: Graph, axis: str) -> DataFrame:
    """(object_id) of what holds on the axis and is held by nothing; where the levels are known, what the first edges start from."""
    known = graph.levels.get(axis)
    if known:
        return known[0].select(F.col("parent_id").alias("object_id")).distinct()
    own = graph.contain.where(F.col("axis") == axis)
    return drop(own.select(F.col("parent_id").alias("object_id")).distinct(), own.select("child_id"), "object_id", distinct=False)


def path_of(graph: Graph, axis: str) -> DataFrame:
    """(object_id, path) of every node on the axis, roots included."""
    nodes = graph.nodes().select("object_id", F.struct(F.col("object_id").alias("id"), "name", "type").alias("_self"))
    chains = ancestors(graph, axis)
    under = nodes.join(chains, "object_id").select("object_id", path_text(F.concat("chain", F.array("_self"))).alias("path"))
    roots = _roots(graph, axis)
    return under.union(nodes.join(roots, "object_id").select("object_id", path_text(F.array("_self")).alias("path")))


def resolve(graph: Graph, axis: str, path: Path) -> DataFrame:
    """(object_id) the path leads to: empty if nothing, an error if a segment names two."""
    own = graph.contain.where(F.col("axis") == axis).select("parent_id", "child_id")
    named = graph.nodes().select("object_id", F.struct(F.col("object_id").alias("id"), "name", "type").alias("_step"))
    at = _roots(graph, axis).join(graph.holders.get(axis, graph.nodes()).select("object_id", F.struct(F.col("object_id").alias("id"), "name", "type").alias("_step")), "object_id")
    if not len(path):
        return named.where(F.lit(False)).select("object_id")
    for i, segment in enumerate(path.segments):
        if i:
            at = at.select(F.col("object_id").alias("_up")).join(own, F.col("_up") == F.col("parent_id")).select(F.col("child_id").alias("object_id")).join(named, "object_id")
        at = at.where(fits(F.col("_step"), segment))
        found = at.groupBy().agg(F.count(F.lit(1)).alias("_n"), F.min("object_id").alias("object_id"), F.max("object_id").alias("_other"))
        two = F.concat(F.lit(f"{segment} of {path} names both "), F.col("object_id").cast("string"), F.lit(" and "), F.col("_other").cast("string"))
        checked = F.when(F.col("_n") > 1, F.raise_error(two).cast("long")).otherwise(F.col("object_id"))
        at = found.select(checked.alias("object_id")).where("object_id is not null")
    return at


def children(graph: Graph, object_id: int) -> DataFrame:
    return graph.contain.where(F.col("parent_id") == object_id).select("axis", F.col("child_id").alias("object_id"))


def parents(graph: Graph, object_id: int) -> DataFrame:
    return graph.contain.where(F.col("child_id") == object_id).select("axis", F.col("parent_id").alias("object_id"))


def faults(graph: Graph) -> DataFrame:
    """(fault, object_id): second parents on an axis, holders on two axes, and cycles over any axes."""
    twice = graph.contain.distinct().groupBy("axis", "child_id").count().where("count > 1").select(F.lit("two parents").alias("fault"), F.col("child_id").alias("object_id"))
    axes = graph.contain.select("axis", "parent_id").distinct().groupBy("parent_id").count().where("count > 1").select(F.lit("two axes").alias("fault"), F.col("parent_id").alias("object_id"))
    return twice.union(axes).union(cycles(graph.contain).select(F.lit("cycle").alias("fault"), "object_id"))


def cycles(contain: DataFrame) -> DataFrame:
    """Objects on or between cycles: leaves and roots are taken off until none is left to take."""
    edges = contain.select("parent_id", "child_id").distinct()
    count = edges.count()
    while count:
        parents_, children_ = edges.select(F.col("parent_id").alias("_p")).distinct(), edges.select(F.col("child_id").alias("_c")).distinct()
        edges = edges.join(parents_, F.col("child_id") == F.col("_p"), "left_semi").join(children_, F.col("parent_id") == F.col("_c"), "left_semi")
        edges = cut(edges)
        left = edges.count()
        if left == count:
            break
        count = left
    return edges.select(F.col("parent_id").alias("object_id")).distinct()
