"""Derived properties, groups as nodes, guards on writes and interests, on graphs small enough to count by hand."""

import pytest
from pyspark.sql import functions as F

from loomgraph.model import graph_of
from loomgraph.operators import demand, derived, groupings, guards, views
from loomgraph.operators.derived import Rule
from loomgraph.operators.select import matched, matched_ids
from loomgraph.sources import tpch
from loomgraph.structure import Refused, Structure


def node(i, name, type):
    return (i, "NODE", name, type, None, None, None, None, None, None, None, None, None, None)


def value(i, key, v, source=0):
    kind = "LONG" if isinstance(v, int) else "DOUBLE" if isinstance(v, float) else "TEXT"
    return (i, key, kind, *(v if kind == k else None for k in ("LONG", "DOUBLE")), None, v if kind == "TEXT" else None, source)


def orchard(spark):
    """A farm (1) of two fields (2, 3) with trees; tree 12 has no weight, 13 one that is text, 21 a fraction."""
    trees = [(10, 2), (11, 2), (12, 2), (13, 2), (20, 3), (21, 3)]
    objects = [node(1, "f", "farm"), node(2, "a", "field"), node(3, "b", "field"), node(4, "c", "field"), *[node(t, f"t{t}", "tree") for t, _ in trees]]
    contain = [("ground", 1, 2), ("ground", 1, 3), ("ground", 1, 4), *[("ground", f, t) for t, f in trees]]
    values = [value(10, "kg", 4), value(11, "kg", 9), value(13, "kg", "many"), value(20, "kg", 1), value(21, "kg", 0.5), value(2, "best", 99)]
    return graph_of(spark, objects, values, contain)


RULES = [
    Rule("node[$type=field]", "best", "MAX", children="kg"),
    Rule("node[$type=farm]", "best", "MAX", children="best"),
    Rule("node[$type=farm]", "sum", "SUM", children="best"),
    Rule("node[$type=farm]", "empty", "MIN", children="best.total"),
]


def read(graph, key):
    rows = graph.properties.where(F.col("key") == key).collect()
    return {r.object_id: r.l if r.l is not None else r.d for r in rows}


def test_rules_chain_and_read_what_others_derive(spark):
    graph = derived.derive(orchard(spark), RULES)
    # What was written on field 2 without a source is gone; field 4 has nothing to know.
    assert read(graph, "best") == {2: 9, 3: 1.0, 1: 9.0}
    assert read(graph, "best.known") == {2: 2, 3: 2, 4: 0, 1: 4} and read(graph, "best.total") == {2: 4, 3: 2, 4: 0, 1: 6}
    # Another fold than that of the fields reads their values: 9 + 1.0, one field unknown.
    assert read(graph, "sum") == {1: 10.0} and read(graph, "sum.known") == {1: 2} and read(graph, "sum.total") == {1: 3}
    assert read(graph, "empty") == {1: 0}
    assert {r.object_id for r in matched_ids(graph, "node[best>8]").collect()} == {1, 2}
    again = derived.derive(graph, RULES)
    assert read(again, "sum") == {1: 10.0} and again.properties.count() == graph.properties.count()
    assert read(derived.derive(orchard(spark), []), "best") == {2: 99}


def test_rules_that_are_not_allowed(spark):
    graph = orchard(spark)
    for wrong in ([Rule("node", "$x", "MAX", own=("kg",))], [RULES[0], Rule("node[$id=2]", "best", "MIN", children="kg")], [Rule("node", "x", "MEAN", own=("kg",))], [Rule("node", "x", "SUM")], [RULES[0], Rule("node[$id=2]", "top", "SUM", own=("best",))]):
        with pytest.raises(ValueError):
            derived.derive(graph, wrong)
    written = graph.with_(properties=graph.properties.withColumn("source_id", F.lit(5)))
    with pytest.raises(ValueError, match="source"):
        derived.derive(written, RULES[:1])
    circle = [Rule("node[$id=1]", "x", "SUM", children="y"), Rule("node[$id=2]", "y", "SUM", own=("z",))]
    assert read(derived.derive(graph, circle), "x.total") == {1: 3}


def test_groups_are_nodes(spark):
    graph = groupings.as_nodes(orchard(spark), "plots", "plot", "node[$type=tree]", ["parent(ground)", "kg"], [("most", "MAX", "kg")])
    found = matched(graph, "node[$type=plot]").collect()
    assert {r.external_id for r in found} == {"plots:2,4", "plots:2,9", "plots:2,many", "plots:3,0.5", "plots:3,1"}
    assert {r.name for r in matched(graph, "node[$type=plot][kg>=4]").collect()} == {"2,4", "2,9"}
    # Groups are no members, and the same members give the same ids.
    assert {r.name: r.members for r in groupings.group_by(graph, "node", ["$type"]).collect()} == {"farm": 1, "field": 3, "tree": 6}
    ids = lambda g: {r.object_id for r in matched_ids(g, "node[$type=plot]").collect()}
    assert ids(graph) == ids(groupings.as_nodes(orchard(spark), "plots", "plot", "node[$type=tree]", ["parent(ground)", "kg"]))
    faults = guards.write_faults(views.query(graph, "node[$type=plot]").where("key = 'kg'").select("object_id", "key"), graph.objects, graph.properties)
    assert {r.fault for r in faults.collect()} == {"of a group"}


def test_tasks_are_guarded(spark):
    s = Structure(spark)

    def build(t):
        a, b = t.create_node("a", "pump", "a"), t.create_node("b", "pump")
        hall = t.create_node("hall", "hall")
        t.contain(hall, a, "site"), t.contain(hall, b, "site")
        t.set(a, "flow", 3), t.set(b, "flow", 4)
        return a, b, hall, t.add_input(a, "in", "water"), t.add_output(b, "out", "water")

    a, b, hall, into, out = s.run(build)
    for wrong in (
        lambda t: t.create_link(into, out, "l", "pipe"),
        lambda t: t.create_link(out, 999, "l", "pipe"),
        lambda t: t.add_input(into, "in", "water"),
        lambda t: t.contain(hall, out, "site"),
        lambda t: t.set(999, "flow", 1),
    ):
        with pytest.raises(Refused):
            s.run(wrong)
    s.derive(Rule("node[$type=hall]", "flow", "SUM", children="flow"))
    assert [r.object_id for r in s.matched_object_ids("node[flow=7]").collect()] == [hall]
    with pytest.raises(Refused):
        s.run(lambda t: t.set(hall, "flow", 1))
    with pytest.raises(Refused):
        s.derive(Rule("node[$type=hall]", "flow", "MAX", children="flow"))
    s.group_by("kinds", "kind", "node", ["$type"], [("n", "SUM", "flow")])
    group = s.matched_object_ids("node[$type=kind][n=7]").first().object_id
    with pytest.raises(Refused):
        s.run(lambda t: t.remove(group))
    with pytest.raises(Refused):
        s.run(lambda t: t.create_node("x", "y", "kinds:z"))
    link = s.run(lambda t: t.create_link(out, into, "l", "pipe"))
    other = s.run(lambda t: t.add_input(b, "back", "water"))
    s.run(lambda t: t.retarget_link(link, input=other))
    assert [(r.from_port, r.to_port) for r in s.link_endpoints(link).select("from_port", "to_port").collect()] == [(out, other)]
    for wrong in (lambda t: t.retarget_link(link, input=out), lambda t: t.retarget_link(a, input=other), lambda t: t.retarget_link(999, input=other)):
        with pytest.raises(Refused):
            s.run(wrong)
    assert {r.object_id for r in s.children(hall).collect()} == {a, b} and s.node_ports(b, "INPUT").count() == 1
    with pytest.raises(Refused):
        s.children(out)
    with pytest.raises(KeyError):
        s.link_endpoints(999)
    s.run(lambda t: t.set(b, "flow", 5))
    assert [r.object_id for r in s.matched_object_ids("node[flow=8]").collect()] == [hall]


def test_interests_are_replaced_whole(spark):
    frame = spark.createDataFrame
    bases, own = demand.set_interests(
        frame([("a", 0), ("b", 1)], "client string, base int"), frame([("a", 1, 2), ("b", 1, 2)], "client string, object_id long, level int"),
        frame([("a", 1, 5), ("b", None, 6), ("c", 0, 1)], "client string, base int, seq long"), frame([("a", 2, 2, 5), ("a", 3, 2, 4), ("b", 4, 2, 6)], "client string, object_id long, level int, seq long"),
    )
    assert sorted(map(tuple, bases.collect())) == [("a", 1), ("c", 0)]
    assert [tuple(r) for r in own.collect()] == [("a", 2, 2)]
    nobody = demand.set_interests(bases, own, frame([("a", None, 1), ("c", None, 1)], "client string, base int, seq long"), frame([], "client string, object_id long, level int, seq long"))
    assert nobody[0].count() == 0 and nobody[1].count() == 0


def test_folds_read_no_links(spark):
    """folds over nodes and their checks read the tables that have the keys, not the links."""
    graph = tpch.bind(spark, "/root/testdata/sf0.001")
    declared = derived.declarations(graph, [Rule("node[$type=nation]", "best", "MAX", children="acctbal")])
    for frame in (derived.summands(graph, ["acctbal", "best", "size", "total"]), derived.faults(declared, graph.objects)):
        assert frame.count() >= 0
        assert not any("lineitem" in f for f in frame.inputFiles())
