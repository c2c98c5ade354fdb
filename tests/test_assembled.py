"""What entries emit, applied to a graph, and views over streams of it."""

from loomgraph.model import graph_of
from loomgraph.operators import assembly, links
from loomgraph.operators.select import matched_ids
from loomgraph.streaming.delivery import View

from .test_derived import node, value

WORDS = "source_id int, external_id string, version string"


def emit(row, e):
    key = row["version"]
    if key == "fault":
        raise ValueError("no")
    pump = e.node(row["external_id"], key, "pump")
    hall = e.node("hall", "hall", "hall")
    e.contain(hall, pump, "site")
    e.set(pump, "flow", len(key))
    e.set(hall, "last", key)
    out = e.output(pump, "out", "water")
    e.provide(out, ["w1", "w1", "w2"], "d")
    if key == "gone":
        e.remove(pump)
    if key == "kind":
        e.node("p1>out", "out", "water")
    if key == "lost":
        e.set("nowhere", "x", 1)
    if key == "silent":
        e.remove_property(pump, "flow")
        e.clear_address(out)


def writes(spark, rows):
    return assembly.materialize(spark.createDataFrame(rows, WORDS), emit)


def old(spark):
    """A pump that is there already, with a tag, in an old hall."""
    first = list(node(1, "old", "pump"))
    first[4] = "p1"
    return graph_of(spark, [tuple(first), node(2, "shed", "hall")], [value(1, "tag", "t", 3), value(1, "flow", 99, 3)], [("site", 2, 1)])


def test_writes_meet_a_graph(spark):
    graph = old(spark)
    own = writes(spark, [(1, "p1", "a"), (1, "p2", "bb"), (1, "p3", "gone"), (1, "p4", "kind"), (1, "p5", "lost"), (1, "p6", "silent"), (1, "p7", "fault")])
    taken = assembly.allowed(graph, own)
    assert {r.external_id: r.error for r in assembly.rejected(taken).collect()} == {"p4": "another kind: p1>out", "p5": "no such object: nowhere", "p7": "ValueError: no"}
    after = assembly.applied(graph, taken)
    ids = {r.external_id: r.object_id for r in after.objects.where("external_id is not null").collect()}
    assert set(ids) == {"p1", "p2", "p6", "hall", "p1>out", "p2>out", "p6>out"} and ids["p1"] == 1
    assert {r.object_id: r.l for r in after.properties.where("key = 'flow'").collect()} == {1: 1, ids["p2"]: 2}
    assert {(r.parent_id, r.child_id) for r in after.contain.collect()} == {(ids["hall"], ids[p]) for p in ("p1", "p2", "p6")}
    assert sorted((r.port_id, r.address) for r in after.declared.collect()) == sorted((ids[f"{p}>out"], a) for p in ("p1", "p2") for a in ("w1", "w2"))
    assert {r.node_id for r in after.objects.where("kind = 'OUTPUT'").collect()} == {ids["p1"], ids["p2"], ids["p6"]}
    assert {r.object_id for r in matched_ids(after, "on(node[tag=t])").collect()} == {ids["p1>out"]}
    # The same writes again change nothing, and what no entry reaches goes with its ports.
    again = assembly.applied(after, taken)
    assert sorted(map(str, again.properties.collect())) == sorted(map(str, after.properties.collect())) and again.objects.count() == after.objects.count()
    gone = assembly.released(writes(spark, [(1, "p2", "bb")]), writes(spark, [(1, "p9", "c")]))
    assert sorted(r.object for r in gone.collect()) == ["p2", "p2>out"]
    left = assembly.applied(after, writes(spark, []), gone)
    assert {r.external_id for r in left.objects.where("external_id is not null").collect()} == {"p1", "p6", "hall", "p1>out", "p6>out"}
    assert left.declared.count() == 2 and links.draw(left.declared).count() == 0


def test_a_view_follows_structure_and_goes_on_after_a_restart(spark, tmp_path):
    source, folder, mark = str(tmp_path / "in"), str(tmp_path / "view"), str(tmp_path / "mark")
    put = lambda rows: writes(spark, rows).coalesce(1).write.mode("append").parquet(source)
    step = lambda graph, rows: assembly.applied(graph, assembly.allowed(graph, rows))
    view = View(old(spark), "node[$type=pump]", folder, step=step)
    told = []
    view.subscribe(lambda records, seq, snapshot: told.append((seq, snapshot, sorted((r.change, r.key or "") for r in records.collect() if r.change != "PROPERTY_CHANGED" or not r.key.startswith("$")))))
    put([(1, "p2", "bb")])
    view.start(spark.readStream.schema(assembly.WRITE).parquet(source), mark)
    view.flush()
    view.deliver("1 second")
    put([(1, "p2", "gone"), (1, "p1", "aaa")])
    view.flush()
    assert told[0] == (0, True, [("ADDED", ""), ("PROPERTY_CHANGED", "flow"), ("PROPERTY_CHANGED", "tag")])
    assert told[1] == (1, False, [("ADDED", ""), ("PROPERTY_CHANGED", "flow")])
    assert told[2] == (2, False, [("PROPERTY_CHANGED", "flow"), ("REMOVED", "")])
    view.touch(1), view.touch(2)
    assert told[3] == (3, False, [("PROPERTY_CHANGED", "flow"), ("PROPERTY_CHANGED", "tag")]) and len(told) == 4
    view.close()
    later = View(old(spark), "node[$type=pump]", folder, step=step)
    assert later.batch == view.batch and later.seq == 2
    before = sorted(r.object_id for r in matched_ids(later.graph, "").collect())
    assert before == sorted(r.object_id for r in matched_ids(view.graph, "").collect())
    later.apply(writes(spark, [(1, "p5", "a")]), later.batch)
    assert sorted(r.object_id for r in matched_ids(later.graph, "").collect()) == before
    later.apply(writes(spark, [(1, "p5", "a")]), later.batch + 1)
    assert matched_ids(later.graph, "node[$type=pump]").count() == 2 and later.seq == 3
