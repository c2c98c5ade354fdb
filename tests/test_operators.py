import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.values import Cell, canonical
from loomgraph.model import DECLARED, PROPERTY, ROUTE, graph_of
from loomgraph.operators import demand, feed, folds, groupings, links, mutations, placement, views
from loomgraph.plans.path import Path
from loomgraph.sources.frames import frames
from loomgraph.streaming import feed as stream
from loomgraph.streaming.delivery import View

from .test_selector import link, node, port, prop


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_resolve_and_path_of(spark):
    objects = [node(1, "eu-de", "region", "placement"), node(2, "blue", "cell", "placement"), node(3, "green", "cell"), node(4, "ingest-0", "pod"), node(5, "ingest-0", "service")]
    contain = [("placement", 1, 2), ("placement", 1, 3), ("placement", 2, 4)]
    graph = graph_of(spark, objects, contain=contain)
    assert rows(placement.resolve(graph, "placement", Path.parse("/eu-de/blue/ingest-0")), "object_id") == [(4,)]
    assert rows(placement.resolve(graph, "placement", Path.parse("/eu-de/green/ingest-0")), "object_id") == []
    assert ("/region:eu-de/cell:blue/pod:ingest-0",) in rows(placement.path_of(graph, "placement"), "path")
    twice = graph_of(spark, objects, contain=[*contain, ("placement", 2, 5)])
    with pytest.raises(Exception, match="names both"):
        placement.resolve(twice, "placement", Path.parse("/eu-de/blue/ingest-0")).collect()


def test_faults(spark):
    graph = graph_of(spark, [node(i) for i in range(1, 5)], contain=[("p", 1, 2), ("p", 3, 2), ("d", 2, 4), ("p", 4, 1)])
    assert rows(placement.faults(graph), "fault", "object_id") == [("cycle", 1), ("cycle", 2), ("cycle", 4), ("two parents", 2)]


def test_domains_and_routes(spark):
    d = lambda p, kind, role, domain, a: (p, kind, "t", role, domain, a)
    own = spark.createDataFrame([d(1, "OUTPUT", "provide", "blue", "x"), d(2, "INPUT", "require", "green", "x"), d(3, "OUTPUT", "provide", "", "x"), d(4, "INPUT", "provide", "", "y"), d(5, "OUTPUT", "require", "", "y")], DECLARED)
    assert rows(links.draw(own), "from_id", "to_id") == [(3, 2), (5, 4)]
    routed = links.draw(own, spark.createDataFrame([("green", "blue")], ROUTE))
    assert rows(routed, "from_id", "to_id", "name") == [(1, 2, "x"), (3, 2, "x"), (5, 4, "y")]


def releases(spark, fold, child_type):
    objects = spark.createDataFrame([(1, "cluster"), (2, "release"), (3, "release"), (4, "stream"), (5, "stream"), (6, "process"), (7, "stream")], "object_id long, type string")
    contain = spark.createDataFrame([("p", 1, 2), ("p", 1, 3), ("p", 2, 4), ("p", 2, 5), ("p", 2, 6), ("p", 3, 7)], "axis string, parent_id long, child_id long")
    spec = spark.createDataFrame([(i, "backlog", fold, "backlog", child_type) for i in (1, 2, 3)], "object_id long, key string, fold string, child_key string, child_type string")
    return objects, contain, spec


def test_nested_folds(spark):
    objects, contain, spec = releases(spark, "SUM", "stream")
    values = spark.createDataFrame([(4, "backlog", 100, None), (6, "backlog", 5000, None), (7, "backlog", 1, None)], "object_id long, key string, l long, d double")
    out = {r.object_id: (r.l, r.d, r.known, r.total) for r in folds.nested(spec, contain, objects, values).collect()}
    assert out == {1: (101, None, 2, 3), 2: (100, None, 1, 2), 3: (1, None, 1, 1)}
    objects, contain, spec = releases(spark, "MAX", None)
    out = {r.object_id: (r.l, r.d, r.known, r.total) for r in folds.nested(spec, contain, objects, values).collect()}
    assert out == {1: (5000, None, 3, 4), 2: (5000, None, 2, 3), 3: (1, None, 1, 1)}


def test_fold_types_and_limits(spark):
    contain = spark.createDataFrame([("p", 1, 2), ("p", 1, 3)], "axis string, parent_id long, child_id long")

    def fold(kind, *values):
        own = spark.createDataFrame([(2 + i, v if isinstance(v, int) else None, v if isinstance(v, float) else None) for i, v in enumerate(values)], "object_id long, l long, d double")
        r = folds.over_children(contain, own, kind).first()
        return r.l if r.d is None else r.d

    assert fold("SUM", 2, 0.5) == 2.5 and fold("SUM", 2, 1) == 3
    assert fold("SUM", (1 << 63) - 1, 1) == -(1 << 63)
    assert math.isnan(fold("MIN", float("nan"), 2.0)) and math.isnan(fold("MAX", float("nan"), 2.0))
    assert fold("SUM", float("inf"), 1.0) == float("inf")
    assert fold("SUM", None, None) is None


def test_own_keys(spark):
    own = spark.createDataFrame([(1, 3, 0.5), (2, None, None), (3, 4, None)], "object_id long, a long, b double")
    out = {r.object_id: (r.l, r.d, r.known, r.total) for r in folds.over_keys(own, "object_id", [(F.col("a"), None), (None, F.col("b"))], "SUM").collect()}
    assert out == {1: (None, 3.5, 2, 2), 2: (None, None, 0, 2), 3: (4, None, 1, 2)}


def test_canonical_keys_tell_types_apart(spark):
    frame = spark.createDataFrame([(5, None), (None, "5"), (None, '"5"'), (None, "a,b"), (None, "true")], "l long, t string")
    assert [r[0] for r in frame.select(canonical(Cell(long=F.col("l"), text=F.col("t")))).collect()] == ["5", '"5"', '\\"5\\"', "a\\,b", '"true"']


def test_groups_of_links(spark):
    objects = [node(1), node(2), port(11, "OUTPUT", 1), port(12, "OUTPUT", 1), port(13, "OUTPUT", 1), port(21, "INPUT", 2), *[link(100 + i, 10 + i, 21) for i in (1, 2, 3)]]
    props = [prop(11, "topic", "TEXT", "enriched"), prop(12, "topic", "TEXT", "invoices"), prop(13, "topic", "TEXT", "invoices"), prop(11, "rate", "LONG", 100), prop(12, "rate", "LONG", 10), prop(13, "rate", "LONG", 1)]
    out = groupings.group_by(graph_of(spark, objects, props), "link", ["$from.topic"], [("rate", "SUM", "$from.rate")])
    assert rows(out, "name", "rate_l", "rate_total") == [("enriched", 100, 1), ("invoices", 11, 2)]
    with pytest.raises(ValueError):
        groupings.KeyPath("$from.$node.name")


def test_removal_cascades(spark):
    objects = [node(1), node(2), node(3), port(11, "OUTPUT", 1), port(21, "INPUT", 2), link(101, 11, 21)]
    graph = graph_of(spark, objects, contain=[("p", 1, 3)])
    left = mutations.remove(graph, spark.createDataFrame([(1,)], "object_id long"))
    assert rows(left.objects, "object_id") == [(2,), (3,), (21,)]
    assert left.contain.count() == 0


def value(i, key, seq, source=1, l=None, t=None):  # noqa: E741
    return (i, key, "LONG" if l is not None else "TEXT" if t is not None else None, l, None, None, t, source, seq)


def test_writes(spark):
    old = spark.createDataFrame([prop(1, "a", "LONG", 3), prop(1, "b", "TEXT", "x"), prop(2, "a", "LONG", 1)], PROPERTY)
    writes = spark.createDataFrame([value(1, "a", 1, l=9), value(1, "a", 2, 7, l=3), value(1, "b", 3), value(3, "c", 4, t="n")], PROPERTY + ", seq long")
    assert rows(mutations.changes(old, writes), "object_id", "key", "vtype") == [(1, "b", None), (3, "c", "TEXT")]
    assert rows(mutations.apply(old, writes), "object_id", "key", "source_id") == [(1, "a", 7), (2, "a", 0), (3, "c", 1)]
    derived = graph_of(spark, [port(1, "OUTPUT", 9), port(2, "INPUT", 9), (5, "LINK", "l", "t", None, None, None, 1, 2, True, None, None, None, None)]).objects
    with pytest.raises(Exception, match="cannot be moved"):
        mutations.retarget(derived, spark.createDataFrame([(5, 3, None)], "link_id long, from_id long, to_id long")).collect()


def test_random_deltas_rebuild_the_view(spark):
    rng = random.Random(5)
    objects = [node(i, f"n{i}") for i in range(1, 9)]
    selector = "node[a>4]"
    props = {(i, "a"): rng.randint(0, 9) for i in range(1, 9)}
    state = lambda: graph_of(spark, objects, [prop(i, k, "LONG", v) for (i, k), v in props.items()], [("p", 1, 2), ("p", 1, 3)])
    now = state()
    log = views.snapshot(now, selector).withColumn("seq", F.lit(0))
    for step in range(1, 4):
        for _ in range(4):
            props[rng.randint(1, 8), "a"] = rng.randint(0, 9)
        new = state()
        log = log.unionByName(views.delta(now, new, selector).withColumn("seq", F.lit(step)))
        now = new
    want = views.entries(now, views.members(now, selector))
    assert rows(views.replica(log), "object_id", "key", "l", "t") == rows(want, "object_id", "key", "l", "t")


def words(rng, n):
    out = []
    for seq in range(n):
        word = rng.choices(["OBSERVED", "REMOVED", "COMPLETE", "UNAVAILABLE", "AVAILABLE"], [12, 2, 4, 1, 1])[0]
        named = word in ("OBSERVED", "REMOVED")
        out.append((1, seq, word, f"e{rng.randint(0, 4)}" if named else None, rng.choice(["v1", "v2", None]) if word == "OBSERVED" else None, rng.randint(0, 1) if word in ("OBSERVED", "COMPLETE") else None, None))
    return out


def test_feed_windows_equal_the_simulator(spark):
    rng = random.Random(11)
    logs, want = [], {}
    for source in range(60):
        own = [(source, *w[1:]) for w in words(rng, rng.randint(1, 25))]
        logs += own
        state = stream.initial()
        names = [c.split()[0] for c in feed.WORD.split(", ")]
        list(stream.advance(state, [dict(zip(names, w, strict=True)) for w in own], source))
        want[source] = (state["said"], {(e, v, s) for e, (v, s, _) in state["entries"].items()})
    log = spark.createDataFrame(logs, feed.WORD)
    got = {s: set() for s in want}
    for r in feed.alive(log).collect():
        got[r.source_id].add((r.external_id, r.version, r.scope))
    assert got == {s: e for s, (_, e) in want.items()}
    assert {r.source_id: r.state for r in feed.states(log).collect()} == {s: x for s, (x, _) in want.items()}


def test_feed_stream_equals_one_batch(spark, tmp_path):
    log = words(random.Random(3), 60)
    for part in range(3):
        spark.createDataFrame(log[20 * part : 20 * part + 20], feed.WORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(feed.WORD).parquet(str(tmp_path / "in"))
    query = stream.actions(read).writeStream.format("memory").queryName("acts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = stream.initial()
    names = [c.split()[0] for c in feed.WORD.split(", ")]
    want = list(stream.advance(state, [dict(zip(names, w, strict=True)) for w in log], 1))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in spark.table("acts").collect())


def test_demand(spark):
    objects = spark.createDataFrame([(1,), (2,), (3,)], "object_id long")
    client = lambda *r: spark.createDataFrame(list(r), "client string, base int")
    over = spark.createDataFrame([("a", 1, 2), ("a", 2, 0), ("b", 2, 0), ("x", 3, 2)], "client string, object_id long, level int")
    assert rows(demand.levels(objects, client(("a", 1), ("b", 0)), over), "object_id", "level") == [(1, 2), (2, 0), (3, 1)]
    assert rows(demand.levels(objects, client(("a", 1), ("b", 0)).where("false"), over), "level") == [(2,)] * 3


def test_delivery(spark, tmp_path):
    graph = graph_of(spark, [node(1), node(2)], [prop(1, "a", "LONG", 5)])
    view = View(graph, "node[a>3]", str(tmp_path / "view"))
    got, gone = [], []
    view.subscribe(lambda r, seq, snap: got.append((seq, snap, {(x.change, x.object_id) for x in r.collect()})))

    def broken(*_):
        raise RuntimeError("no")

    view.subscribe(broken, gone.append)
    for n, v in enumerate((9, 9, 1)):
        view.apply(spark.createDataFrame([value(2, "a", n, l=v)], PROPERTY + ", seq long"), n)
    assert [(s, f) for s, f, _ in got] == [(0, True), (1, False), (2, False)]
    assert ("ADDED", 2) in got[1][2] and got[2][2] == {("REMOVED", 2)}
    assert len(gone) == 1 and len(view.subscriptions) == 1


def test_frames(spark):
    import json

    graph = graph_of(spark, [node(1, 'a"b')], [prop(1, "r", "DOUBLE", "NaN")])
    out = [json.loads(r.frame) for r in frames(views.snapshot(graph, "node"), "v", 0, True).collect()]
    assert out[0]["changes"][0] == ["+", 1, "NODE"] and len(out[0]["changes"]) == 2
    run, keys = out[0]["changes"][1], out[0]["keys"]
    assert run[:2] == ["p", 1] and out[0]["version"] == 0
    stated = {keys[str(k)]: v for k, v in zip(run[2::2], run[3::2], strict=True)}
    assert stated["$name"] == 'a"b' and stated["r"] == "NaN" and "$id" not in stated and len(stated) == len(keys)
    gone = [json.loads(r.frame) for r in frames(views.delta(graph, graph.with_(objects=graph.objects.limit(0)), "node"), "v", 1, False, 4).collect()]
    assert [(g["changes"], g["keys"], g["seq"], g["version"], g["snapshot"]) for g in gone] == [([["-", 1, "NODE"]], {}, 1, 4, False)]


def test_assembly(spark):
    from loomgraph.operators import assembly

    def pod(row, emit):
        if row["payload"] == "bad":
            raise RuntimeError("bad pod")
        cluster = emit.node(f"cluster:{row['payload']}", row["payload"], "cluster")
        own = emit.node(row["external_id"], row["external_id"], "pod")
        emit.contain(cluster, own, "placement")
        emit.set(own, "cpu", 0.5)
        emit.provide(emit.output(own, "out", "mq"), ["mq:x"])

    entries = lambda *r: spark.createDataFrame([(1, e, p, level) for e, p, level in r], "source_id int, external_id string, payload string, level int")
    before = assembly.materialize(entries(("a", "east", 2), ("b", "east", 1), ("c", "west", 2)), pod, {"cpu": 2})
    assert rows(assembly.objects(before).where("kind = 'NODE'"), "object", "claims") == [("a", 1), ("b", 1), ("c", 1), ("cluster:east", 2), ("cluster:west", 1)]
    assert rows(assembly.values(before), "object", "d") == [("a", 0.5), ("c", 0.5)]
    assert rows(assembly.declarations(before), "port") == [("a>out",), ("b>out",), ("c>out",)]
    after = assembly.materialize(entries(("a", "bad", 2), ("b", "north", 2)), pod)
    assert rows(assembly.rejected(after), "external_id", "error") == [("a", "RuntimeError: bad pod")]
    assert rows(assembly.released(before, after), "object") == [("c",), ("c>out",), ("cluster:west",)]


def test_fold_declarations_are_checked(spark):
    spec = spark.createDataFrame([(1, "a", "SUM", "b", None), (1, "a", "MAX", "b", None), (2, "$id", "SUM", "b", None), (9, "c", "AVG", "b", None), (2, "d", "SUM", "d", "x")], "object_id long, key string, fold string, child_key string, child_type string")
    objects = spark.createDataFrame([(1, "NODE"), (2, "NODE"), (9, "LINK")], "object_id long, kind string")
    written = spark.createDataFrame([(2, "d", 4), (1, "a", 0)], "object_id long, key string, source_id int")
    assert rows(folds.faults(spec, objects, written), "fault", "object_id", "key") == [("declared twice", 1, "a"), ("no such fold", 9, "c"), ("not a node", 9, "c"), ("reserved key", 2, "$id"), ("written by a source", 2, "d")]
