"""What changes bring about, held against working everything out anew."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import sums
from loomgraph.model import graph_of
from loomgraph.operators import folds, groupings, links, placement, reach, strata, upkeep, views
from loomgraph.operators.derived import Rule
from loomgraph.operators.strata import Grouping
from loomgraph.streaming.delivery import View
from loomgraph.structure import Refused, Structure

DECLARED = "port_id long, kind string, type string, role string, domain string, address string"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_sums_of_doubles_are_exact(spark):
    rng = random.Random(3)
    data, want = [], {}
    for k in range(40):
        own = [math.ldexp(rng.uniform(-1, 1), rng.choice((-1074, -700, -3, 0, 40, 700, 1000))) for _ in range(rng.randint(1, 30))]
        own += [-x for x in own[1:]] if k % 3 == 0 else []
        want[k] = math.fsum(own)
        data += [(k, None, x) for x in own]
    big = 1.7976931348623157e308
    data += [(50, None, 1e16), (50, None, 1.0), (50, None, -1e16), (51, None, math.inf), (51, 3, None), (52, None, math.inf), (52, None, -math.inf), (53, None, big), (53, None, big), (54, 2, None), (54, None, 0.5), (55, None, None), (56, 2**63 - 1, None), (56, 1, None)]
    frame = spark.createDataFrame(data, "k int, l long, d double")
    for parts in (1, 5):
        got = {r.k: (r.l, r.d, r.known, r.total) for r in sums.summed(frame.repartition(parts), ["k"]).collect()}
        assert {k: got[k][1] for k in want} == want
        assert got[50][1] == 1.0 and got[51] == (None, math.inf, 2, 2) and math.isnan(got[52][1]) and got[53][1] == math.inf
        assert got[54] == (None, 2.5, 2, 2) and got[55] == (None, None, 0, 1) and got[56][0] == -(2**63)


def test_tallies_are_taken_back_without_a_trace(spark):
    own = spark.createDataFrame([(1, None, 1e300), (1, None, 0.1), (1, None, math.nan), (1, 5, None)], "k int, l long, d double")
    rest = own.where("l is not null or d = 0.1")
    gone = own.where("l is null and d <> 0.1")
    left = sums.tally(sums.contributions(own, ["k"]).unionByName(sums.contributions(gone, ["k"], -1)), ["k"])
    assert rows(left) == rows(sums.tally(sums.contributions(rest, ["k"]), ["k"]))


def test_upkeep_equals_beginning_anew(spark):
    rng = random.Random(6)
    folds_of = [(r, f"{f}x", f) for r in range(4) for f in folds.FOLDS]
    pick = lambda: (rng.randrange(40), "v")
    value = lambda: rng.choice([(rng.randint(-9, 9), None), (None, rng.choice([0.1, 1e16, -1e16, math.inf, math.nan])), (None, None)])
    edges = [(*rng.choice(folds_of), *pick()) for _ in range(150)]
    before = {k: value() for k in ((i, "v") for i in range(40))}
    after = before | {k: value() for k in ((i, "v") for i in rng.sample(range(40), 12))}
    went = edges[:15]
    came = [(*rng.choice(folds_of), *pick()) for _ in range(15)]
    came = [e for e in came if e not in edges]
    frame = lambda e: spark.createDataFrame(e, "root long, root_key string, fold string, leaf long, leaf_key string")
    values = lambda v: spark.createDataFrame([(i, k, *x) for (i, k), x in v.items() if x != (None, None)], "object_id long, key string, l long, d double")
    now = edges[15:] + came
    state = upkeep.uphold(upkeep.begin(frame(edges), values(before)), frame(now), upkeep.value_changes(values(before), values(after)), values(after), frame(went), frame(came))
    assert repr(rows(state.values())) == repr(rows(upkeep.begin(frame(now), values(after)).values()))


def test_redrawing_equals_drawing(spark):
    rng = random.Random(8)
    domains = ["", "a", "b", "c"]

    def port(i):
        role = rng.choice(["provide", "require"])
        return [(i, "OUTPUT" if i % 2 else "INPUT", "t", role, rng.choice(domains), f"x{a}") for a in rng.sample(range(5), rng.randint(0, 3))]

    for _ in range(2):
        before = {i: port(i) for i in range(24)}
        after = before | {i: port(i) for i in rng.sample(range(24), 6)}
        routes = [("a", "b"), ("", "c"), ("b", "a")]
        frame = lambda ports: spark.createDataFrame([r for own in ports.values() for r in own], DECLARED)
        route = lambda pairs: spark.createDataFrame(pairs, "requiring_domain string, providing_domain string")
        went, came = links.declaration_changes(frame(before), frame(after))
        signed = links.redraw(frame(before), went, came, route(routes), denied=route([("a", "b")]), allowed=route([("c", "a"), ("", "b")]))
        old = links.draw(frame(before), route(routes))
        new = links.draw(frame(after), route([("", "c"), ("b", "a"), ("c", "a"), ("", "b")]))
        assert rows(links.apply_signed(old, signed)) == rows(new)
        ends = links.draw(frame(before), route(routes)).selectExpr("explode(array(from_id, to_id)) as port_id").groupBy("port_id").count()
        assert rows(links.drawn_counts(frame(before), route(routes))) == rows(ends)
        assert rows(signed.where("sign > 0").drop("sign")) == rows(new.exceptAll(old)) and rows(signed.where("sign < 0").drop("sign")) == rows(old.exceptAll(new))


def test_redrawing_writes_changes_alone(spark, monkeypatch):
    """neither what stands at touched addresses is written, nor are links compared after; a route denied and allowed at once stays."""
    written = []
    real = links.cut
    monkeypatch.setattr(links, "cut", lambda frame: written.append(real(frame)) or written[-1])
    before = spark.createDataFrame([(1, "OUTPUT", "t", "provide", "a", "x"), *[(i, "INPUT", "t", "require", "b", "x") for i in range(2, 30)]], DECLARED)
    route = spark.createDataFrame([("b", "a")], "requiring_domain string, providing_domain string")
    one = before.where("port_id = 1")
    moved = one.withColumn("domain", F.lit(""))
    assert links.redraw(before, one, moved, route).collect() == []
    assert sum(w.count() for w in written) == 2
    none = before.where("false")
    assert links.redraw(before, none, none, route, denied=route, allowed=route).collect() == []
    assert len(links.redraw(before, one, none, route).collect()) == 28


def test_moves_between_groups(spark):
    keys = lambda d: spark.createDataFrame(list(d.items()), "object_id long, name string")
    moves = groupings.moves(keys({1: "a", 2: "a", 3: "b", 4: "c"}), keys({1: "b", 2: "a", 3: "a", 5: "d"}))
    assert rows(moves) == [("c", -1), ("d", 1)]
    counts = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "name string, members long")
    assert rows(groupings.moved(counts, moves)) == [("c", 0, "REMOVED"), ("d", 1, "MADE")]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    node = lambda i: (i, "NODE", f"n{i}", "t", None, None, None, None, None, None, None, None, None, None)
    graph = graph_of(spark, [node(i) for i in range(151)], contain=[("up", i, i + 1) for i in range(150)])
    made, cut = [], placement.cut
    monkeypatch.setattr(placement, "cut", lambda frame: made.append(1) or cut(frame))
    chains = {r.object_id: [s.id for s in r.chain] for r in placement.ancestors(graph, "up").collect()}
    assert chains == {i: list(range(i)) for i in range(1, 151)} and len(made) <= 10
    ids = spark.createDataFrame([(3,), (0,)], "object_id long")
    assert [(r.object_id, [s.id for s in r.chain]) for r in placement.climbed(graph, "up", ids).collect()] == [(3, [0, 1, 2])]


def test_order_of_rules_and_groupings():
    low, owed, weight = Rule("node", "low", "SUM", own=("one",)), Rule("node", "owed", "SUM", children="low"), Rule("node", "weight", "SUM", own=("owing",))
    bands = Grouping("bands", "band", "node", ("owed",), (("owing", "SUM", "owed"),))
    plain = Grouping("plain", "p", "node[zone=a]", ("zone",))
    steps = strata.strata([weight, owed, low], [bands, plain])
    assert steps[0] == plain and set(steps[1]) == {low, owed} and steps[2] == bands and set(steps[3]) == {low, owed, weight}
    assert strata.strata([low], [plain]) == [plain, [low]] and strata.strata([], []) == []
    with pytest.raises(ValueError, match="bands"):
        strata.strata([Rule("node", "owed", "SUM", own=("owing",))], [bands])


def region(t):
    """A region over two services that are linked by an address, and one apart."""
    eu = t.create_node("eu", "region")
    made = [t.create_node(n, "service", n) for n in ("alpha", "beta", "gamma")]
    for m in made[:2]:
        t.contain(eu, m, "placement")
    out, into = t.add_output(made[0], "out", "mq"), t.add_input(made[1], "in", "mq")
    t.provide(out, "mq:a")
    for n, m in enumerate(made):
        t.set(m, "load", n + 1)
    return eu, *made, out, into


SELECTORS = ("link & touching(under(placement, /eu)), node[total>3], on(node[load>2])",)


def test_tasks_reach_views_as_full_differences_would(spark, tmp_path):
    """Replicas of views after each task hold what a snapshot holds; a task without effect delivers nothing."""
    s = Structure(spark)
    eu, alpha, beta, gamma, out, into = s.run(region)
    s.derive(Rule("node[$type=region]", "total", "SUM", children="load"))
    logs = {}
    for n, selector in enumerate(SELECTORS):
        view = s.create_view(f"v{n}", selector, str(tmp_path / str(n)))
        logs[selector] = log = []
        view.subscribe(lambda records, seq, snapshot, log=log: log.append((seq, snapshot, records.collect())))
    before = s.graph()
    tasks = [lambda t: (t.require(into, "mq:a"), t.set(beta, "load", 7)), lambda t: (t.contain(eu, gamma, "placement"), t.uncontain(eu, alpha))]
    for task in tasks:
        s.run(task)
        after = s.graph()
        for selector in SELECTORS:
            want = rows(views.delta(before, after, selector))
            seq, snapshot, got = logs[selector][-1]
            assert (sorted(map(tuple, got), key=repr) if not snapshot and seq > 0 and want else []) == want, selector
        before = after
    sizes = {k: len(v) for k, v in logs.items()}
    s.run(lambda t: t.set(alpha, "load", 1))
    assert {k: len(v) for k, v in logs.items()} == sizes
    for log in logs.values():
        assert log[0][1] and [seq for seq, _, _ in log] == list(range(len(log)))
    totals = [r.l for _, _, records in logs[SELECTORS[0]] for r in records if r.key == "total"]
    assert totals == [8, 10]


def test_tasks_within_an_interval_are_delivered_together(spark, tmp_path):
    s = Structure(spark)
    node = s.run(lambda t: t.create_node("a", "service"))
    view, log = s.create_view("v", "node", str(tmp_path), interval=3600.0), []
    view.subscribe(lambda records, seq, snapshot: log.append((seq, [(r.key, r.l) for r in records.collect()])))
    for n in (1, 2, 3):
        s.run(lambda t, n=n: t.set(node, "x", n))
    assert log[1:] == [(1, [("x", 1)])]
    s.flush_all()
    assert log[2:] == [(2, [("x", 3)])]
    s.flush_all()
    assert len(log) == 3


def test_derived_values_and_links_follow_a_stream(spark, tmp_path):
    s = Structure(spark)
    eu, alpha, beta, gamma, out, into = s.run(region)
    s.derive(Rule("node[$type=region]", "total", "SUM", children="load"))
    s.group_by("bands", "band", "node[$type=service]", ["load"])
    view, log = s.create_view("v", "node[$type=region], node[$type=band], link, output", str(tmp_path / "v"), keys=["total"]), []
    view.subscribe(lambda records, seq, snapshot: log.append({(r.change, r.key, r.l, r.t) for r in records.collect()}))
    write = "object_id long, key string, vtype string, l long, d double, b boolean, t string, source_id int, seq long"
    view.apply(spark.createDataFrame([(alpha, "load", "LONG", 40, None, None, None, 2, 1)], write), 0)
    assert ("PROPERTY_CHANGED", "total", 42, None) in log[1] and ("PROPERTY_CHANGED", "$name", None, "40") in log[1] and any(c == "REMOVED" for c, *_ in log[1])
    require = spark.createDataFrame([(into, "INPUT", "mq", "require", "", "mq:a")], DECLARED)
    view.step = lambda graph, batch: graph.with_(declared=graph.declared.unionByName(batch))
    view.apply(require, 1)
    assert ("PROPERTY_CHANGED", "$name", None, "mq:a") in log[2] and ("PROPERTY_CHANGED", "$links", 1, None) in log[2]
    # Another view from the folder goes on from there.
    again = View(s.graph(), view.selector, view.folder, view.keys, rules=view.rules, groupings=view.groupings)
    assert again.seq == 2 and rows(views.snapshot(again.graph, view.selector, view.keys)) == rows(views.snapshot(view.graph, view.selector, view.keys))


def test_folds_for_standing_groups(spark):
    s = Structure(spark)
    eu, alpha, beta, gamma, *_ = s.run(region)
    s.run(lambda t: [t.set(x, "zone", z) for x, z in ((alpha, "a"), (beta, "a"), (gamma, "b"))])
    s.group_by("zones", "zone", "node[$type=service]", ["zone"])
    s.derive_each("zones", "heavy", "MAX", "load")
    s.derive_each("zones", "heavy", "MAX", "load")
    keyed = lambda: {r.name: r.heavy.l for r in s.graph().widened(s.graph().nodes().where("type = 'zone'"), {"heavy"}).collect()}
    assert keyed() == {"a": 2, "b": 3}
    s.run(lambda t: t.set(gamma, "zone", "c"))
    assert keyed() == {"a": 2, "c": 3}
    group = s.graph().nodes().where("type = 'zone' and name = 'c'").first().object_id
    s.derive(Rule(f"node[$id={group}]", "own", "SUM", own=("heavy",)))
    for wrong in (("own", "MAX", "load"), ("zone", "MAX", "load"), ("heavy", "SUM", "load"), ("more", "MEAN", "load")):
        with pytest.raises(Refused):
            s.derive_each("zones", *wrong)
    assert keyed() == {"a": 2, "c": 3}


def test_change_between_states(spark):
    node = lambda i, name: (i, "NODE", name, "t", None, None, None, None, None, None, None, None, None, None)
    before = graph_of(spark, [node(1, "a"), node(2, "b")], [(1, "k", "LONG", 1, None, None, None, 0)], [("x", 1, 2)])
    after = before.with_(objects=graph_of(spark, [node(1, "a"), node(2, "c"), node(3, "d")]).objects, contain=graph_of(spark, contain=[("x", 2, 1)]).contain)
    change = reach.between(before, after)
    assert rows(change.objects) == [(2,), (3,)] and change.properties is None and rows(change.contain) == [("x", 1, 2), ("x", 2, 1)]
    assert reach.between(before, before) == reach.Change()


def test_links_that_cannot_be_held_are_not_written(spark, monkeypatch):
    """of the links at changed nodes only those go on that the selector may hold by their own values; records are those of full differences."""
    none = (None,) * 3
    node = lambda i, a: (i, "NODE", None, "n", *none, None, None, None, None, None, None, None)
    port = lambda i, kind, n: (i, kind, None, None, *none[:2], n, None, None, None, None, None, None, None)
    link = lambda i, a, b: (i, "LINK", None, None, *none, a, b, False, None, None, None, None)
    objects = [*[node(i, 0) for i in range(1, 5)], *[port(10 + i, "OUTPUT", i) for i in (1, 2)], *[port(10 + i, "INPUT", i) for i in (3, 4)], link(20, 11, 13), link(21, 11, 14), link(22, 12, 13), link(23, 12, 14)]
    number = lambda i, key, v: (i, key, "LONG", v, None, None, None, 0)
    widths = [number(20, "w", 5), number(21, "w", 1), number(22, "w", 5), number(23, "w", 5)]
    at = lambda a, b: [*widths, number(1, "a", a), number(2, "a", b)]
    before, after = graph_of(spark, objects, at(0, 9)), graph_of(spark, objects, at(9, 0))
    change = reach.Change(None, spark.createDataFrame([(1, "a"), (2, "a")], "object_id long, key string"))
    written = []
    real = reach.cut
    monkeypatch.setattr(reach, "cut", lambda frame: written.append(real(frame)) or written[-1])
    selector = "link[w>=4] & touching([a>5])"
    assert rows(reach.delta(before, after, selector, change)) == rows(views.delta(before, after, selector))
    assert not any(r.object_id == 21 for w in written for r in w.select("object_id").collect())
