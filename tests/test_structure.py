import pytest

from loomgraph.structure import Refused, Structure


def ids(frame):
    return sorted(r.object_id for r in frame.collect())


def test_a_graph_in_tasks(spark):
    s = Structure(spark)

    def build(t):
        billing, query = t.create_node("billing", "service", "b"), t.create_node("query", "service")
        region = t.create_node("eu", "region")
        out, into = t.add_output(billing, "out", "mq"), t.add_input(query, "in", "mq")
        t.contain(region, billing, "placement")
        t.provide(out, ["mq:orders", "mq:orders"])
        t.require(into, "mq:orders", "green")
        t.set(billing, "rate", 5)
        t.set(query, "rate", 2.5)
        return billing, query, region, out, into

    billing, query, region, out, into = s.run(build, source_id=3)
    assert s.find_by_external_id("b>out") == out and s.find_by_external_id("nobody") is None
    assert s.path_of(billing, "placement") == "/region:eu/service:billing" and s.resolve("placement", "/eu/billing") == billing
    assert len(ids(s.matched_object_ids("link"))) == 1
    assert ids(s.matched_object_ids("on(node[rate>3])")) == [out]
    assert s.snapshot_object(out)["$links"] == "1" and s.snapshot_object(out)["$address"] == "mq:orders"
    assert [(r.l, r.known) for r in s.fold_children("rate", "SUM", "placement").collect()] == [(5, 1)]
    s.group_by("rates", "band", "node", ["rate"], [("rate", "MAX", "rate")])
    assert sorted(r.external_id for r in s.groups("rates").collect()) == ["rates:2.5", "rates:5"]

    s.run(lambda t: t.provide(out, "mq:orders", "blue"))
    assert ids(s.matched_object_ids("link")) == [] and ids(s.matched_object_ids("input[$links=0]")) == [into]
    s.allow_route("green", "blue")
    assert len(ids(s.matched_object_ids("link"))) == 1

    with pytest.raises(Refused):
        s.run(lambda t: t.create_node("other", "service", "b"))
    with pytest.raises(Refused):
        s.run(lambda t: (t.set(billing, "rate", 9), t.contain(billing, region, "other")))
    assert s.snapshot_object(billing)["rate"] == "5"

    s.run(lambda t: t.remove(billing))
    # The node of the group that is left is an object like any other, until the grouping goes.
    assert [r.external_id for r in s.groups("rates").collect()] == ["rates:2.5"] and len(ids(s.matched_object_ids("node[$type=band]"))) == 1
    s.remove_grouping("rates")
    assert ids(s.matched_object_ids("")) == sorted([query, region, into])
