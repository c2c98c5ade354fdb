import pytest

from loomgraph.model import graph_of
from loomgraph.operators.select import matched_ids
from loomgraph.plans import selector as s
from loomgraph.plans.path import Path, Segment

MATRIX = """
LONG|1|node[x=1]|1
LONG|1|node[x=1.5]|0
LONG|1|node[x=1.0]|1
LONG|1|node[x!=1.5]|1
LONG|1|node[x=1d]|0
LONG|9007199254740993|node[x=9007199254740993]|1
LONG|9007199254740993|node[x=9007199254740992]|0
LONG|80|node[x>80]|0
LONG|80|node[x<=79]|0
LONG|80|node[x>=80]|1
LONG|80|node[x<80.5]|1
DOUBLE|0.75|node[x<1]|1
DOUBLE|0.75|node[x>=0.8]|0
DOUBLE|-0.0|node[x=0]|1
DOUBLE|-0.0|node[x<0]|0
DOUBLE|-0.0|node[x<=-0.0]|1
DOUBLE|NaN|node[x>0]|0
DOUBLE|NaN|node[x]|1
BOOLEAN|true|node[x=true]|1
BOOLEAN|true|node[x>0]|0
TEXT|5|node[x=5]|1
TEXT|UP|node[x>0]|0
TEXT|UP|node[y>0]|0
TEXT|UP|node[x]|1
TEXT|UP|node[x~U]|1
TEXT|UP|node[x~u]|0
TEXT|UP|node & !*[y]|1
TEXT|UP|node[y!=1]|0
TEXT|UP|node & ![y=1]|1
TEXT|UP|node & ![x=UP]|0
TEXT|UP|node & !(*[x=DOWN], [y])|1
TEXT|UP|!node|0
TEXT|UP|!!node|1
""".split("\n")[1:-1]


def node(i, name="n", type="service", axis=None):
    return (i, "NODE", name, type, None, axis, None, None, None, False, None, None, None, None)


def port(i, kind, owner, address=None):
    return (i, kind, "p", "tcp", None, None, owner, None, None, False, address, None, None, 0)


def link(i, a, b):
    return (i, "LINK", "l", "tcp", None, None, None, a, b, False, None, None, None, None)


def prop(i, key, kind, value):
    return (i, key, kind, int(value) if kind == "LONG" else None, float(value) if kind == "DOUBLE" else None, value == "true" if kind == "BOOLEAN" else None, value if kind == "TEXT" else None, 0)


def ids(graph, text):
    return {r.object_id for r in matched_ids(graph, text).collect()}


def test_values_compare_as_what_they_are(spark):
    for row in MATRIX:
        kind, value, text, holds = row.split("|")
        graph = graph_of(spark, [node(1)], [prop(1, "x", kind, value)])
        assert ids(graph, text) == ({1} if holds == "1" else set()), row


@pytest.mark.parametrize("text", ["node[cpu>high]", "node[", "under(placement)", "under(placement, /)", "!", "node & !", "node!", "nodes", "[1a=2]", "node]", "[a='x]"])
def test_refused(text):
    with pytest.raises(s.SelectorError):
        s.parse(text)


def test_what_a_selector_depends_on():
    term = s.parse("node[status=UP] & ([cpu=1], link[rate=2])")
    assert term.keys() == {"status", "cpu", "rate"}
    assert s.parse("node & link").kinds() == frozenset()
    assert s.parse("on(node)").kinds() == {"INPUT", "OUTPUT"}
    assert s.parse("!node").kinds() == s.KINDS


def services(spark):
    objects = [node(1), node(2), node(3), port(11, "OUTPUT", 1), port(21, "INPUT", 2), port(22, "OUTPUT", 2), port(31, "INPUT", 3), link(101, 11, 21), link(102, 22, 31)]
    return objects


def test_link_ends_and_owners(spark):
    graph = graph_of(spark, services(spark), [prop(1, "zone", "TEXT", "in"), prop(2, "zone", "TEXT", "in")])
    assert ids(graph, "between([zone=in])") == {101}
    assert ids(graph, "touching([zone=in])") == {101, 102}
    assert ids(graph, "on([zone=in])") == {11, 21, 22}
    assert ids(graph, "link & !between([zone=in])") == {102}
    assert ids(graph, "[zone], on([zone])") == {1, 2, 11, 21, 22}


def test_addresses_one_at_a_time(spark):
    graph = graph_of(spark, [node(1), port(11, "INPUT", 1, ["a:1", "b:2"]), port(12, "INPUT", 1, ["c:3"])])
    assert ids(graph, 'input[$address="a:1"]') == {11}
    assert ids(graph, 'input[$address!="a:1"]') == {12}
    assert ids(graph, "input[$address~':']") == {11, 12}


def test_placement(spark):
    objects = [node(1, "eu-de", "region", "placement"), node(2, "blue", "cell", "placement"), node(3, "green", "cell", "placement"), node(4, "rack-1", "rack", "placement"), node(5, "query-0", "pod"), node(6, "ingest-0", "pod")]
    contain = [("placement", 1, 2), ("placement", 1, 3), ("placement", 3, 4), ("placement", 4, 5), ("placement", 2, 6)]
    graph = graph_of(spark, objects, contain=contain)
    assert ids(graph, "[$type=pod] & under(placement, /eu-de/*)") == {5, 6}
    assert ids(graph, "under(placement, /region:eu-de/cell:*/rack:*)") == {5}
    assert ids(graph, "under(placement, /eu-de)") == {2, 3, 4, 5, 6}
    assert ids(graph, "under(stage, /eu-de)") == set()


def test_paths_are_read_and_written():
    for text in ("/eu-de/zone:*/#42", "/a\\/b/t:c\\*", "/*", "/"):
        assert str(Path.parse(text)) == text
    assert Path.parse("/region:eu/*").segments == (Segment("eu", "region"), Segment())
    for bad in ("a", "/a/", "//", "/#x", "/a\\", "/t:"):
        with pytest.raises(ValueError):
            Path.parse(bad)
