"""Feeds against a loop over the words, over many stretches, and what a sweep spares."""

import random

import pytest

from loomgraph.operators import feed
from loomgraph.operators.links import draw
from loomgraph.sources import tpch

FIELDS = ("source_id", "seq", "word", "external_id", "version", "scope", "payload")


def log(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        word = rng.choices(["OBSERVED", "REMOVED", "COMPLETE", "UNAVAILABLE", "AVAILABLE"], [80, 4, 6, 1, 2])[0]
        source, scope = rng.choice([1, 1, 1, 2]), rng.choice([0, 1])
        named = word in ("OBSERVED", "REMOVED")
        key = f"e{rng.randrange(25)}" if named else None
        scope = int(key[1:]) % 2 if named else scope
        out.append((source, seq * 3, word, key, rng.choice("ab") if word == "OBSERVED" else None, scope if word in ("OBSERVED", "COMPLETE") else None, None))
    return out


def loop(rows, demand=None):
    """Entries at the end, and the observations that are mapped again, word by word."""
    entries, begun, stale, again = {}, {}, {}, set()
    for source, seq, word, key, version, scope, _ in rows:
        if word == "OBSERVED":
            old = entries.get((source, key))
            if old is None or old[1] != version or old[0] != scope:
                again.add((source, key, seq))
            entries[source, key] = (scope, version, seq)
        elif word == "REMOVED":
            entries.pop((source, key), None)
        elif word == "COMPLETE" and not stale.get(source):
            start = begun.get((source, scope), -1)
            for k, e in list(entries.items()):
                level, raised = (demand or {}).get(k, (2, None))
                if k[0] == source and e[0] == scope and e[2] <= start and level != 0 and (raised is None or raised <= start):
                    del entries[k]
            begun[source, scope] = seq
        elif word in ("UNAVAILABLE", "AVAILABLE"):
            stale[source] = word == "UNAVAILABLE"
    return {(k, e[0], e[1]) for k, e in entries.items()}, again


@pytest.mark.parametrize("stretch", [7, 10_000])
def test_entries_equal_a_loop(spark, monkeypatch, stretch):
    monkeypatch.setattr(feed, "STRETCH", stretch)
    rows = log(400, 5)
    words = spark.createDataFrame(rows, feed.WORD)
    kept, again = loop(rows)
    got = {((r.source_id, r.external_id), r.scope, r.version) for r in feed.alive(words).collect()}
    assert got == kept
    seen = {(r.source_id, r.external_id, r.seq) for r in feed.observations(words).where("materialized").collect()}
    assert seen == again
    epochs, last = {}, {}
    for r in rows:
        if r[2] != "OBSERVED":
            epochs[r[0]] = epochs.get(r[0], 0) + 1
        else:
            last[r[0], r[3], epochs.get(r[0], 0)] = r[1]
    assert {(r.source_id, r.external_id, r.epoch): r.seq for r in feed.coalesced(words).collect()} == last


def test_a_sweep_spares_what_is_off_or_was_raised(spark):
    o = lambda seq, key: (1, seq, "OBSERVED", key, "v", 0, None)
    done = lambda seq: (1, seq, "COMPLETE", None, None, 0, None)
    rows = [o(1, "plain"), o(2, "off"), o(3, "raised"), o(4, "early"), done(5), o(6, "new"), done(9)]
    demand = {(1, "off"): (0, None), (1, "raised"): (2, 7), (1, "early"): (2, 4)}
    words = spark.createDataFrame(rows, feed.WORD)
    wanted = spark.createDataFrame([(s, k, *v) for (s, k), v in demand.items()], "source_id int, external_id string, level int, raised long")
    got = {r.external_id for r in feed.alive(words, wanted).collect()}
    assert got == {"off", "raised", "new"} == {k[0][1] for k in loop(rows, demand)[0]}
    assert feed.alive(words.limit(0), wanted).count() == 0 == feed.coalesced(words.limit(0)).count()


def test_no_window_sorts_a_whole_source(spark):
    words = spark.createDataFrame(log(30, 1), feed.WORD)
    plan = feed.coalesced(words)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_stretch" in w or "_p_source_id" in w for w in windows)


def test_links_by_domain_come_once(spark):
    declared = spark.createDataFrame(
        [(1, "OUTPUT", "t", "provide", "x", "a"), (2, "OUTPUT", "t", "provide", "", "a"), (3, "INPUT", "u", "require", "x", "a"), (4, "INPUT", "u", "require", "y", "a"), (5, "INPUT", "u", "require", "", "a")],
        "port_id long, kind string, type string, role string, domain string, address string",
    )
    routes = spark.createDataFrame([("y", "x"), ("y", "x"), ("x", "x")], "requiring_domain string, providing_domain string")
    got = sorted((r.from_id, r.to_id) for r in draw(declared, routes).collect())
    assert got == [(1, 3), (1, 4), (2, 3), (2, 4), (2, 5)]
    assert sorted((r.from_id, r.to_id) for r in draw(declared).collect()) == [(1, 3), (2, 3), (2, 4), (2, 5)]


def test_lookups_read_one_table(spark):
    graph = tpch.bind(spark, "/root/testdata/sf0.001")
    for wanted, table in ((4 * tpch.UNIT + 7, "supplier"), (6 * tpch.UNIT + 3, "orders"), ("customer:42", "customer"), ("order:3<in", "orders")):
        found = graph.one(wanted) if isinstance(wanted, int) else graph.named(wanted)
        whole = graph.objects.where(f"object_id = {wanted}" if isinstance(wanted, int) else f"external_id = '{wanted}'")
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
        assert {f.rsplit("/", 1)[1] for f in found.inputFiles()} == {f"{table}.parquet"}
    link = graph.objects.where("kind = 'LINK'").first()
    assert [r.object_id for r in graph.one(link.object_id).collect()] == [link.object_id]
    assert graph.named("nothing").count() == 0 == graph.one(12).count()


def test_a_thing_observed_all_the_time(spark, monkeypatch):
    monkeypatch.setattr(feed, "STRETCH", 10)
    rng = random.Random(9)
    rows = [(1, n, "REMOVED" if rng.random() < 0.1 else "OBSERVED", "hot" if n % 5 else f"c{n % 3}", rng.choice("ab"), 0, None) for n in range(300)]
    words = spark.createDataFrame(rows, feed.WORD)
    again = {(r.external_id, r.seq) for r in feed.observations(words).where("materialized").collect()}
    assert again == {(k, q) for _, k, q in loop(rows)[1]}
    # Failures: what follows one is mapped again until it succeeds.
    fails = lambda q: q % 4 < 2
    tried = feed.runs(feed.observations(words)).selectExpr("*", "seq % 4 < 2 as failed")
    want, remembered = set(), {}
    for _, seq, word, key, version, _, _ in rows:
        if word == "REMOVED":
            remembered.pop(key, None)
        elif remembered.get(key) != version:
            want.add((key, seq))
            remembered[key] = None if fails(seq) else version
    assert {(r.external_id, r.seq) for r in feed.retried(tried).where("materialized").collect()} == want
