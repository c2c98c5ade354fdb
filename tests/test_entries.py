"""Entries kept over batches of words equal those of all words at once."""

import random

import pytest

from loomgraph.operators import feed
from loomgraph.streaming.entries import WORD, Entries


def log(rng, n):
    out = []
    for seq in range(n):
        word = rng.choices(["OBSERVED", "REMOVED", "COMPLETE", "UNAVAILABLE", "AVAILABLE"], [12, 1, 4, 0.4, 0.8])[0]
        own = word in ("OBSERVED", "REMOVED")
        out.append((rng.randrange(2), seq, word, f"e{rng.randrange(12)}" if own else None, rng.choice("xyz") if word == "OBSERVED" else None, rng.randrange(3) if word in ("OBSERVED", "COMPLETE") else None, f"p{seq}" if own else None))
    return out


def rows(frame):
    return sorted(map(tuple, frame.select("source_id", "external_id", "scope", "version", "payload", "seq").collect()))


@pytest.mark.parametrize("wanted", [False, True])
def test_batches_equal_the_whole_log(spark, tmp_path, wanted):
    rng = random.Random(wanted + 11)
    words, told, held = log(rng, 160), [], {}
    demand = spark.createDataFrame([(s, f"e{e}", e % 3, None if e % 2 else 70) for s in range(2) for e in range(8)], "source_id int, external_id string, level int, raised long") if wanted else None

    def hear(records, batch):
        for r in records.collect():
            told.append(r.action)
            held.pop((r.source_id, r.external_id), None)
            if r.action == "SEEN":
                held[r.source_id, r.external_id] = r.version

    entries = Entries(spark, str(tmp_path), (lambda: demand) if wanted else None, hear)
    cuts = [0, 30, 31, 80, 120, 160]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = words[a:b]
        rng.shuffle(part)
        entries.apply(spark.createDataFrame(part, WORD), n)
        if n == 2:
            # Restarted, it goes on from its folder; a batch that comes again changes nothing.
            entries = Entries(spark, str(tmp_path), entries.demand, hear)
            before = rows(entries.alive())
            entries.apply(spark.createDataFrame(part, WORD), n)
            assert rows(entries.alive()) == before
    want = rows(feed.alive(spark.createDataFrame(words, WORD), demand))
    assert rows(entries.alive()) == want and want
    assert held == {(r[0], r[1]): r[3] for r in want} and "GONE" in told
    # One row an entry, two a completed scope, one a source.
    assert entries.log().count() <= len(want) + 2 * 6 + 2


def test_a_stream_of_files(spark, tmp_path):
    words = log(random.Random(5), 60)
    entries = Entries(spark, str(tmp_path / "state"))
    for k, part in enumerate((words[:25], words[25:])):
        spark.createDataFrame(part, WORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = entries.start(spark.readStream.schema(WORD).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
        assert rows(entries.alive()) == rows(feed.alive(spark.createDataFrame(words[: 25 if k == 0 else 60], WORD)))
    entries.apply(spark.createDataFrame([], WORD), 99)
    assert rows(entries.alive()) == rows(feed.alive(spark.createDataFrame(words, WORD)))
