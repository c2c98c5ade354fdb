"""Sources read as a format: each word once over restarts, answers back to the source."""

import json

import pytest

from loomgraph.operators import assembly, feed
from loomgraph.sources import feeds
from loomgraph.streaming.entries import Entries


def tell(path, *words):
    with open(path, "a", encoding="utf-8") as out:
        for w in words:
            out.write(json.dumps(w) + "\n")


def seen(key, version, scope=0):
    return {"word": "OBSERVED", "external_id": key, "version": version, "scope": scope}


def answers(path):
    with open(f"{path}.answers", encoding="utf-8") as lines:
        return [json.loads(x) for x in lines]


def test_each_word_once_over_restarts(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    tell(a, seen("x", "1"), seen("y", "1"), {"word": "COMPLETE", "scope": 0})
    feeds.register(spark, "twice_told", lambda options: [feeds.Lines(i, p) for i, p in enumerate(options["paths"].split(","), 1)])
    got = []
    entries = Entries(spark, str(tmp_path / "state"))

    def take(words, batch):
        got.extend(map(tuple, words.collect()))
        entries.apply(words, batch)

    def run(paths):
        stream = spark.readStream.format("twice_told").option("paths", paths).load()
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()

    run(a)
    # A line without its end is not told yet; a source that joins begins at its first word.
    tell(a, seen("x", "2"), {"word": "REMOVED", "external_id": "y"})
    with open(a, "a", encoding="utf-8") as out:
        out.write('{"word": ')
    tell(b, seen("z", "1", 3))
    run(f"{a},{b}")
    run(f"{a},{b}")
    with open(a, "a", encoding="utf-8") as out:
        out.write('"AVAILABLE"}\n')
    run(f"{a},{b}")
    assert sorted((r[0], r[1]) for r in got) == [(1, n) for n in range(6)] + [(2, 0)]
    whole = spark.read.format("twice_told").option("paths", f"{a},{b}").load()
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(got, key=str)
    left = {(r.source_id, r.external_id, r.version) for r in feed.alive(whole).collect()}
    assert left == {(1, "x", "2"), (2, "z", "1")} == {(r.source_id, r.external_id, r.version) for r in entries.alive().collect()}


def test_answers_reach_their_source(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    tell(a, seen("x", "bad"), seen("y", "1"))
    tell(b, seen("x", "1"))
    both = lambda options=None: [feeds.Lines(1, a, {"size": 2}), feeds.Lines(2, b)]
    feeds.register(spark, "answered", both)
    words = spark.read.format("answered").load()

    def mapped(row, emit):
        if row["version"] == "bad":
            raise ValueError("cannot be read")
        emit.set(emit.node(row["external_id"], row["external_id"], "thing"), "size", 1)

    tried = assembly.attempts(words, mapped)
    feeds.rejections(tried).write.format("answered").mode("append").save()
    assert [(r["rejected"]["external_id"], r["rejected"]["version"], r["reason"]) for r in answers(a)] == [("x", "bad", "ValueError: cannot be read")]
    # Only the source that supplies a property from a level on holds it back below that.
    writes = assembly.materialize(feed.alive(words).where("version <> 'bad'").selectExpr("*", "1 as level"), mapped, feeds.supplied(both()))
    assert [(r.source_id, r.external_id) for r in writes.where("op = 'SET'").collect()] == [(2, "x")]
    entries = spark.createDataFrame([(1, "x", 10), (1, "y", 11), (2, "x", 10), (2, "x", 12)], "source_id int, external_id string, object_id long")
    level = lambda *rows: spark.createDataFrame(rows, "object_id long, level int")
    feeds.levels(level((10, 1), (12, 2)), level((10, 2), (11, 1), (12, 2)), entries).write.format("answered").mode("append").save()
    assert sorted((r["external_id"], r["level"]) for r in answers(a)[1:]) == [("x", 2), ("y", 1)]
    with pytest.raises(FileNotFoundError):
        answers(b)


def test_refusals_and_nothing(spark, tmp_path):
    a = str(tmp_path / "a")
    tell(a)
    open(a, "w").close()
    feeds.register(spark, "silent", lambda options: [feeds.Lines(1, a)])
    assert spark.read.format("silent").load().count() == 0
    feeds.register(spark, "clashing", lambda options: [feeds.Lines(1, a), feeds.Lines(1, a)])
    with pytest.raises(Exception, match="one number"):
        spark.read.format("clashing").load().collect()
    stray = spark.createDataFrame([(9, "LEVEL", "x", 1, None, None, None, None, None)], feeds.ANSWER)
    with pytest.raises(Exception, match="no source 9"):
        stray.write.format("silent").mode("append").save()
