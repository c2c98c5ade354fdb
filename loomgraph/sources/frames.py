"""Records of a batch as one JSON frame per group of objects, for clients, and frames read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames(records: DataFrame, view: str, seq: int, snapshot: bool, version: int = 0, per_frame: int = 1000) -> DataFrame:
    """(view, seq, part, frame): frames of at most about ``per_frame`` objects, so that no task writes a whole large batch.

    A frame is ``{"view", "seq", "version", "snapshot", "changes", "keys"}``,
    ``version`` being that of the graph. A change is ``["+", id, kind]``,
    ``["-", id, kind]``, ``["c", child, parent]``, ``["u", child, parent]`` or
    ``["p", id, key, value, key, value..]`` with all properties of the object
    that the frame states. A key is a number that ``keys`` names, so that each
    frame reads on its own. An absent value is null; a double that JSON cannot
    write is text. ``$id`` is not repeated as a property, nor is the external
    id of a port, which follows from its node and name. A batch without records
    has no frame.
    """
    odd = F.isnan("d") | F.col("d").isin(float("inf"), float("-inf"))
    raw = F.coalesce(
        F.col("l").cast("string"),
        F.when(odd, F.concat(F.lit('"'), F.col("d").cast("string"), F.lit('"'))),
        F.col("d").cast("string"),
        F.col("b").cast("string"),
        _text(F.col("t")),
        F.lit("null"),
    )
    number, other = F.col("object_id").cast("string"), F.col("parent_id").cast("string")
    change = F.col("change")
    whole = (
        F.when(change == "ADDED", F.concat(F.lit('["+",'), number, F.lit(","), _text(F.col("kind")), F.lit("]")))
        .when(change == "REMOVED", F.concat(F.lit('["-",'), number, F.lit(","), _text(F.col("kind")), F.lit("]")))
        .when(change == "CONTAINED", F.concat(F.lit('["c",'), number, F.lit(","), other, F.lit("]")))
        .when(change == "UNCONTAINED", F.concat(F.lit('["u",'), number, F.lit(","), other, F.lit("]")))
    )
    told = (F.col("key") == "$id") | ((F.col("key") == "$externalId") & F.coalesce(F.col("kind").isin("INPUT", "OUTPUT"), F.lit(False)))
    shown = records.where((change != "PROPERTY_CHANGED") | ~told).withColumn("part", F.floor(F.col("object_id") / per_frame))
    stated = F.when(change == "PROPERTY_CHANGED", F.struct("key", raw.alias("value")))
    each = shown.select("part", "rank", "object_id", F.coalesce("parent_id", F.lit(0)).alias("parent_id"), whole.alias("whole"), stated.alias("stated"))
    # Both aggregations find the rows of a frame in one place.
    runs = each.repartition("part").groupBy("part", "rank", "object_id", "parent_id", "whole").agg(F.sort_array(F.collect_list("stated")).alias("run"))
    body = runs.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("rank", "object_id", "parent_id", "whole", "run"))).alias("s"))
    body = body.withColumn("names", F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda s: F.transform(s["run"], lambda p: p["key"]))))))
    pair = lambda p: F.concat(F.array_position("names", p["key"]).cast("string"), F.lit(","), p["value"])
    item = lambda s: F.coalesce(s["whole"], F.concat(F.lit('["p",'), s["object_id"].cast("string"), F.lit(","), F.array_join(F.transform(s["run"], pair), ","), F.lit("]")))
    named = F.transform("names", lambda n, i: F.concat(F.lit('"'), (i + 1).cast("string"), F.lit('":'), _text(n)))
    head = F.lit(f'{{"view":{json.dumps(view)},"seq":{seq},"version":{version},"snapshot":{str(snapshot).lower()},"changes":[')
    frame = F.concat(head, F.array_join(F.transform("s", item), ","), F.lit('],"keys":{'), F.array_join(named, ","), F.lit("}}"))
    return body.select(F.lit(view).alias("view"), F.lit(seq).alias("seq"), "part", frame.alias("frame"))


def changes(frames: DataFrame) -> DataFrame:
    """(change, object_id, first, second) of each change that frames tell, a row for each property: its key and value as text."""
    read = F.from_json("frame", "changes array<array<string>>, keys map<string,string>").alias("f")
    each = frames.select(read).select(F.explode("f.changes").alias("c"), F.col("f.keys").alias("keys"))
    at = F.sequence(F.lit(2), F.size("c") - 2, F.lit(2))
    run = F.transform(at, lambda i: F.struct(F.element_at("keys", F.get("c", i)).alias("first"), F.get("c", i + 1).alias("second")))
    one = F.array(F.struct(F.get("c", F.lit(2)).alias("first"), F.lit(None).cast("string").alias("second")))
    rows = each.select(F.col("c")[0].alias("change"), F.col("c")[1].cast("long").alias("object_id"), F.explode(F.when(F.col("c")[0] == "p", run).otherwise(one)).alias("v"))
    return rows.select("change", "object_id", "v.first", "v.second")


def _text(value):
    """A JSON string."""
    return F.when(value.isNotNull(), F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))
