"""Derived properties: rules whose folds become properties that selectors, views, groupings and other rules read.

``derive`` adds the values of rules to ``properties``, marked by the source
``DERIVED``; over a graph that has such values already it works them out anew.
A fold is absent while nothing is known; rules over children also give
``<key>.known`` and ``<key>.total``. What was written under a derived key
without a source goes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..model import INTRINSIC, Graph
from . import folds
from .select import matched_ids

#: Sources of what the graph itself writes.
DERIVED, GROUPED = -1, -2
DECLARED = "object_id long, key string, fold string, own array<string>, child_key string, child_type string"


@dataclass(frozen=True)
class Rule:
    """``fold`` of own keys, of a key of the children (of a type), or of both, as ``key`` of the objects that ``objects`` selects.

    The selector reads what is written, not what is derived.
    """

    objects: str
    key: str
    fold: str
    own: tuple[str, ...] = ()
    children: str | None = None
    child_type: str | None = None


def declarations(graph: Graph, rules: Sequence[Rule]) -> DataFrame:
    """(object_id, key, fold, own, child_key, child_type) of the objects of each rule; a rule told twice is one."""
    text = lambda value: F.lit(value).cast("string")
    each = [
        matched_ids(graph, r.objects).select(
            "object_id", text(r.key).alias("key"), text(r.fold).alias("fold"), F.array(*map(F.lit, r.own)).cast("array<string>").alias("own"), text(r.children).alias("child_key"), text(r.child_type).alias("child_type")
        )
        for r in rules
    ]
    return reduce(DataFrame.unionByName, each).distinct() if each else graph.spark.createDataFrame([], DECLARED)


def supplied(declared: DataFrame) -> DataFrame:
    """(object_id, name, key): all names under which declarations give values."""
    counts = F.array("key", F.concat("key", F.lit(".known")), F.concat("key", F.lit(".total")))
    names = F.when(F.col("child_key").isNull(), F.array("key")).otherwise(counts)
    return declared.select("object_id", F.explode(names).alias("name"), "key")


def faults(declared: DataFrame, objects: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """(fault, object_id, key) of declarations that are not allowed."""
    told = lambda frame, fault: frame.select(F.lit(fault).alias("fault"), "object_id", "key")
    names = supplied(declared)
    reserved = F.col("key").startswith("$") | F.coalesce(F.col("child_key").startswith("$"), F.lit(False)) | F.exists("own", lambda k: k.startswith("$"))
    out = [told(declared.where(reserved), "reserved key"), told(declared.where(~F.col("fold").isin(*folds.FOLDS)), "no such fold")]
    out.append(told(declared.where((F.size("own") == 0) & F.col("child_key").isNull()), "nothing to fold"))
    twice = names.groupBy("object_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n > 1")
    out.append(told(twice, "declared twice"))
    nodes = objects.where("kind = 'NODE'").select(F.col("object_id").alias("_o"))
    childed = declared.where("child_key is not null").join(nodes, F.col("object_id") == F.col("_o"), "left")
    out.append(told(childed.where("_o is null"), "not a node"))
    reads = declared.select("object_id", "key", F.explode("own").alias("name"))
    out.append(told(reads.join(names.select("object_id", "name"), ["object_id", "name"]), "own key is derived"))
    if properties is not None:
        own = properties.where(f"source_id > 0 or source_id = {GROUPED}").select("object_id", F.col("key").alias("name"), "source_id")
        met = names.join(own, ["object_id", "name"])
        out += [told(met.where("source_id > 0"), "written by a source"), told(met.where("source_id < 0"), "key of a group")]
    return reduce(DataFrame.unionAll, out).distinct()


def summands(graph: Graph, keys: Sequence[str]) -> DataFrame:
    """(object_id, key, l, d) of the keys where they are numbers.

    Each column is read from the kinds that have it, other keys from the
    properties alone; objects that have none are not looked at.
    """
    parts, loose = [], []
    for key in keys:
        if key not in INTRINSIC and key not in graph.bound:
            loose.append(key)
            continue
        cell = graph.cell(key)
        number = cell.long if cell.long is not None else cell.double
        if number is not None:
            whole, broken = ((F.lit(None) if c is None else c).cast(t) for c, t in ((cell.long, "long"), (cell.double, "double")))
            parts.append(graph.objects.where(number.isNotNull()).select("object_id", F.lit(key).alias("key"), whole.alias("l"), broken.alias("d")))
    if loose and graph.properties is not None:
        own = graph.properties.where(F.col("key").isin(loose)).groupBy("object_id", "key").agg(F.first(F.struct("l", "d")).alias("_v"))
        parts.append(own.select("object_id", "key", "_v.*").where("l is not null or d is not null"))
    return reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], "object_id long, key string, l long, d double")


def tallies(graph: Graph, declared: DataFrame, keys: Sequence[str], names: set[str]) -> DataFrame:
    """(object_id, key, l, d, known, total) of each declaration over the written values of ``keys``; ``names`` are all that declarations supply.

    What reads no such name from children is folded at once. Of the rest, a
    summand that is itself derived, and not taken over whole by a chain, has
    to be known first: declarations are folded in strata, of which there are
    at most as many as levels of containment times rules along one path.
    """
    nodes = graph.objects.where(F.col("kind") == "NODE")
    values = summands(graph, keys)
    waits = F.coalesce(F.col("child_key").isin(*names), F.lit(False))
    owning = lambda rows: rows.select(F.col("object_id").alias("root"), F.col("key").alias("root_key"), "fold", F.col("object_id").alias("leaf"), F.explode("own").alias("leaf_key"))
    roots = lambda rows: rows.select(F.col("object_id").alias("root"), F.col("key").alias("root_key"))

    def found(ready: DataFrame, rows: DataFrame) -> DataFrame:
        read = values.select(F.col("object_id").alias("leaf"), F.col("key").alias("leaf_key"), "l", "d")
        # What has no children is told too: nothing of nothing is known.
        tally = ready.select(F.col("root").alias("object_id"), F.col("root_key").alias("key")).join(folds.by_fold(rows.join(read, ["leaf", "leaf_key"], "left")), ["object_id", "key"], "left")
        return cut(tally.fillna(0, ["known", "total"]))

    plain, rest = declared.where(~waits), declared.where(waits)
    out = found(roots(plain), folds.children(plain.where("child_key is not null"), graph.contain, nodes).unionByName(owning(plain)))
    if names.isdisjoint(keys):
        return out
    values = values.unionByName(named(out, declared).select("object_id", "key", "l", "d"))
    chained = lambda rows: rows.where("child_key is not null").withColumn("own", F.size("own") > 0)
    below = folds.leaves(chained(declared), graph.contain, nodes, roots=chained(rest))
    supplying = supplied(rest).select(F.col("object_id").alias("_n"), F.col("name").alias("_name"), F.col("key").alias("needs"))
    summed = cut(below.unionByName(owning(rest)).join(supplying, (F.col("leaf") == F.col("_n")) & (F.col("leaf_key") == F.col("_name")), "left").drop("_n", "_name"))
    pending = roots(rest)
    while not pending.isEmpty():
        open_ = pending.select(F.col("root").alias("leaf"), F.col("root_key").alias("needs"))
        blocked = summed.where("needs is not null").join(open_, ["leaf", "needs"], "left_semi").select("root", "root_key").distinct()
        ready = cut(pending.join(blocked, ["root", "root_key"], "left_anti"))
        if ready.isEmpty():
            raise ValueError("derived properties depend on each other in a circle")
        tally = found(ready, summed.join(ready, ["root", "root_key"], "left_semi"))
        out = out.unionAll(tally)
        values = values.unionByName(named(tally, declared).select("object_id", "key", "l", "d"))
        pending = pending.join(ready, ["root", "root_key"], "left_anti")
    return out


def named(tally: DataFrame, declared: DataFrame) -> DataFrame:
    """(object_id, key, l, d) of tallies under all their names."""
    counted = declared.select("object_id", "key", F.col("child_key").isNotNull().alias("_counts"))
    null = F.lit(None).cast("double")
    item = lambda key, l, d: F.struct(key.alias("key"), l.alias("l"), d.alias("d"))  # noqa: E731, E741
    value = item(F.col("key"), F.col("l"), F.col("d"))
    counts = [item(F.concat("key", F.lit(f".{c}")), F.col(c), null) for c in ("known", "total")]
    items = F.when(F.col("_counts"), F.array(value, *counts)).otherwise(F.array(value))
    rows = tally.join(counted, ["object_id", "key"]).select("object_id", F.explode(items).alias("_v")).select("object_id", "_v.*")
    return rows.where("l is not null or d is not null")


def property_rows(values: DataFrame, source_id: int) -> DataFrame:
    """Numbers (object_id, key, l, d) as rows of ``properties``."""
    kind = F.when(F.col("l").isNotNull(), "LONG").otherwise("DOUBLE").alias("vtype")
    return values.select("object_id", "key", kind, "l", "d", F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("t"), F.lit(source_id).alias("source_id"))


def without_derived(graph: Graph) -> Graph:
    """The graph less what rules wrote into it."""
    return graph if graph.properties is None else graph.with_(properties=graph.properties.where(F.col("source_id") != DERIVED))


def derive(graph: Graph, rules: Sequence[Rule], anew: bool = True) -> Graph:
    """The graph with the values of all rules; ValueError where a rule is not allowed.

    A key that is a column of the objects (``bound``) is read but not derived.
    Where not all is derived ``anew``, what other rules gave stays and is read.
    """
    for rule in rules:
        if rule.key in graph.bound or rule.key in INTRINSIC:
            raise ValueError(f"{rule.key!r} is a column of the objects")
    if anew:
        graph = without_derived(graph)
    declared = cut(declarations(graph, rules))
    wrong = faults(declared, graph.objects, graph.properties).limit(5).collect()
    if wrong:
        raise ValueError(f"not to be derived: {', '.join(map(str, wrong))}")
    if graph.properties is not None:
        names = supplied(declared).select("object_id", F.col("name").alias("key"))
        graph = graph.with_(properties=graph.properties.join(names, ["object_id", "key"], "left_anti"))
    keys = sorted({k for r in rules for k in (*r.own, *([r.children] if r.children else []))})
    if not keys:
        return graph
    names = {n for r in rules for n in (r.key, *((f"{r.key}.known", f"{r.key}.total") if r.children else ()))}
    rows = property_rows(named(tallies(graph, declared, keys, names), declared), DERIVED)
    return graph.with_(properties=rows if graph.properties is None else graph.properties.unionByName(rows))
