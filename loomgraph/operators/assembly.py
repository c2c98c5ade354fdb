"""Assembly: observations to writes, by a function of the user's, and what the writes make of a graph.

The function gets one observation and an ``Emit`` and says what the graph
should hold for it, by external ids: objects are got or created. Calls run in
parallel over the entries, in Arrow batches; a call that fails gives one row
with its error and none of its writes, and the others go on.

An object stays as long as some alive entry reaches it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import keep
from ..functions.lineage import cut
from ..model import PROPERTY, Graph
from . import feed, mutations

OFF, COARSE, FINE = 0, 1, 2
WRITE = (
    "source_id int, external_id string, ord int, op string, object string, other string, name string, type string, "
    "axis string, role string, domain string, addresses array<string>, key string, vtype string, l long, d double, b boolean, t string, error string"
)
NAMES = tuple(c.strip().split()[0] for c in WRITE.replace("array<string>", "array").split(","))


class Emit:
    """Collects the writes of one observation; ``level`` is the detail that clients want of it."""

    def __init__(self, source_id: int, external_id: str, level: int = FINE, supplied: Mapping[str, int] | None = None) -> None:
        self.base = {"source_id": source_id, "external_id": external_id}
        self.level, self.supplied = level, supplied or {}
        self.rows: list[dict] = []
        self.kinds: dict[str, str] = {}

    def _add(self, op: str, object: str, **more) -> None:
        if not object or not object.strip():
            raise ValueError("an external id is not blank")
        self.rows.append(self.base | {"op": op, "object": object, "ord": len(self.rows)} | more)

    def _object(self, kind: str, ext: str, **more) -> str:
        if self.kinds.setdefault(ext, kind) != kind:
            raise ValueError(f"{ext} is another kind")
        self._add(kind, ext, **more)
        return ext

    def wanted(self, key: str) -> bool:
        return self.supplied.get(key, OFF) <= self.level

    def node(self, external_id: str, name: str, type: str) -> str:
        return self._object("NODE", external_id, name=name, type=type)

    def input(self, node: str, name: str, type: str) -> str:
        return self._object("INPUT", f"{node}<{name}", other=node, name=name, type=type)

    def output(self, node: str, name: str, type: str) -> str:
        return self._object("OUTPUT", f"{node}>{name}", other=node, name=name, type=type)

    def contain(self, parent: str, child: str, axis: str) -> None:
        self._add("CONTAIN", child, other=parent, axis=axis)

    def provide(self, port: str, addresses: list[str], domain: str = "") -> None:
        self._add("DECLARE", port, role="provide", domain=domain, addresses=list(addresses))

    def require(self, port: str, addresses: list[str], domain: str = "") -> None:
        self._add("DECLARE", port, role="require", domain=domain, addresses=list(addresses))

    def clear_address(self, port: str) -> None:
        self._add("DECLARE", port, addresses=[])

    def set(self, object: str, key: str, value: bool | int | float | str | None) -> None:
        if key.startswith("$"):
            raise ValueError(f"{key} cannot be written")
        if not self.wanted(key):
            return
        kind = None if value is None else "BOOLEAN" if isinstance(value, bool) else "LONG" if isinstance(value, int) else "DOUBLE" if isinstance(value, float) else "TEXT"
        field = {"LONG": "l", "DOUBLE": "d", "BOOLEAN": "b", "TEXT": "t"}.get(kind)
        self._add("SET", object, key=key, vtype=kind, **({field: value} if field else {}))

    def remove_property(self, object: str, key: str) -> None:
        self.set(object, key, None)

    def remove(self, object: str) -> None:
        """Remove an object with its ports and links, whoever made it; nothing where there is none."""
        self._add("REMOVE", object)


Supplied = Mapping[str, int] | Mapping[int, Mapping[str, int]]


def of_source(supplied: Supplied, source_id: int) -> Mapping[str, int]:
    """Levels of properties, be they given for all sources or for each."""
    each = any(isinstance(v, Mapping) for v in supplied.values())
    return supplied.get(source_id, {}) if each else supplied


def materialize(entries: DataFrame, function: Callable[[dict, Emit], None], supplied: Supplied | None = None) -> DataFrame:
    """Writes of all entries (source_id, external_id, .., and a ``level`` if demand is known).

    ``supplied`` has the level from which a property is written, for all
    sources alike or by source (``sources.feeds.supplied``).
    """
    names = entries.columns
    schema = pa.schema([(n, {"source_id": pa.int32(), "ord": pa.int32(), "addresses": pa.list_(pa.string()), "l": pa.int64(), "d": pa.float64(), "b": pa.bool_()}.get(n, pa.string())) for n in NAMES])
    levels = dict(supplied or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for values in zip(*[batch.column(i).to_pylist() for i in range(len(names))], strict=True):
                row = dict(zip(names, values, strict=True))
                level = row.get("level")
                emit = Emit(row["source_id"], row["external_id"], FINE if level is None else level, of_source(levels, row["source_id"]))
                try:
                    function(row, emit)
                    out += emit.rows
                except Exception as fault:  # the function's, told per entry
                    out.append(emit.base | {"op": "ERROR", "ord": 0, "error": f"{type(fault).__name__}: {fault}"})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in NAMES} for r in out], schema=schema)

    return entries.mapInArrow(run, WRITE)


def tried(entries: DataFrame, function: Callable[[dict, Emit], None], supplied: Supplied | None = None) -> DataFrame:
    """``entries`` with ``error``: what their mapping fails with, null where it does not."""
    names, levels = entries.columns, dict(supplied or {})

    def fault(row: dict) -> str | None:
        level = row.get("level")
        try:
            function(row, Emit(row["source_id"], row["external_id"], FINE if level is None else level, of_source(levels, row["source_id"])))
        except Exception as fault:  # the function's, told per entry
            return f"{type(fault).__name__}: {fault}"
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [fault(dict(zip(names, values, strict=True))) for values in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], [*names, "error"])

    return entries.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [*entries.dtypes, ("error", "string")]))


def attempts(words: DataFrame, function: Callable[[dict, Emit], None], supplied: Supplied | None = None) -> DataFrame:
    """The observations that are mapped, with the ``error`` of those that fail; a version that failed is mapped again when it comes again.

    What is mapped anyway is tried first; after a failure, what follows it
    under the same version is tried as well.
    """
    runs = cut(feed.runs(cut(feed.observations(words))))
    first = cut(tried(runs.where("materialized"), function, supplied))
    open_runs = first.where("error is not null").select("source_id", "external_id", "_run")
    more = tried(runs.where("not materialized").join(open_runs, ["source_id", "external_id", "_run"], "left_semi").select(*runs.columns), function, supplied)
    marked = first.unionByName(more).withColumn("failed", F.col("error").isNotNull())
    return feed.retried(marked).where("materialized").drop("materialized", "failed")


def state_writes(changes: DataFrame, function: Callable[[dict, Emit], None], supplied: Supplied | None = None) -> DataFrame:
    """Writes for the state that each feed is in (``feed.state_changes``), by a function as for observations; the entry is ``source:<id>``.

    What is written for a state stands until the next, so the last one of each
    source is mapped.
    """
    last = changes.groupBy("source_id").agg(F.max_by(F.struct("state", "reason", "seq"), "seq").alias("_s")).select("source_id", "_s.*")
    return materialize(last.withColumn("external_id", F.concat(F.lit("source:"), F.col("source_id").cast("string"))), function, supplied)


def rejected(writes: DataFrame) -> DataFrame:
    return writes.where("op = 'ERROR'").select("source_id", "external_id", "error")


def objects(writes: DataFrame) -> DataFrame:
    """(object, kind, name, type, node, claims): what the writes of alive entries reach, and by how many entries."""
    made = writes.where("op in ('NODE', 'INPUT', 'OUTPUT')")
    # Any entry may create an object; the least source and entry names it, whatever the order of rows.
    first = F.min_by(F.struct("op", "name", "type", "other"), F.struct("source_id", "external_id", "ord"))
    found = made.groupBy("object").agg(first.alias("o"), F.countDistinct("source_id", "external_id").alias("claims"))
    return found.select("object", F.col("o.op").alias("kind"), F.col("o.name").alias("name"), F.col("o.type").alias("type"), F.col("o.other").alias("node"), "claims")


def containment(writes: DataFrame) -> DataFrame:
    """(axis, parent, child): the last placement of a child on an axis moves it."""
    last = F.max_by("other", F.struct("source_id", "external_id", "ord"))
    return writes.where("op = 'CONTAIN'").groupBy("axis", F.col("object").alias("child")).agg(last.alias("parent")).select("axis", "parent", "child")


def values(writes: DataFrame) -> DataFrame:
    """(object, key, vtype, l, d, b, t, source_id) after all writes; a removed value is not there."""
    last = F.max_by(F.struct("vtype", "l", "d", "b", "t", "source_id"), F.struct("source_id", "external_id", "ord"))
    return writes.where("op = 'SET'").groupBy("object", "key").agg(last.alias("v")).where("v.vtype is not null").select("object", "key", "v.*")


def declarations(writes: DataFrame) -> DataFrame:
    """(port, role, domain, addresses) of the last declaration of each port."""
    last = F.max_by(F.struct("role", "domain", "addresses"), F.struct("source_id", "external_id", "ord"))
    return writes.where("op = 'DECLARE'").groupBy(F.col("object").alias("port")).agg(last.alias("v")).where(F.size("v.addresses") > 0).select("port", "v.*")


def released(before: DataFrame, after: DataFrame) -> DataFrame:
    """Objects that entries reached and no entry reaches now; a failed entry keeps what it reached."""
    kept = objects(after).select(F.col("object").alias("_now"))
    failed = rejected(after).select(F.col("source_id").alias("_s"), F.col("external_id").alias("_e"))
    held = before.join(failed, (F.col("source_id") == F.col("_s")) & (F.col("external_id") == F.col("_e")), "left_semi")
    gone = objects(before).join(kept, F.col("object") == F.col("_now"), "left_anti")
    return gone.join(objects(held).select(F.col("object").alias("_held")), F.col("object") == F.col("_held"), "left_anti").select("object")


def conflicts(graph: Graph, writes: DataFrame) -> DataFrame:
    """(source_id, external_id, error) of entries whose writes the graph does not allow.

    An external id that the graph has names that object, of that kind; one that
    is new gets the kind that the least entry gives it. An entry fails that
    asks for another kind, for a node of a group, or writes to what neither
    the graph has nor any entry makes.
    """
    made = writes.where("op in ('NODE', 'INPUT', 'OUTPUT')")
    order = F.struct("source_id", "external_id", "ord")
    new = made.groupBy(F.col("object").alias("_ext")).agg(F.min_by("op", order).alias("_new"))
    there = graph.objects.where("external_id is not null").select(F.col("external_id").alias("_ext"), F.col("kind").alias("_old"), F.coalesce("derived", F.lit(False)).alias("_group"))
    asked = writes.where("op not in ('ERROR', 'REMOVE')")
    item = lambda name, want: F.struct(F.col(name).alias("name"), want.alias("want"))
    own = F.when(F.col("op").isin("NODE", "INPUT", "OUTPUT"), F.col("op")).when(F.col("op") == "CONTAIN", "NODE").when(F.col("op") == "DECLARE", "PORT")
    names = asked.select("source_id", "external_id", F.explode(F.array(item("object", own), item("other", F.lit("NODE")))).alias("_n")).select("source_id", "external_id", "_n.*").where("name is not null").distinct()
    # Only the objects that are named are looked at further.
    wanted = cut(names.select(F.col("name").alias("_ext")).distinct())
    known = wanted.join(there, "_ext", "left").join(new, "_ext", "left").select("_ext", F.coalesce("_old", "_new").alias("_kind"), F.coalesce("_group", F.lit(False)).alias("_group"))
    joined = names.join(known, F.col("name") == F.col("_ext"))
    fits = F.col("want").isNull() | (F.col("want") == F.col("_kind")) | ((F.col("want") == "PORT") & F.col("_kind").isin("INPUT", "OUTPUT"))
    error = F.when(F.col("_kind").isNull(), F.concat(F.lit("no such object: "), "name")).when(F.col("_group"), F.concat(F.lit("a group's node: "), "name")).when(~fits, F.concat(F.lit("another kind: "), "name"))
    found = joined.select("source_id", "external_id", error.alias("error")).where("error is not null")
    return found.groupBy("source_id", "external_id").agg(F.min("error").alias("error"))


def allowed(graph: Graph, writes: DataFrame) -> DataFrame:
    """The writes, where an entry with conflicts has a row with its error and none of its writes."""
    failed = cut(conflicts(graph, writes))
    ids = failed.select(F.col("source_id").alias("_s"), F.col("external_id").alias("_e"))
    kept = writes.join(ids, (F.col("source_id") == F.col("_s")) & (F.col("external_id") == F.col("_e")), "left_anti")
    told = failed.select("source_id", "external_id", F.lit(0).alias("ord"), F.lit("ERROR").alias("op"), "error")
    return kept.unionByName(told, allowMissingColumns=True)


def applied(graph: Graph, writes: DataFrame, gone: DataFrame | None = None) -> Graph:
    """The graph with allowed writes; ``gone`` (object) has the external ids that were ``released``.

    Objects are got by external id or created; the id of a new one follows from
    its external id. Of several writes to one thing the greatest (source,
    entry, position) counts; removals come last.
    """
    writes = cut(writes.where("op <> 'ERROR'"))
    made = objects(writes)
    removed = writes.where("op = 'REMOVE'").select("object")
    removed = (removed if gone is None else removed.unionAll(gone.select("object"))).distinct()
    names = reduce(DataFrame.union, [writes.select("object"), writes.select("other").where("other is not null"), removed]).distinct()
    there = graph.objects.where("external_id is not null").select(F.col("external_id").alias("_there"), F.col("object_id").alias("_id"), F.col("kind").alias("_kind"), F.col("type").alias("_type"))
    fresh = F.shiftrightunsigned(F.xxhash64("object"), 4).bitwiseOR(F.lit(1 << 60))
    ids = names.join(there, F.col("object") == F.col("_there"), "left").join(made.drop("claims").withColumnRenamed("object", "_made"), F.col("object") == F.col("_made"), "left")
    ids = cut(ids.select(F.col("object").alias("_name"), F.coalesce("_id", fresh).alias("_object_id"), F.col("_id").isNull().alias("_new"), F.coalesce("_kind", "kind").alias("_kind"), F.coalesce("_type", "type").alias("_type"), "name", "node").where("_kind is not null"))
    of = lambda frame, column, to: frame.join(ids.select(F.col("_name").alias("_n"), F.col("_object_id").alias(to)), F.col(column) == F.col("_n")).drop("_n")
    create = ids.where("_new")
    nodes = ids.select(F.col("_name").alias("_node"), F.col("_object_id").alias("node_id"))
    created = create.join(nodes, F.col("node") == F.col("_node"), "left").select(F.col("_object_id").alias("object_id"), F.col("_kind").alias("kind"), "name", F.col("_type").alias("type"), F.col("_name").alias("external_id"), "node_id")
    placed = of(of(containment(writes), "child", "child_id"), "parent", "parent_id").select("axis", "parent_id", "child_id")
    sets = of(writes.where("op = 'SET'"), "object", "object_id").select("object_id", "key", "vtype", "l", "d", "b", "t", F.col("source_id").cast("int").alias("source_id"), F.struct("source_id", "external_id", "ord").alias("seq"))
    properties = graph.properties if graph.properties is not None else graph.spark.createDataFrame([], PROPERTY)
    last = F.max_by(F.struct("role", "domain", "addresses"), F.struct("source_id", "external_id", "ord"))
    said = writes.where("op = 'DECLARE'").groupBy("object").agg(last.alias("v")).join(ids, F.col("object") == F.col("_name"))
    said = cut(said.select(F.col("_object_id").alias("port_id"), F.col("_kind").alias("kind"), F.col("_type").alias("type"), F.col("v.role").alias("role"), F.col("v.domain").alias("domain"), F.array_distinct("v.addresses").alias("addresses")))
    declared = said.select("port_id", "kind", "type", "role", "domain", F.explode("addresses").alias("address"))
    if graph.declared is not None:
        declared = graph.declared.select("port_id", "kind", "type", "role", "domain", "address").join(said.select("port_id"), "port_id", "left_anti").unionByName(declared)
    after = graph.with_(
        objects=graph.objects.unionByName(created, allowMissingColumns=True), contain=mutations.move(graph.contain, placed), properties=mutations.apply(properties, sets), declared=declared, levels={}, holders={}
    )
    return mutations.remove(after, keep(ids, removed, "_name", distinct=False).select(F.col("_object_id").alias("object_id")))
