"""Views kept up to date over a stream of writes, delivered in ordered batches.

A subscriber gets a snapshot first and then differences, each with a sequence
number that grows only when there is something to say. One that fails three
times in a row is told and let go. State is a table per batch in the folder of
the view, so that a batch that is tried again starts from the same state.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..model import Graph
from ..operators import derived, links, mutations, reach, strata, views

MOST_FAILURES = 3
#: Parts of a graph that batches may change.
PARTS = ("objects", "contain", "properties", "declared", "routes")
STATE = "batch long, seq long, " + ", ".join(f"{p} long" for p in PARTS)


def written(graph: Graph, writes: DataFrame) -> Graph:
    """The step for writes to loose properties (object_id, key, vtype, l, d, b, t, source_id, seq)."""
    return graph.with_(properties=mutations.apply(graph.properties, writes))


def stripped(graph: Graph) -> Graph:
    """The graph less the nodes of groups and what rules and groupings wrote."""
    objects = graph.objects.where(~((F.col("kind") == "NODE") & F.coalesce("derived", F.lit(False))))
    own = None if graph.properties is None else graph.properties.where(~F.col("source_id").isin(derived.DERIVED, derived.GROUPED))
    return graph.with_(objects=objects, properties=own)


@dataclass
class Subscription:
    on_batch: Callable[[DataFrame, int, bool], None]
    on_error: Callable[[Exception], None] = lambda e: None
    failures: int = 0
    begun: bool = False


@dataclass
class View:
    """A view over a graph that tasks change (``take``), or that a stream changes, by ``step(graph, batch)``; parts that a step leaves alone are not written.

    ``rules`` and ``groupings`` are worked out again after each batch of a
    stream, and links that declarations draw are redrawn by what came and went.
    ``interval`` is the least time in seconds between two deliveries of tasks;
    what comes before it has passed is held and delivered together, with the
    first task after that or by ``flush``.

    Steps for what feeds emit: ``lambda graph, rows: applied(graph, allowed(graph, rows))`` of ``operators.assembly``.
    """

    graph: Graph
    selector: str
    folder: str
    keys: Sequence[str] | None = None
    seq: int = 0
    subscriptions: list[Subscription] = field(default_factory=list)
    batch: int = -1
    step: Callable[[Graph, DataFrame], Graph] = written
    parts: dict[str, int] = field(default_factory=dict)
    stream: tuple | None = None
    running: object = None
    interval: float = 0.0
    rules: tuple = ()
    groupings: tuple = ()
    held: list[reach.Change] = field(default_factory=list)
    latest: Graph | None = None
    delivered: float = float("-inf")

    def __post_init__(self) -> None:
        """Go on from the last batch in the folder, if there is one."""
        try:
            last = self.graph.spark.read.schema(STATE).parquet(f"{self.folder}/state").orderBy(F.desc("batch")).first()
        except AnalysisException:  # no batch yet
            return
        if last is not None:
            self.batch, self.seq = last.batch, last.seq
            self.parts = {p: last[p] for p in PARTS if last[p] is not None}
            self.graph = self._read(self.graph, self.parts)

    def subscribe(self, on_batch, on_error=lambda e: None) -> Callable[[], None]:
        # Who is there already hears what is held first, so that all go on from one state.
        self._hand_over()
        own = Subscription(on_batch, on_error)
        self.subscriptions.append(own)
        self._deliver(own, views.snapshot(self._now(), self.selector, self.keys), True)
        return lambda: self.subscriptions.remove(own) if own in self.subscriptions else None

    def snapshot(self, on_batch) -> None:
        """The view as it is, to one receiver only; what the stream has goes to all before."""
        self.flush()
        on_batch(views.snapshot(self._now(), self.selector, self.keys), self.seq, True)

    def select(self, selector: str, keys: Sequence[str] | None = None) -> None:
        """Another selector or key filter: everyone gets a new snapshot."""
        if self.latest is not None:
            self.graph, self.held = self.latest, []
        views.members(self._now(), selector)  # refuses what is not a selector before anything changes
        self.selector, self.keys = selector, keys
        for s in list(self.subscriptions):
            self._deliver(s, views.snapshot(self._now(), selector, keys), True)

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        """Take one batch of the stream; one that was taken already changes nothing."""
        if batch_id <= self.batch:
            return
        before = self._now()
        stepped = self._follow(before, self.step(before, rows))
        changed = [p for p in PARTS if getattr(stepped, p) is not getattr(before, p)]
        for p in changed:
            getattr(stepped, p).write.mode("overwrite").parquet(f"{self.folder}/{batch_id}/{p}")
        after = self._read(stepped, dict.fromkeys(changed, batch_id))
        records = reach.delta(before, after, self.selector, reach.between(before, after), self.keys).persist()
        try:
            said = not records.isEmpty()
            parts, seq = self.parts | dict.fromkeys(changed, batch_id), self.seq + said
            state = [(batch_id, seq, *(parts.get(p) for p in PARTS))]
            self.graph.spark.createDataFrame(state, STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
            self.batch, self.seq, self.parts, self.graph = batch_id, seq, parts, after
            if said:
                for s in list(self.subscriptions):
                    self._deliver(s, records, False)
        finally:
            records.unpersist()

    def _follow(self, before: Graph, stepped: Graph) -> Graph:
        """What follows from the changed parts: links, then nodes of groups and derived values."""
        if stepped is before:
            return stepped
        if stepped.declared is not before.declared or stepped.routes is not before.routes:
            stepped = links.redrawn(before, stepped)
        if not (self.rules or self.groupings):
            return stepped
        return strata.settle(stripped(stepped), self.rules, self.groupings)

    def take(self, after: Graph, change: reach.Change) -> None:
        """Take the graph after a task; a view that follows a stream keeps to that."""
        if self.stream is not None:
            return
        self.latest = after
        self.held.append(change)
        if time.monotonic() - self.delivered >= self.interval:
            self._hand_over()

    def _hand_over(self) -> None:
        if not self.held:
            return
        joined: dict = dict.fromkeys(("objects", "properties", "contain"))
        for change in self.held:
            for name, had in joined.items():
                own = getattr(change, name)
                joined[name] = had if own is None else own if had is None else had.unionByName(own).distinct()
        records = cut(reach.delta(self.graph, self.latest, self.selector, reach.Change(**joined), self.keys))
        self.graph, self.held, self.delivered = self.latest, [], time.monotonic()
        if not records.isEmpty():
            self.seq += 1
            for s in list(self.subscriptions):
                self._deliver(s, records, False)

    def _read(self, graph: Graph, parts: dict[str, int]) -> Graph:
        if not parts:
            return graph
        placed = {"levels": {}, "holders": {}} if parts.keys() & {"objects", "contain"} else {}
        return graph.with_(**{p: graph.spark.read.parquet(f"{self.folder}/{n}/{p}") for p, n in parts.items()}, **placed)

    def touch(self, object_id: int) -> None:
        """State all properties of an object again, where the view holds it."""
        now = self._now()
        own = views.members(now, self.selector).where(F.col("object_id") == object_id)
        if own.isEmpty():
            return
        records = views.stated(now, own, self.keys)
        self.seq += 1
        for s in list(self.subscriptions):
            self._deliver(s, records, False)

    def start(self, rows: DataFrame, checkpoint: str, interval: str | None = None):
        """Follow a stream; ``interval`` is the least time between batches, none for on change."""
        sink = rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        self.stream = (rows, checkpoint)
        self.running = (sink.trigger(processingTime=interval) if interval else sink).start()
        return self.running

    def deliver(self, interval: str | None):
        """Another least time between batches, from the next batch on."""
        if self.running is None:
            raise ValueError("the view follows no stream")
        self.running.stop()
        return self.start(*self.stream, interval)

    def flush(self) -> None:
        """Take and deliver now what the stream has, or what tasks left to deliver."""
        if self.running is not None:
            self.running.processAllAvailable()
        else:
            self._hand_over()

    def close(self) -> None:
        if self.running is not None:
            self.running.stop()
        for s in self.subscriptions:
            s.on_error(RuntimeError("the view was removed"))
        self.subscriptions.clear()

    def _now(self) -> Graph:
        return self.graph

    def _deliver(self, own: Subscription, records: DataFrame, snapshot: bool) -> None:
        try:
            own.on_batch(records, self.seq, snapshot)
            own.failures = 0
        except Exception as fault:  # a receiver's fault is the receiver's
            own.failures += 1
            if own.failures >= MOST_FAILURES:
                self.subscriptions.remove(own)
                own.on_error(fault)
