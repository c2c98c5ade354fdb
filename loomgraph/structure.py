"""A graph that is written in tasks and asked by selector.

``run`` collects what a task writes and applies it as one batch: the batch is
checked with queries and takes effect whole or not at all. The state is
DataFrames; a large graph is loaded as such (``Structure(spark, graph)``) and
changed by tables of mutations (``operators.mutations``), a small one can be
built call by call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.joins import drop
from .functions.lineage import cut
from .model import CONTAIN, OBJECT, PROPERTY, Graph, graph_of
from .operators import derived, folds, groupings, guards, links, mutations, placement, reach, strata, views
from .operators.select import matched_ids
from .plans.path import Path
from .streaming.delivery import View

DECLARE = "port_id long, role string, domain string, addresses array<string>, seq long"
NO_SOURCE = 0


class Refused(ValueError):
    """A task asked for something that the graph does not allow; nothing of it was applied."""


class Task:
    """What a task writes. Ids of new objects are there at once."""

    def __init__(self, first_id: int, source_id: int) -> None:
        self.next, self.source_id, self.seq = first_id, source_id, 0
        self.objects: list[tuple] = []
        self.placed: list[tuple] = []
        self.taken: list[tuple] = []
        self.declared: list[tuple] = []
        self.values: list[tuple] = []
        self.removed: list[tuple] = []
        self.moved: list[tuple] = []
        self.externals: dict[int, str | None] = {}

    def _add(self, kind: str, name: str, type: str, external_id=None, node_id=None, from_id=None, to_id=None) -> int:
        if name is None or type is None:
            raise Refused("an object has a name and a type")
        if external_id is not None and not external_id.strip():
            raise Refused("an external id is not blank")
        made, self.next = self.next, self.next + 1
        self.objects.append((made, kind, name, type, external_id, None, node_id, from_id, to_id, False, None, None, None, None))
        self.externals[made] = external_id
        return made

    def create_node(self, name: str, type: str, external_id: str | None = None) -> int:
        return self._add("NODE", name, type, external_id)

    def _port(self, kind: str, node: int, name: str, type: str, node_external_id: str | None) -> int:
        own = self.externals.get(node, node_external_id)
        mark = "<" if kind == "INPUT" else ">"
        return self._add(kind, name, type, None if own is None else f"{own}{mark}{name}", node_id=node)

    def add_input(self, node: int, name: str, type: str, node_external_id: str | None = None) -> int:
        """An input of a node; the external id of a node of an earlier task has to be said."""
        return self._port("INPUT", node, name, type, node_external_id)

    def add_output(self, node: int, name: str, type: str, node_external_id: str | None = None) -> int:
        return self._port("OUTPUT", node, name, type, node_external_id)

    def create_link(self, output: int, input: int, name: str, type: str) -> int:
        return self._add("LINK", name, type, from_id=output, to_id=input)

    def retarget_link(self, link: int, output: int | None = None, input: int | None = None) -> None:
        """Other ends for a link; an end that is not said stays."""
        self.moved.append((link, output, input))

    def contain(self, parent: int, child: int, axis: str) -> None:
        self.placed.append((axis, parent, child))

    def uncontain(self, parent: int, child: int) -> None:
        self.taken.append((parent, child))

    def _declare(self, port: int, role: str, addresses: str | Iterable[str], domain: str) -> None:
        own = [addresses] if isinstance(addresses, str) else list(addresses)
        if any(not a.strip() for a in own):
            raise Refused("an address is not blank")
        self.seq += 1
        self.declared.append((port, role, domain, own, self.seq))

    def provide(self, port: int, addresses: str | Iterable[str], domain: str = "") -> None:
        self._declare(port, "provide", addresses, domain)

    def require(self, port: int, addresses: str | Iterable[str], domain: str = "") -> None:
        self._declare(port, "require", addresses, domain)

    def clear_address(self, port: int) -> None:
        self._declare(port, "provide", [], "")

    def set(self, object_id: int, key: str, value: bool | int | float | str | None) -> None:
        """Set a property; None removes it."""
        if key.startswith("$") or not key.strip():
            raise Refused(f"{key!r} cannot be written")
        kind = None if value is None else "BOOLEAN" if isinstance(value, bool) else "LONG" if isinstance(value, int) else "DOUBLE" if isinstance(value, float) else "TEXT"
        typed = [value if kind == k else None for k in ("LONG", "DOUBLE", "BOOLEAN", "TEXT")]
        self.seq += 1
        self.values.append((object_id, key, kind, *typed, self.source_id, self.seq))

    def remove_property(self, object_id: int, key: str) -> None:
        self.set(object_id, key, None)

    def remove(self, object_id: int) -> None:
        self.removed.append((object_id,))


class Structure:
    def __init__(self, spark: SparkSession, graph: Graph | None = None, first_id: int = 1) -> None:
        self.spark, self.next = spark, first_id
        self.base = graph or graph_of(spark)
        self.declarations = spark.createDataFrame([], DECLARE).drop("seq")
        self.routes: set[tuple[str, str]] = set()
        self.groupings: dict[str, strata.Grouping] = {}
        self.rules: tuple[derived.Rule, ...] = ()
        self.views: dict[str, View] = {}
        # What was worked out from the state: the graph before groups and rules, and whole; and the links drawn, from what.
        self._plain: Graph | None = None
        self._whole: Graph | None = None
        self._drawn: tuple[DataFrame, DataFrame, frozenset] | None = None

    def run(self, task: Callable[[Task], object], source_id: int = NO_SOURCE):
        """Apply what ``task`` writes; what it returns."""
        own = Task(self.next, source_id)
        result = task(own)
        frame = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        base, declarations = self.base, self.declarations
        if own.objects:
            base = base.with_(objects=base.objects.unionByName(frame(own.objects, OBJECT), allowMissingColumns=True))
        if own.moved:
            moves = frame(own.moved, "link_id long, from_id long, to_id long")
            known = self.graph().objects.where("kind = 'LINK' and not coalesce(derived, false)").select("object_id").unionAll(base.objects.where("kind = 'LINK'").select("object_id"))
            self._refuse(drop(moves, known, "link_id"), "only links that were written can be moved")
            base = base.with_(objects=mutations.retarget(base.objects, moves))
        if own.taken:
            gone = frame(own.taken, "parent_id long, child_id long")
            base = base.with_(contain=base.contain.join(gone, ["parent_id", "child_id"], "left_anti").select("axis", "parent_id", "child_id"))
        if own.placed:
            base = base.with_(contain=base.contain.unionByName(frame(own.placed, CONTAIN)).distinct())
        if own.values:
            base = base.with_(properties=mutations.apply(base.properties, frame(own.values, PROPERTY + ", seq long")))
        if own.declared:
            fresh = frame(own.declared, DECLARE)
            last = fresh.groupBy("port_id").agg(F.max_by(F.struct("role", "domain", "addresses"), "seq").alias("d")).select("port_id", "d.*")
            declarations = declarations.join(last.select("port_id"), "port_id", "left_anti").unionByName(last.where(F.size("addresses") > 0))
        if own.removed:
            gone = frame(own.removed, "object_id long")
            self._refuse(guards.removal_faults(gone, self.graph().objects), "what the graph itself made cannot be removed")
            closed = mutations.closure(base.objects, gone)
            base = mutations.remove(base, gone)
            declarations = drop(declarations, closed, "port_id", distinct=False)
        # Only what the task writes is written again.
        parts = {p: cut(getattr(base, p)) for p in ("objects", "contain", "properties") if getattr(base, p) is not getattr(self.base, p)}
        base = base.with_(**parts)
        self._check(base, own)
        if declarations is not self.declarations:
            declarations = cut(declarations)
        elif not parts:
            self.next = own.next
            return result
        before = self.graph() if self.views else None
        only_values = not parts.keys() - {"properties"} and declarations is self.declarations
        self.base, self.declarations, self.next = base, declarations, own.next
        self._whole = None
        self._plain = self._plain.with_(properties=base.properties) if only_values and self._plain is not None else None
        written = reach.Change(None, frame([v[:2] for v in own.values], "object_id long, key string").distinct()) if only_values else None
        self._deliver(before, written)
        return result

    def _deliver(self, before: Graph | None, written: reach.Change | None = None) -> None:
        """Hand the change since ``before`` to the views that follow no stream; ``written`` is it, where nothing is derived."""
        if before is None:
            return
        after = self.graph()
        derives = self.rules or self.groupings
        change = written if written is not None and not derives else reach.between(before, after)
        for view in self.views.values():
            view.take(after, change)

    @staticmethod
    def _refuse(found: DataFrame, what: str) -> None:
        rows = found.limit(5).collect()
        if rows:
            raise Refused(f"{what}: {', '.join(map(str, rows))}")

    def _check(self, base: Graph, own: Task) -> None:
        """Of the kinds of things that were written, the written rows only are held against the graph."""
        frame = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        kinds = {o[1] for o in own.objects}
        made = frame(own.objects, OBJECT)
        if "LINK" in kinds or own.moved:
            written = made.where("kind = 'LINK'").select("object_id", "from_id", "to_id")
            if own.moved:
                moved = frame([(m[0],) for m in own.moved], "object_id long")
                written = written.unionAll(base.objects.where("kind = 'LINK'").select("object_id", "from_id", "to_id").join(moved, "object_id", "left_semi"))
            self._refuse(guards.link_faults(written, base.objects), "a link leads from an output to an input")
        if kinds & {"INPUT", "OUTPUT"}:
            self._refuse(guards.port_faults(made.where("kind <> 'LINK' and kind <> 'NODE'"), base.objects), "a port is on a node")
        if own.objects:
            self._refuse(mutations.identity_faults(base.objects), "external ids are used twice")
            if self.groupings:
                self._refuse(guards.name_faults(made, list(self.groupings)), "a grouping has this name")
        if own.placed:
            nodes = self.graph().objects if self.groupings else base.objects
            self._refuse(guards.placement_faults(frame(own.placed, CONTAIN), base.objects.select("object_id", "kind").union(nodes.select("object_id", "kind")).distinct()), "nodes contain nodes")
            self._refuse(placement.faults(base), "containment is not a forest on each axis")
        if own.values:
            now = self.graph() if self.groupings or self.rules else base
            # What the same task made counts, and what it removed was there to be written.
            there = now.objects.select("object_id", "kind").union(base.objects.select("object_id", "kind")).union(self.base.objects.select("object_id", "kind")).distinct()
            self._refuse(guards.write_faults(frame(own.values, PROPERTY + ", seq long"), there, now.properties), "this cannot be written")

    def allow_route(self, requiring: str, providing: str) -> None:
        self._reroute(self.routes | {(requiring, providing)})

    def deny_route(self, requiring: str, providing: str) -> None:
        self._reroute(self.routes - {(requiring, providing)})

    def _reroute(self, routes: set[tuple[str, str]]) -> None:
        if routes == self.routes:
            return
        before = self.graph() if self.views else None
        self.routes = routes
        self._plain = self._whole = None
        self._deliver(before)

    def _route_rows(self, routes) -> DataFrame | None:
        return self.spark.createDataFrame(sorted(routes), "requiring_domain string, providing_domain string") if routes else None

    def _redraw(self) -> tuple[DataFrame, DataFrame]:
        """What is declared, and the links that follow: drawn once, and after that by what came and went."""
        ports = self.base.objects.where(F.col("kind").isin("INPUT", "OUTPUT"))
        declared = cut(links.declare(ports, self.declarations))
        if self._drawn is None:
            drawn = cut(links.draw(declared, self._route_rows(self.routes)))
        else:
            old, drawn, routes = self._drawn
            went, came = links.declaration_changes(old, declared)
            signed = cut(links.redraw(old, went, came, self._route_rows(routes), self._route_rows(routes - self.routes), self._route_rows(self.routes - routes)))
            drawn = cut(links.apply_signed(drawn, signed))
        self._drawn = (declared, drawn, frozenset(self.routes))
        return declared, drawn

    def graph(self) -> Graph:
        """The graph with what follows from declarations: derived links, addresses of ports, counts of links, axes, nodes of groups, derived properties."""
        if self._plain is None:
            self._plain = self._with_links()
        if self._whole is None:
            self._whole = strata.settle(self._plain, self.rules, list(self.groupings.values())) if self.rules or self.groupings else self._plain
        return self._whole

    def _with_links(self) -> Graph:
        base = self.base
        ports = base.objects.where(F.col("kind").isin("INPUT", "OUTPUT"))
        declared, drawn = self._redraw()
        counts = links.link_counts(ports, base.objects.where("kind = 'LINK'").select("from_id", "to_id").unionAll(drawn.select("from_id", "to_id"))).select(F.col("port_id").alias("_port"), F.col("links").alias("_links"))
        own = self.declarations.select(F.col("port_id").alias("_declared"), F.col("role").alias("_role"), F.col("domain").alias("_domain"), F.array_sort(F.array_distinct("addresses")).alias("_address"))
        axes = base.contain.select(F.col("parent_id").alias("_holder"), F.col("axis").alias("_axis")).distinct()
        objects = base.objects.join(counts, F.col("object_id") == F.col("_port"), "left").join(own, F.col("object_id") == F.col("_declared"), "left").join(axes, F.col("object_id") == F.col("_holder"), "left")
        filled = {"links": F.col("_links"), "role": F.coalesce("_role", "role"), "domain": F.coalesce("_domain", "domain"), "address": F.coalesce("_address", "address"), "axis": F.coalesce("_axis", "axis")}
        objects = objects.withColumns(filled).select(*base.objects.columns).unionByName(links.link_objects(drawn), allowMissingColumns=True)
        return base.with_(objects=cut(objects), declared=declared, routes=self._route_rows(self.routes))

    def matched_object_ids(self, selector: str) -> DataFrame:
        return matched_ids(self.graph(), selector)

    def query(self, selector: str) -> DataFrame:
        return views.query(self.graph(), selector)

    def snapshot_object(self, object_id: int) -> dict[str, str]:
        row = views.snapshot_object(self.graph(), object_id).first()
        if row is None:
            raise KeyError(object_id)
        return row.properties

    def find_by_external_id(self, external_id: str) -> int | None:
        row = self.base.objects.where(F.col("external_id") == external_id).select("object_id").first()
        return row and row.object_id

    def resolve(self, axis: str, path: str) -> int:
        row = placement.resolve(self.base, axis, Path.parse(path)).first()
        return -1 if row is None else row.object_id

    def path_of(self, object_id: int, axis: str) -> str | None:
        row = placement.path_of(self.base, axis).where(F.col("object_id") == object_id).first()
        return row and row.path

    def require(self, object_id: int, *kinds: str) -> None:
        """KeyError for an id of nothing, Refused for an object of another kind."""
        row = self.graph().one(object_id).select("kind").first()
        if row is None:
            raise KeyError(object_id)
        if row.kind not in kinds:
            raise Refused(f"{object_id} is {row.kind}, not {' or '.join(kinds)}")

    def children(self, object_id: int) -> DataFrame:
        self.require(object_id, "NODE")
        return placement.children(self.base, object_id)

    def parents(self, object_id: int) -> DataFrame:
        return placement.parents(self.base, object_id)

    def link_endpoints(self, link_id: int) -> DataFrame:
        self.require(link_id, "LINK")
        return links.endpoints(self.graph()).where(F.col("link_id") == link_id)

    def node_ports(self, node_id: int, kind: str) -> DataFrame:
        self.require(node_id, "NODE")
        return links.node_ports(self.base, node_id, kind)

    def group_by(self, name: str, type: str, selector: str, by: Sequence[str], over: Sequence[tuple[str, str, str]] = ()) -> None:
        """Declare a grouping; ``over`` folds paths over the members of each group."""
        if ":" in name or name in self.groupings:
            raise Refused(f"a grouping cannot be called {name!r}")
        for path in by:
            groupings.KeyPath(path)
        self._refuse(guards.name_faults(self.base.objects, [name]), f"an external id lies under {name!r}")
        self._declare(self.rules, self.groupings | {name: strata.Grouping(name, type, selector, tuple(by), tuple(over))})

    def derive_each(self, name: str, key: str, fold: str, path: str) -> None:
        """Fold a path over the members of each group, those there are and those to come; refused as a whole where one group has the key."""
        own = self.groupings[name]
        if (key, fold, path) in own.over:
            return
        if fold not in folds.FOLDS:
            raise Refused(f"no such fold: {fold}")
        names, taken = {key, f"{key}.known", f"{key}.total"}, own.writes() | set(own.by)
        if key.startswith("$") or names & taken:
            raise Refused(f"{key!r} is a key of the groups of {name!r}")
        groupings.KeyPath(path)
        now = self.graph()
        made = now.nodes().where(F.col("external_id").startswith(f"{name}:") & F.coalesce("derived", F.lit(False))).select("object_id")
        held = now.properties.where(F.col("key").isin(*names) & (F.col("source_id") != NO_SOURCE)).join(made, "object_id", "left_semi")
        self._refuse(held.select("object_id", "key", "source_id"), f"{key!r} has a writer")
        self._declare(self.rules, self.groupings | {name: strata.Grouping(own.name, own.type, own.selector, own.by, (*own.over, (key, fold, path)))})

    def groups(self, name: str) -> DataFrame:
        own = self.groupings[name]
        found = groupings.group_by(self.graph(), own.selector, own.by, own.over)
        return found.withColumns({"type": F.lit(own.type), "external_id": F.concat(F.lit(f"{name}:"), "name")})

    def remove_grouping(self, name: str) -> None:
        if name in self.groupings:
            self._declare(self.rules, {n: g for n, g in self.groupings.items() if n != name})

    def _declare(self, rules: tuple, groups: dict) -> None:
        """Other rules and groupings, whole or not at all; views hear what follows."""
        held = self.rules, self.groupings, self._whole
        before = self.graph() if self.views else None
        self.rules, self.groupings, self._whole = rules, groups, None
        try:
            self.graph()
        except ValueError as e:
            self.rules, self.groupings, self._whole = held
            raise Refused(str(e)) from e
        self._deliver(before)

    def derive(self, rule: derived.Rule) -> None:
        """Declare a derived property; what is declared already, and what is not allowed, changes nothing."""
        if rule not in self.rules:
            self._declare((*self.rules, rule), self.groupings)

    def fold_children(self, key: str, fold: str, axis: str, child_type: str | None = None) -> DataFrame:
        """Fold of a loose property over the children of each node."""
        graph = self.graph()
        own = graph.widened(graph.nodes(), {key})
        own = own if child_type is None else own.where(F.col("type") == child_type)
        return folds.over_children(graph.contain, own.select("object_id", F.col(f"`{key}`.l").alias("l"), F.col(f"`{key}`.d").alias("d")), fold, axis)

    def create_view(self, name: str, selector: str, folder: str, keys: Sequence[str] | None = None, interval: float = 0.0) -> View:
        """A view of the graph: what tasks change is delivered after each, and not more often than every ``interval`` seconds.

        One that is given a stream of writes (``View.start``) follows that instead, from the graph as it is now.
        """
        if name in self.views:
            raise Refused(f"there is a view {name!r}")
        self.views[name] = View(self.graph(), selector, folder, keys, interval=interval, rules=self.rules, groupings=tuple(self.groupings.values()))
        return self.views[name]

    def flush_all(self) -> None:
        """Deliver now what the streams of all views have, and what was held back."""
        for view in self.views.values():
            view.flush()

    def view_ids(self) -> list[str]:
        return sorted(self.views)

    def remove_view(self, name: str) -> None:
        self.views.pop(name).close()
