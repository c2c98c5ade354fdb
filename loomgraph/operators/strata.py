"""Rules and groupings in one order of dependency.

Each writes keys and reads keys: a rule folds keys into its own with its
counts; a grouping reads the keys of its selector, its key paths and what it
folds, and writes its folds onto the nodes of its groups. What
reads a key comes after what writes it. Rules may read each other, and the
keys they write themselves, as their folds have strata of their own; a
grouping in a circle is refused. Groupings come as early as they can, so that
rules fold over the nodes of groups as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..model import Graph
from ..plans.selector import parse
from . import derived, groupings
from .derived import Rule


@dataclass(frozen=True)
class Grouping:
    """A node of ``type`` for each value of the key paths ``by``; ``over`` lists (key, fold, path) over the members."""

    name: str
    type: str
    selector: str
    by: tuple[str, ...]
    over: tuple[tuple[str, str, str], ...] = ()

    def reads(self) -> set[str]:
        paths = [groupings.KeyPath(p).key for p in (*self.by, *[p for _, _, p in self.over])]
        return {k for k in paths if k} | _keys(self.selector)

    def writes(self) -> set[str]:
        """The folds; key parts are what members have already."""
        return {n for name, _, _ in self.over for n in (name, f"{name}.known", f"{name}.total")}


def _keys(selector: str) -> set[str]:
    return {k for t in parse(selector).walk() for k in t.keys()}


def reads(unit: Rule | Grouping) -> set[str]:
    if isinstance(unit, Grouping):
        return unit.reads()
    return {*unit.own, *([unit.children] if unit.children else []), *_keys(unit.objects)}


def writes(unit: Rule | Grouping) -> set[str]:
    if isinstance(unit, Grouping):
        return unit.writes()
    return {unit.key, *([f"{unit.key}.known", f"{unit.key}.total"] if unit.children else [])}


def strata(rules: Sequence[Rule], groups: Sequence[Grouping]) -> list[list[Rule] | Grouping]:
    """Steps in order: a grouping, or rules that are derived together; ValueError where groupings stand in a circle."""
    units: list[Rule | Grouping] = [*groups, *rules]
    # Nodes of groups are no members, so no grouping reads what another makes, unless through a rule.
    both = lambda u, v: isinstance(u, Grouping) and isinstance(v, Grouping)
    needs = {u: {v for v in units if v is not u and not both(u, v) and writes(v) & reads(u)} for u in units}
    above: dict = {}

    def closed(u) -> set:
        """All that ``u`` depends on, over any number of steps."""
        if u not in above:
            found, open_ = set(), [u]
            while open_:
                for v in needs[open_.pop()]:
                    if v not in found:
                        found.add(v)
                        open_.append(v)
            above[u] = found
        return above[u]

    circle = [g.name for g in groups if g in closed(g)]
    if circle:
        raise ValueError(f"groupings depend on what they make: {', '.join(circle)}")
    out: list[list[Rule] | Grouping] = []
    done: set = set()
    left = list(groups)
    while left:
        ready = next((g for g in left if closed(g) <= done), None)
        if ready is not None:
            out.append(ready)
            done.add(ready)
            left.remove(ready)
            continue
        # The grouping that waits for rules alone, and of these for the fewest.
        waiting = [g for g in left if not any(isinstance(v, Grouping) and v not in done for v in closed(g))]
        first = min(waiting, key=lambda g: len(closed(g) - done))
        own = [r for r in rules if r in closed(first) - done]
        out.append(own)
        done.update(own)
    last = [r for r in rules if r not in done]
    # Rules that a grouping needed are derived again with the rest: they may hold for its nodes, and others read them.
    if last or (rules and out and isinstance(out[-1], Grouping)):
        out.append(list(rules))
    return out


def settle(graph: Graph, rules: Sequence[Rule], groups: Sequence[Grouping] = ()) -> Graph:
    """The graph with the nodes of all groups and the values of all rules, each worked out after what it reads."""
    steps = strata(rules, groups)
    graph = derived.without_derived(graph)
    for n, step in enumerate(steps):
        if isinstance(step, Grouping):
            graph = groupings.as_nodes(graph, step.name, step.type, step.selector, step.by, step.over)
        else:
            graph = derived.derive(graph, step, anew=n + 1 == len(steps))
    return graph
