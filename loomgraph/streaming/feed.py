"""Feeds under Structured Streaming: one state per source, with its entries.

Each micro-batch gives a source its new words in the order of ``seq``. What
comes out are actions: MATERIALIZE an observation, FORGET an entry, or STATE
of the feed. Completeness is declared by COMPLETE words and not by event time,
so there is no watermark and nothing is late: an observation after COMPLETE
belongs to the next round.

A source's entries are one state value. For sources too large for that use the
batch form (``operators.feed``) in ``foreachBatch`` over stored words.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ACTION = "source_id int, seq long, action string, external_id string, version string, scope int, payload string"
STATE = "state string"
LOADING, CONVERGED, STALE = "LOADING", "CONVERGED", "STALE"


def initial() -> dict:
    """Entries: external id to [version, scope, last round it was seen in]; rounds: completions by scope."""
    return {"entries": {}, "rounds": {}, "stale": False, "complete": False, "said": LOADING}


def advance(state: dict, words: Iterable[dict], source_id: int) -> Iterator[tuple]:
    """Take words in order; what each leads to. Of observations between other words only the last of an id counts."""
    pending: dict[str, dict] = {}

    def settle() -> Iterator[tuple]:
        for ext, w in pending.items():
            scope, now = w["scope"], state["rounds"].get(str(w["scope"]), 0)
            entry = state["entries"].get(ext)
            state["entries"][ext] = [w["version"], scope, now]
            if entry is None or entry[1] != scope or w["version"] is None or entry[0] != w["version"]:
                yield source_id, w["seq"], "MATERIALIZE", ext, w["version"], scope, w["payload"]
        pending.clear()

    for w in words:
        word = w["word"]
        if word == "OBSERVED":
            # The last one is the one that is applied, in its own place.
            pending.pop(w["external_id"], None)
            pending[w["external_id"]] = w
            continue
        yield from settle()
        if word == "REMOVED":
            if state["entries"].pop(w["external_id"], None) is not None:
                yield source_id, w["seq"], "FORGET", w["external_id"], None, w["scope"], None
        elif word == "UNAVAILABLE":
            state["stale"] = True
        elif word == "AVAILABLE":
            state["stale"] = False
        elif word == "COMPLETE" and not state["stale"]:
            state["complete"] = True
            key = str(w["scope"])
            done = state["rounds"].get(key, 0)
            state["rounds"][key] = done + 1
            # What was not seen in the round that ends now goes.
            for ext in [e for e, (_, s, r) in state["entries"].items() if s == w["scope"] and r < done]:
                del state["entries"][ext]
                yield source_id, w["seq"], "FORGET", ext, None, w["scope"], None
        now = STALE if state["stale"] else CONVERGED if state["complete"] else LOADING
        if now != state["said"]:
            state["said"] = now
            yield source_id, w["seq"], "STATE", now, None, None, None
    yield from settle()


def actions(words: DataFrame) -> DataFrame:
    """Actions of a stream of words (source_id, seq, word, external_id, version, scope, payload)."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else initial()
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        rows = rows.astype(object).where(rows.notna(), None)
        out = list(advance(held, rows.to_dict("records"), int(key[0])))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ACTION.split(", ")])

    return words.groupBy("source_id").applyInPandasWithState(step, ACTION, STATE, "append", "NoTimeout")
