"""Folds kept up by differences: what changed goes out of the tallies and comes in anew.

``edges`` says which values each declared fold sums up, chains followed
(``folds.leaves``), so a value that changed reaches every fold above it in one
join, however deep, and as often as chains lead there. Sums are tallies that
can be taken back exactly (``functions.sums``); of MAX and MIN those folds are
counted again that a change reaches, from the values under them alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sums
from ..functions.lineage import cut
from . import folds

BY = ["object_id", "key"]
EDGE = ["root", "root_key", "fold", "leaf", "leaf_key"]


@dataclass(frozen=True)
class Folded:
    """State of folds: (object_id, key, range, sums..) of sums, and (object_id, key, fold, l, d, known, total) of the others."""

    tallies: DataFrame
    extremes: DataFrame

    def values(self) -> DataFrame:
        """(object_id, key, l, d, known, total)."""
        return sums.value(self.tallies, BY).unionByName(self.extremes.drop("fold"))


def _summands(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(object_id, key, fold, l, d) of edges, by values (object_id, key, l, d); unknown where there is none."""
    read = values.select(F.col("object_id").alias("_v"), F.col("key").alias("_k"), "l", "d")
    joined = edges.join(read, (F.col("leaf") == F.col("_v")) & (F.col("leaf_key") == F.col("_k")), "left")
    return joined.select(F.col("root").alias("object_id"), F.col("root_key").alias("key"), "fold", "l", "d")


def begin(edges: DataFrame, values: DataFrame) -> Folded:
    rows = _summands(edges, values)
    return Folded(cut(sums.tally(sums.contributions(rows.where("fold = 'SUM'"), BY), BY)), cut(folds.extremes(rows.where("fold <> 'SUM'"))))


def value_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(object_id, key, o, n) of values (object_id, key, l, d) that differ; null where there is none."""
    item = lambda frame, name: frame.select("object_id", "key", F.struct("l", "d").alias(name))
    text = lambda c: F.concat_ws("|", F.coalesce(F.col(f"{c}.l").cast("string"), F.lit("")), F.coalesce(F.col(f"{c}.d").cast("string"), F.lit("")))
    return item(before, "o").join(item(after, "n"), BY, "full").where(text("o") != text("n"))


def uphold(state: Folded, edges: DataFrame, changes: DataFrame, values: DataFrame, went: DataFrame | None = None, came: DataFrame | None = None) -> Folded:
    """The state after ``changes`` (object_id, key, o, n) of values.

    ``edges`` are those after the batch, ``values`` the values after it (read
    for MAX and MIN of what changed). ``went`` and ``came`` are edges that the
    batch took away and added, where containment or declarations changed; a
    value under an edge that went is the old one.
    """
    met = edges if came is None else edges.join(came.distinct(), EDGE, "left_anti")
    told = changes.select(F.col("object_id").alias("leaf"), F.col("key").alias("leaf_key"), "o", "n")
    around = cut(met.join(told, ["leaf", "leaf_key"]).select(F.col("root").alias("object_id"), F.col("root_key").alias("key"), "fold", "o", "n"))
    side = lambda frame, c: frame.select(*BY, "fold", F.col(f"{c}.l").alias("l"), F.col(f"{c}.d").alias("d"))
    signed = [(side(around, "o"), -1), (side(around, "n"), 1)]
    touched = around.select(*BY, "fold")
    if went is not None:
        old = changes.select("object_id", "key", "o.l", "o.d").unionByName(values.join(changes.select(*BY), BY, "left_anti").select("object_id", "key", "l", "d"))
        signed.append((cut(_summands(went, old)), -1))
        touched = touched.unionByName(signed[-1][0].select(*BY, "fold"))
    if came is not None:
        signed.append((cut(_summands(came, values)), 1))
        touched = touched.unionByName(signed[-1][0].select(*BY, "fold"))
    parts = state.tallies
    for rows, sign in signed:
        parts = parts.unionByName(sums.contributions(rows.where("fold = 'SUM'"), BY, sign))
    again = cut(touched.where("fold <> 'SUM'").distinct())
    own = again.select(F.col("object_id").alias("root"), F.col("key").alias("root_key"), "fold")
    counted = folds.extremes(_summands(edges.join(own, ["root", "root_key", "fold"], "left_semi"), values))
    return Folded(cut(sums.tally(parts, BY)), cut(state.extremes.join(again, [*BY, "fold"], "left_anti").unionByName(counted)))
