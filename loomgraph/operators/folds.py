"""Folds: SUM, MAX and MIN over own keys, children and members, with known and total counts.

Sums over children and of derived properties are exact (``functions.sums``).

A summand is a row (.., l, d): a whole number or a double, both null where the
value is unknown. Unknown summands count in the total only. A fold of whole
numbers is a whole number and wraps; one known double makes it a double.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions import sums
from ..functions.values import fold_min_double, fold_sum_long
from ..plans.selector import SelectorError

FOLDS = ("SUM", "MAX", "MIN")


def folded(fold: str, long: Column = None, double: Column = None) -> list[Column]:
    """Aggregates l, d, known, total; exactly one of l and d is set where a summand is known."""
    l_ = F.col("l") if long is None else long
    d = F.col("d") if double is None else double
    any_double = F.count(d) > 0
    mixed = F.coalesce(d, l_.cast("double"))
    if fold == "SUM":
        whole, broken = fold_sum_long(l_), F.sum(mixed)
    elif fold == "MAX":
        whole, broken = F.max(l_), F.max(mixed)
    elif fold == "MIN":
        whole, broken = F.min(l_), fold_min_double(mixed)
    else:
        raise SelectorError(f"no such fold: {fold}")
    return [
        F.when(~any_double, whole).alias("l"),
        F.when(any_double, broken).alias("d"),
        F.count(mixed).alias("known"),
        F.count(F.lit(1)).alias("total"),
    ]


def over_children(contain: DataFrame, summands: DataFrame, fold: str, axis: str | None = None) -> DataFrame:
    """(object_id, l, d, known, total) of each parent; ``summands`` is (object_id, l, d), one row per child that counts."""
    edges = contain if axis is None else contain.where(F.col("axis") == axis)
    joined = edges.select("parent_id", "child_id").join(summands, F.col("child_id") == F.col("object_id"))
    return fold_rows(joined.select(F.col("parent_id").alias("object_id"), "l", "d"), ["object_id"], fold)


def fold_rows(rows: DataFrame, by: Sequence[str], fold: str) -> DataFrame:
    """(by.., l, d, known, total) of summands (by.., l, d); double sums are exact."""
    return sums.summed(rows, by) if fold == "SUM" else rows.groupBy(*by).agg(*folded(fold))


def over_keys(rows: DataFrame, id_col: str, keys: Sequence[tuple[Column | None, Column | None]], fold: str) -> DataFrame:
    """Fold of several values of one row, without an aggregation: each key is (whole, double)."""
    null_l, null_d = F.lit(None).cast("long"), F.lit(None).cast("double")
    items = F.array(*[F.struct((null_l if a is None else a.cast("long")).alias("l"), (null_d if b is None else b.cast("double")).alias("d")) for a, b in keys])
    each = rows.select(F.col(id_col).alias("object_id"), items.alias("_items"))
    value = lambda x: F.coalesce(x["d"], x["l"].cast("double"))
    known = F.filter("_items", lambda x: x["l"].isNotNull() | x["d"].isNotNull())
    broken = F.exists("_items", lambda x: x["d"].isNotNull())
    doubles, wholes = F.transform(known, value), F.transform(known, lambda x: x["l"])
    if fold == "SUM":
        d = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x)
        total = F.aggregate(wholes, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(38,0)")).cast("decimal(38,0)"))
        from ..functions.values import wrapped

        l_ = wrapped(total)
    elif fold == "MAX":
        d, l_ = F.array_max(doubles), F.array_max(wholes)
    else:
        d = F.when(F.exists(doubles, F.isnan), F.lit(float("nan"))).otherwise(F.array_min(doubles))
        l_ = F.array_min(wholes)
    some = F.size(known) > 0
    return each.select("object_id", F.when(some & ~broken, l_).alias("l"), F.when(some & broken, d).alias("d"), F.size(known).cast("long").alias("known"), F.lit(len(keys)).cast("long").alias("total"))


def own_and_children(own: DataFrame, contain: DataFrame, summands: DataFrame, fold: str) -> DataFrame:
    """Fold of own summands (object_id, l, d) and of children together."""
    below = contain.select("parent_id", "child_id").join(summands, F.col("child_id") == F.col("object_id")).select(F.col("parent_id").alias("object_id"), "l", "d")
    # Only what declares the fold, that is what has own summands, is folded.
    roots = own.select("object_id").distinct()
    return fold_rows(own.select("object_id", "l", "d").unionAll(below.join(roots, "object_id", "left_semi")), ["object_id"], fold)


def children(derivations: DataFrame, contain: DataFrame, objects: DataFrame) -> DataFrame:
    """``leaves`` of folds that no chain can take over: the children of the right type, one level down."""
    spec = derivations.select(F.col("object_id").alias("root"), F.col("key").alias("root_key"), "fold", F.col("child_key").alias("leaf_key"), "child_type")
    edges = contain.select("parent_id", "child_id").distinct()
    types = objects.select(F.col("object_id").alias("_o"), F.col("type").alias("_type"))
    step = spec.join(edges, F.col("root") == F.col("parent_id")).join(types, F.col("child_id") == F.col("_o"))
    return step.where("child_type is null or child_type = _type").select("root", "root_key", "fold", F.col("child_id").alias("leaf"), "leaf_key")


def leaves(derivations: DataFrame, contain: DataFrame, objects: DataFrame, levels: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root, root_key, fold, leaf, leaf_key): what declared folds over children sum up, chains followed down.

    ``derivations``: (object_id, key, fold, child_key, child_type) and, where a
    fold also has own summands, the flag ``own``. A child that folds the key
    read with the same fold, and without own summands, gives all its own
    summands in place of its value, whatever its type; others give their value
    where the type fits. A leaf that two chains reach counts twice. Chains are
    followed level by level, as far as they go or ``levels`` deep. Where
    ``roots``, some of the derivations, are given, only theirs are told.
    """
    spec = derivations.select("object_id", "key", "fold", "child_key", "child_type", *(["own"] if "own" in derivations.columns else [F.lit(False).alias("own")]))
    edges = contain.select("parent_id", "child_id").distinct()
    chains = spec.where("not own").select(F.col("object_id").alias("c_id"), F.col("key").alias("c_key"), F.col("fold").alias("c_fold"), F.col("child_key").alias("c_child_key"), F.col("child_type").alias("c_child_type"))
    level = (spec if roots is None else roots).select(F.col("object_id").alias("root"), F.col("key").alias("root_key"), "fold", F.col("object_id").alias("at"), "child_key", "child_type")
    types = objects.select(F.col("object_id").alias("_o"), F.col("type").alias("_type"))
    out = None
    n = 0
    while True:
        step = level.join(edges, F.col("at") == F.col("parent_id")).join(
            chains, (F.col("child_id") == F.col("c_id")) & (F.col("child_key") == F.col("c_key")) & (F.col("fold") == F.col("c_fold")), "left"
        )
        own = (
            step.where("c_id is null")
            .join(types, F.col("child_id") == F.col("_o"))
            .where(F.col("child_type").isNull() | (F.col("child_type") == F.col("_type")))
            .select("root", "root_key", "fold", F.col("child_id").alias("leaf"), F.col("child_key").alias("leaf_key"))
        )
        out = own if out is None else out.unionAll(own)
        n += 1
        if levels is not None and n >= levels:
            return out
        level = step.where("c_id is not null").select("root", "root_key", "fold", F.col("c_id").alias("at"), F.col("c_child_key").alias("child_key"), F.col("c_child_type").alias("child_type"))
        if levels is None:
            level = cut(level)
            if level.isEmpty():
                return out


def nested(derivations: DataFrame, contain: DataFrame, objects: DataFrame, values: DataFrame, levels: int | None = None) -> DataFrame:
    """(object_id, key, l, d, known, total) of declared folds that chain down the hierarchy (``leaves``).

    ``values``: (object_id, key, l, d) of what is written. What children derive
    in other ways than by a chain is read by ``derived.tallies``. One aggregation.
    """
    read = values.select(F.col("object_id").alias("_v"), F.col("key").alias("_k"), "l", "d")
    joined = leaves(derivations, contain, objects, levels).join(read, (F.col("leaf") == F.col("_v")) & (F.col("leaf_key") == F.col("_k")), "left")
    return by_fold(joined)


def by_fold(rows: DataFrame) -> DataFrame:
    """(object_id, key, l, d, known, total) of rows (root, root_key, fold, l, d): each root by its own fold."""
    own = rows.select(F.col("root").alias("object_id"), F.col("root_key").alias("key"), "fold", "l", "d")
    by = ["object_id", "key"]
    out = sums.summed(own.where("fold = 'SUM'"), by)
    return out.unionByName(extremes(own.where("fold <> 'SUM'")).drop("fold"))


def extremes(rows: DataFrame) -> DataFrame:
    """(object_id, key, fold, l, d, known, total) of rows (object_id, key, fold, l, d) whose fold is MAX or MIN, in one aggregation."""
    names = ("l", "d", "known", "total")
    parts = [c.alias(f"{fold}_{name}") for fold in ("MAX", "MIN") for c, name in zip(folded(fold), names, strict=True)]
    grouped = rows.groupBy("object_id", "key", "fold").agg(*parts)
    own = lambda name: F.when(F.col("fold") == "MAX", F.col(f"MAX_{name}")).otherwise(F.col(f"MIN_{name}")).alias(name)
    return grouped.select("object_id", "key", "fold", *map(own, names))


def faults(derivations: DataFrame, objects: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """(fault, object_id, key) of declarations (object_id, key, fold, child_key, child_type) that are not allowed.

    Keys that begin with ``$`` are neither folded nor read; only nodes fold
    children; a key has one declaration; a key that a named source has written
    (``written``: object_id, key, source_id) is not derived.
    """
    own = derivations.select("object_id", "key", "fold", "child_key", "child_type").distinct()
    told = lambda frame, fault: frame.select(F.lit(fault).alias("fault"), "object_id", "key")
    out = told(own.where(F.col("key").startswith("$") | F.col("child_key").startswith("$")), "reserved key")
    out = out.unionAll(told(own.where(~F.col("fold").isin(*FOLDS)), "no such fold"))
    out = out.unionAll(told(own.groupBy("object_id", "key").count().where("count > 1"), "declared twice"))
    kinds = objects.select(F.col("object_id").alias("_o"), "kind")
    out = out.unionAll(told(own.join(kinds, F.col("object_id") == F.col("_o"), "left").where("kind is null or kind <> 'NODE'"), "not a node"))
    if written is not None:
        named = written.where("source_id <> 0").select(F.col("object_id").alias("_w"), F.col("key").alias("_k")).distinct()
        out = out.unionAll(told(own.join(named, (F.col("object_id") == F.col("_w")) & (F.col("key") == F.col("_k"))), "written by a source"))
    return out.distinct()
