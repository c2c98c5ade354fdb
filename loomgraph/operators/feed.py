"""Feeds in batch form: coalescing, version de-duplication, sweeps and claims over a log of words.

``words``: (source_id, seq, word, external_id, version, scope[, payload]) with
word one of OBSERVED, REMOVED, COMPLETE, UNAVAILABLE, AVAILABLE. Windows go
over what a source names, over stretches of its words, or over its few words
on completions and availability; no task ever sorts a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH, MOST_STRETCHES = 5_000, 100_000  # words of a stretch on average, and stretches at most
WORD = "source_id int, seq long, word string, external_id string, version string, scope int, payload string"


def stretches(rows: DataFrame) -> Column:
    """The number of the stretch of ``seq`` in which a row of ``rows`` lies."""
    low, high, n = rows.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    count = min(MOST_STRETCHES, max(1, n // STRETCH))
    width = max(1, ((high or 0) - (low or 0)) // count + 1)
    return F.floor((F.col("seq") - F.lit(low or 0)) / width)


def running(rows: DataFrame, flag: Column, parts: Sequence[str], name: str, stretch: Column | None = None) -> DataFrame:
    """``rows`` with the number of flagged rows of the same ``parts`` up to each row's own ``seq``.

    A part may hold most rows, so none is sorted in one task: rows are counted
    in stretches of ``seq``, the counts of the stretches before are summed, and
    only rows of one stretch are put in order together.
    """
    marked = rows.withColumn("_stretch", stretches(rows) if stretch is None else stretch).withColumn("_flag", F.when(flag, 1).otherwise(0))
    own = [F.col(c).alias(f"_p_{c}") for c in parts]
    counts = marked.groupBy(*own, F.col("_stretch").alias("_at")).agg(F.sum("_flag").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_p_{c}" for c in parts]).orderBy("_at")) - F.col("_n")
    counts = counts.select(*[f"_p_{c}" for c in parts], "_at", before.alias("_before"))
    same = F.col("_stretch") == F.col("_at")
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    inside = F.sum("_flag").over(Window.partitionBy(*parts, "_stretch").orderBy("seq"))
    return marked.withColumn("_inside", inside).join(counts, same).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def preceding(rows: DataFrame, fields: Sequence[str], parts: Sequence[str], name: str, stretch: Column) -> DataFrame:
    """``rows`` with a struct of the ``fields`` of the row before, by ``seq``, among those of the same ``parts``; null for the first.

    Only the first and last rows of a part in each stretch are put in order
    over the whole part; a part that holds most rows has few of them.
    """
    inside, whole = Window.partitionBy(*parts, "_stretch").orderBy("seq"), Window.partitionBy(*parts).orderBy("seq")
    marked = rows.withColumn("_stretch", stretch).withColumn("_own", F.struct(*fields))
    marked = marked.withColumn(name, F.lag("_own").over(inside)).withColumn("_last", F.lead("seq").over(inside).isNull())
    edge = F.col(name).isNull() | F.col("_last")
    edges = marked.where(edge).withColumn(name, F.coalesce(name, F.lag("_own").over(whole)))
    return marked.where(~edge).unionByName(edges).select(*rows.columns, name)


def coalesced(words: DataFrame) -> DataFrame:
    """The last observation of each external id between two words of another kind."""
    seen = running(words, F.col("word") != "OBSERVED", ["source_id"], "epoch").where("word = 'OBSERVED'")
    fields = [c for c in words.columns if c not in ("source_id", "external_id", "word")]
    return seen.groupBy("source_id", "external_id", "epoch").agg(F.max_by(F.struct(*fields), "seq").alias("w")).select("source_id", "external_id", "epoch", "w.*")


def completed(words: DataFrame) -> DataFrame:
    """(source_id, scope, seq) of the completions that count: not while the source was unavailable."""
    few = words.where(F.col("word").isin("COMPLETE", "UNAVAILABLE", "AVAILABLE")).select("source_id", "scope", "seq", "word")
    upto = Window.partitionBy("source_id").orderBy("seq")
    state = F.last(F.when(F.col("word") != "COMPLETE", F.col("word")), ignorenulls=True).over(upto)
    return few.withColumn("_state", state).where("word = 'COMPLETE' and coalesce(_state, '') <> 'UNAVAILABLE'").select("source_id", "scope", "seq")


def rounds(words: DataFrame) -> DataFrame:
    """Words, without completions that do not count, with ``round``: the completions of the word's scope so far."""
    done = completed(words).withColumn("word", F.lit("COMPLETE"))
    rows = words.where("word <> 'COMPLETE'").unionByName(done, allowMissingColumns=True)
    return running(rows, F.col("word") == "COMPLETE", ["source_id", "scope"], "round")


def completions(words: DataFrame) -> DataFrame:
    """(source_id, scope, rounds): how often each scope was completed."""
    return completed(words).groupBy("source_id", "scope").agg(F.count(F.lit(1)).alias("rounds"))


LIFE = ["source_id", "external_id"]


def observations(words: DataFrame) -> DataFrame:
    """Observations with what came before: ``materialized`` tells whether the observation is mapped to writes again.

    A thing that is observed all the time is put in order by stretches, never
    in one task.
    """
    marked = rounds(words).where("word in ('OBSERVED', 'REMOVED')")
    rows = preceding(marked, ["word", "version", "scope", "round"], LIFE, "_old", stretches(words)).where("word = 'OBSERVED'")
    old = lambda c: F.col(f"_old.{c}")
    again = (
        # The first, or the first after it was removed.
        F.coalesce(old("word") != "OBSERVED", F.lit(True))
        | F.coalesce(F.col("version") != old("version"), F.lit(True))
        | ~F.col("scope").eqNullSafe(old("scope"))
        # Two completions of its scope since the last time: it was swept in between.
        | (F.col("round") - old("round") >= 2)
    )
    return rows.withColumn("materialized", again).drop("_old")


def runs(seen: DataFrame) -> DataFrame:
    """``seen`` of ``observations`` with ``_run``: how many observations of the thing were mapped so far."""
    return running(seen, F.col("materialized"), LIFE, "_run")


def retried(tried: DataFrame) -> DataFrame:
    """``tried``, of ``runs`` with a flag ``failed`` of those whose mapping fails, and ``materialized`` as that has it.

    A version whose mapping failed is not remembered, so what follows is mapped
    again, until it succeeds or another reason comes. The first success of a
    run decides for all of it, so no run is put in order.
    """
    first = tried.where("not failed").groupBy(*[F.col(c).alias(f"_r_{c}") for c in (*LIFE, "_run")]).agg(F.min("seq").alias("_ok"))
    same = F.lit(True)
    for c in (*LIFE, "_run"):
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    open_yet = F.coalesce(F.col("seq") <= F.col("_ok"), F.lit(True))
    return tried.join(first, same, "left").select(*[c for c in tried.columns if c != "materialized"], (F.col("materialized") | open_yet).alias("materialized")).drop("_run")


def state_changes(words: DataFrame) -> DataFrame:
    """(source_id, seq, state, reason): each state that a feed comes to, in the order of words; it begins LOADING.

    STALE while its source is unavailable, CONVERGED once a round was completed
    while it was not, CLOSED for good. ``reason`` is the payload of the word
    that made it stale.
    """
    few = words.where(F.col("word").isin("COMPLETE", "UNAVAILABLE", "AVAILABLE", "CLOSED"))
    order = Window.partitionBy("source_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    word = F.col("word")
    stale = F.coalesce(F.last(F.when(word.isin("UNAVAILABLE", "AVAILABLE"), word == "UNAVAILABLE"), ignorenulls=True).over(upto), F.lit(False))
    marked = few.withColumn("_stale", stale)
    done = F.max(((word == "COMPLETE") & ~F.col("_stale")).cast("int")).over(upto) == 1
    closed = F.max((word == "CLOSED").cast("int")).over(upto) == 1
    state = F.when(closed, "CLOSED").when(F.col("_stale"), "STALE").when(done, "CONVERGED").otherwise("LOADING")
    before = F.lag("state", 1, "LOADING").over(order)
    told = marked.withColumn("state", state).withColumn("_before", before).where("state <> _before")
    return told.select("source_id", "seq", "state", F.when(F.col("state") == "STALE", F.col("payload")).alias("reason"))


def alive(words: DataFrame, demand: DataFrame | None = None) -> DataFrame:
    """(source_id, external_id, scope, version, payload, seq) of the entries at the end of the log.

    An entry ends when it is removed, or when a round of its scope begins and
    is completed after it was last seen. ``demand`` (source_id, external_id,
    level, raised) tells of the level each entry is wanted at now, OFF being 0,
    and the ``seq`` at which it was last raised, or null: a sweep spares
    entries at OFF, which nobody asks for, and those raised after its round
    began, which the source could not have known to send.
    """
    life = ["source_id", "external_id"]
    seen = words.where("word = 'OBSERVED'")
    fields = [c for c in ("scope", "version", "payload", "seq") if c in words.columns]
    last = seen.groupBy(*life).agg(F.max_by(F.struct(*fields), "seq").alias("w")).select(*life, "w.*")
    gone = words.where("word = 'REMOVED'").groupBy(*life).agg(F.max("seq").alias("_gone"))
    # Of the completions, which are few, the last but one begins the last round.
    order = Window.partitionBy("source_id", "scope").orderBy(F.col("seq").desc())
    begun = completed(words).withColumn("_nth", F.row_number().over(order)).where("_nth = 2").select(F.col("source_id").alias("_s"), F.col("scope").alias("_scope"), F.col("seq").alias("_begun"))
    joined = last.join(gone, life, "left").join(begun, (F.col("source_id") == F.col("_s")) & F.col("scope").eqNullSafe(F.col("_scope")), "left")
    since, spared = F.col("seq"), F.lit(False)
    if demand is not None:
        joined = joined.join(demand.select(*life, F.col("level").alias("_level"), F.col("raised").alias("_raised")), life, "left")
        since, spared = F.greatest("seq", "_raised"), F.coalesce(F.col("_level") == 0, F.lit(False))
    kept = spared | F.coalesce(since > F.col("_begun"), F.lit(True))
    return joined.where(kept & F.coalesce(F.col("seq") > F.col("_gone"), F.lit(True))).select(*life, *fields)


def states(words: DataFrame) -> DataFrame:
    """(source_id, state) at the end: STALE, CONVERGED once a round was completed, else LOADING."""
    last = words.where("word in ('UNAVAILABLE', 'AVAILABLE')").groupBy("source_id").agg(F.max_by("word", "seq").alias("_word"))
    done = completions(words).groupBy("source_id").agg(F.sum("rounds").alias("_rounds"))
    joined = words.select("source_id").distinct().join(last, "source_id", "left").join(done, "source_id", "left")
    state = F.when(F.col("_word") == "UNAVAILABLE", "STALE").when(F.coalesce("_rounds", F.lit(0)) > 0, "CONVERGED").otherwise("LOADING")
    return joined.select("source_id", state.alias("state"))


def claims(entries: DataFrame) -> DataFrame:
    """(object_key, claims): how many alive entries reach each object; ``entries`` has source_id, external_id, object_key."""
    return entries.select("source_id", "external_id", "object_key").distinct().groupBy("object_key").agg(F.count(F.lit(1)).alias("claims"))


def released(before: DataFrame, after: DataFrame) -> DataFrame:
    """Object keys that had claims and have none now."""
    return before.select("object_key").distinct().join(after.select("object_key"), "object_key", "left_anti")
