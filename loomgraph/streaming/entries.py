"""Entries of feeds kept over a stream of words, one row for each alive entry.

The state is a log itself, the shortest that leads to the same entries: of an
alive entry its last observation, of a scope the last two completions that
count, which bound its last round, and of a source whether it is available.
A batch joins the state with its words by (source_id, external_id) and by
scope, with the operators of the batch form, so no task holds a source, and a
sweep is a join with the few scopes that were completed.

Words of a source come in order from batch to batch, in any order within one.
``demand`` tells, at each batch, of the level of entries as ``feed.alive``
has it. What a batch brings goes to ``on_batch`` as (source_id, external_id,
action, scope, version, payload, seq): SEEN for an entry that is new or whose
version or scope is another (or that has no version), GONE for one that ended.
State is a table per batch in ``folder``; after a restart it goes on from the
last one, and a batch that was taken already changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import feed

WORD = "source_id int, seq long, word string, external_id string, version string, scope int, payload string"
NAMES = [c.split()[0] for c in WORD.split(", ")]
LIFE = ["source_id", "external_id"]


def compacted(words: DataFrame, demand: DataFrame | None = None) -> DataFrame:
    """The shortest log from which the same follows as from ``words``."""
    entries = feed.alive(words, demand).withColumn("word", F.lit("OBSERVED"))
    order = Window.partitionBy("source_id", "scope").orderBy(F.col("seq").desc())
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    rounds = feed.completed(words).withColumn("_nth", F.row_number().over(order)).where("_nth <= 2")
    rounds = rounds.select("source_id", "seq", F.lit("COMPLETE").alias("word"), none("external_id", "string"), none("version", "string"), "scope", none("payload", "string"))
    last = words.where("word in ('AVAILABLE', 'UNAVAILABLE')").groupBy("source_id").agg(F.max_by(F.struct(*NAMES[1:]), "seq").alias("w")).select("source_id", "w.*")
    return entries.select(*NAMES).unionByName(rounds.select(*NAMES)).unionByName(last.select(*NAMES))


def actions(before: DataFrame, after: DataFrame) -> DataFrame:
    """What leads from the entries of one state to those of another."""
    old = before.where("word = 'OBSERVED'").select(*LIFE, F.struct("scope", "version", "payload", "seq").alias("o"))
    new = after.where("word = 'OBSERVED'").select(*LIFE, F.struct("scope", "version", "payload", "seq").alias("n"))
    both = old.join(new, LIFE, "full")
    other = F.col("o").isNull() | ~F.col("o.scope").eqNullSafe(F.col("n.scope")) | F.coalesce(F.col("o.version") != F.col("n.version"), F.col("o.seq") != F.col("n.seq"))
    action = F.when(F.col("n").isNull(), "GONE").when(other, "SEEN")
    return both.select(*LIFE, action.alias("action"), F.coalesce("n", "o").alias("w")).where("action is not null").select(*LIFE, "action", "w.*")


@dataclass
class Entries:
    spark: SparkSession
    folder: str
    demand: Callable[[], DataFrame] | None = None
    on_batch: Callable[[DataFrame, int], None] = lambda records, batch: None
    batch: int = -1

    def __post_init__(self) -> None:
        try:
            last = self.spark.read.schema("batch long").parquet(f"{self.folder}/done").agg(F.max("batch")).first()
        except AnalysisException:  # no batch yet
            return
        self.batch = -1 if last[0] is None else last[0]

    def log(self) -> DataFrame:
        if self.batch < 0:
            return self.spark.createDataFrame([], WORD)
        return self.spark.read.schema(WORD).parquet(f"{self.folder}/{self.batch}")

    def alive(self) -> DataFrame:
        """(source_id, external_id, scope, version, payload, seq), as ``feed.alive`` gives them for all words so far."""
        return self.log().where("word = 'OBSERVED'").drop("word")

    def apply(self, words: DataFrame, batch_id: int) -> None:
        if batch_id <= self.batch:
            return
        before = self.log()
        kept = compacted(before.unionByName(words.select(*NAMES)), self.demand() if self.demand else None)
        kept.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}")
        self.spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
        self.batch = batch_id
        self.on_batch(actions(before, self.log()), batch_id)

    def start(self, words: DataFrame, checkpoint: str):
        """Follow a stream of words."""
        return words.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()
