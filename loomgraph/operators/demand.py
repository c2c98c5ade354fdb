"""Demand: the detail that clients want of each object, and what follows for sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFF, COARSE, FINE = 0, 1, 2


def levels(objects: DataFrame, interests: DataFrame, overrides: DataFrame) -> DataFrame:
    """(object_id, level): the most that any client wants; everything where there is no client.

    ``interests`` is (client, base), ``overrides`` (client, object_id, level).
    Only objects with an override are looked at one by one; a client that
    overrides an object does not count with its base there.
    """
    bases = (OFF, COARSE, FINE)
    at = lambda k: F.count(F.when(F.col("base") == k, 1))
    # What all clients want is one row; it is read as a value, not joined.
    want = interests.groupBy().agg(F.struct(F.max("base").alias("base"), F.count(F.lit(1)).alias("clients"), *[at(k).alias(f"n{k}") for k in bases]).alias("_want")).scalar()
    # At an overridden object the bases of the other clients count too: the
    # highest base whose clients do not all override the object.
    special = overrides.join(interests, "client").groupBy("object_id").agg(F.max("level").alias("_level"), *[at(k).alias(f"_m{k}") for k in bases]).withColumn("_want", want)
    rest = F.greatest(*[F.when(F.col(f"_m{k}") < F.col(f"_want.n{k}"), k) for k in bases])
    special = special.select("object_id", F.greatest("_level", rest).alias("_special"))
    joined = objects.select("object_id").join(special, "object_id", "left").withColumn("_want", want)
    level = F.when(F.col("_want.clients") == 0, FINE).otherwise(F.coalesce("_special", "_want.base"))
    return joined.select("object_id", level.cast("int").alias("level"))


def set_interests(interests: DataFrame, overrides: DataFrame, changes: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interests and overrides after clients replaced or cleared theirs.

    ``changes`` is (client, base, seq), with a null base where a client is
    forgotten; ``given`` (client, object_id, level, seq) has the overrides that
    came with a change. The last change of a client counts and replaces all
    that the client wanted before.
    """
    last = changes.groupBy("client").agg(F.max_by(F.struct("base"), "seq").alias("_b"), F.max("seq").alias("seq"))
    set_ = last.where("_b.base is not null")
    kept = lambda frame: frame.join(last.select("client"), "client", "left_anti")
    bases = kept(interests).select("client", "base").unionByName(set_.select("client", F.col("_b.base").alias("base")))
    fresh = given.join(set_.select("client", "seq"), ["client", "seq"]).groupBy("client", "object_id").agg(F.max("level").alias("level"))
    return bases, kept(overrides).select("client", "object_id", "level").unionByName(fresh)


def dropped(properties: DataFrame, level: DataFrame, supplied: Mapping[str, int], source_id: int) -> DataFrame:
    """Properties that a source wrote and that lie above their object's level now."""
    limit = F.lit(None).cast("int")
    for key, at in supplied.items():
        limit = F.when(F.col("key") == key, at).otherwise(limit)
    own = properties.where((F.col("source_id") == source_id) & F.col("key").isin(*supplied))
    return own.join(level, "object_id").where(limit > F.col("level")).select("object_id", "key")


def notices(before: DataFrame, after: DataFrame, entries: DataFrame) -> DataFrame:
    """(external_id, level) that sources are told: the new level of each entry whose object's level changed."""
    changed = after.join(before.withColumnRenamed("level", "_old"), "object_id").where("level <> _old")
    return entries.join(changed, "object_id").groupBy("external_id").agg(F.max("level").alias("level"))
