"""What several operators need: cutting lineage and distributed row numbers."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is
    unset, as in tests on one machine, a temporary folder takes its place.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, cut before, for broadcast if it has at most ``most`` rows, counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_key(docs: DataFrame, text_col: str = "text") -> Column:
    """Digest of a whole row, nulls told from empty; rows of one key are equal in every column."""
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text_col]))
    return F.unhex(F.sha2(F.concat(others, F.coalesce(F.concat(F.lit("="), F.col(text_col).cast("string")), F.lit(""))), 256))


def rank_within(df: DataFrame, parts: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group of ``parts`` from 0 in the order of ``order``.

    A group is never gathered into one task: rows are range-partitioned on
    parts and order together, numbered inside their partition, and shifted by
    the counts of the partitions before. The sorted rows are written first, so
    that the counts and the numbers come from the same partitioning even when
    an executor is lost. Rows that tie on every column may be numbered either
    way; nulls sort first.
    """
    keys = [F.col(c) for c in (*parts, *order)]
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    before = (
        placed.groupBy("_part", *parts)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*parts).orderBy("_part")) - F.col("_n"))
        .select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in parts], "_first", "_before")
    )
    same = F.col("_part") == F.col("_p")
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = placed.join(before, same)
    number = F.col("_before") + F.col("_at") - F.col("_first")
    return joined.select(*df.columns, number.alias(name))


def running(df: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``df`` with ``_place``, from 0 in the order of ``order``, and ``_before_x`` for each value x: its sum over the rows before.

    Rows are range-partitioned, so that no task holds all of them; only the
    totals of the partitions are summed in one place.
    """
    keys = [F.col(c) for c in order]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_t_{v}") for v in values])
    before = whole.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_s{c}") for c in ("_n", *[f"_t_{v}" for v in values])])
    own = Window.partitionBy("_part").orderBy("_at")
    inside = placed.select("*", (F.row_number().over(own) - 1).alias("_r"), *[(F.sum(v).over(own) - F.col(v)).alias(f"_o_{v}") for v in values])
    joined = inside.join(before, F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, (F.col("_r") + F.col("_s_n")).cast("long").alias("_place"), *[(F.col(f"_o_{v}") + F.col(f"_s_t_{v}")).alias(f"_before_{v}") for v in values])
