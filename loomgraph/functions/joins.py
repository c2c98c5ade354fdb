"""Semi and anti joins that stay where they are put.

Objects are unions of many tables. Catalyst moves semi and anti joins below
unions, which repeats the other side in every branch, and again for every
nested one. Written as joins with marked distinct ids they stay above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep(frame: DataFrame, ids: DataFrame, column: str, distinct: bool = True) -> DataFrame:
    """Rows whose ``column`` is among the first column of ``ids``; pass ``distinct=False`` if those already are."""
    own = ids.select(F.col(ids.columns[0]).alias("_keep"))
    own = own.distinct() if distinct else own
    return frame.join(own, F.col(column) == F.col("_keep")).drop("_keep")


def drop(frame: DataFrame, ids: DataFrame, column: str, distinct: bool = True) -> DataFrame:
    """Rows whose ``column`` is not among the first column of ``ids``."""
    own = ids.select(F.col(ids.columns[0]).alias("_drop"))
    own = (own.distinct() if distinct else own).withColumn("_gone", F.lit(True))
    return frame.join(own, F.col(column) == F.col("_drop"), "left").where("_gone is null").drop("_drop", "_gone")
