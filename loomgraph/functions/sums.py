"""Sums of doubles that are exact, and so the same in any order and under any partitioning.

A finite double is a whole number times a power of two. Exponents are split
into ranges of 32, and what falls into one range is added as a decimal without
rounding. The few ranges of a group are put together once, rounded once to the
nearest double. NaN and the infinities are counted apart. What was added can
be taken out again without a trace, so a tally is upheld by signed rows.
"""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import wrapped

RANGE = 32
#: A tally has for each of its keys and each ``range`` of exponents one row of sums.
SUMS = ("part", "whole", "doubles", "nan", "up", "down", "known", "total")
WIDE = "decimal(38,0)"


def exponent(x: Column) -> Column:
    """A power of two of which a finite double other than 0 is a whole multiple, small enough for a long."""
    return (F.floor(F.log2(F.abs(x))) - 54).cast("int")


def scaled(x: Column, by: Column) -> Column:
    """``x`` times two to the power ``by``, in two steps that neither overflow nor lose bits."""
    half = F.floor(by / 2)
    power = lambda n: F.pow(F.lit(2.0), n.cast("double"))
    return x * power(half) * power(by - half)


def contributions(rows: DataFrame, by: Sequence[str], sign: Column | int = 1) -> DataFrame:
    """What rows (by.., l, d) add to tallies, or with ``sign`` -1 take out: (by.., range, sums..)."""
    d, l_, n = F.col("d"), F.col("l"), F.lit(sign) if isinstance(sign, int) else sign
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")) & (d != 0)
    q = F.when(finite, exponent(d))
    range_ = F.coalesce(F.floor(q / RANGE), F.lit(0)).cast("int")
    number = scaled(d, -q).cast("long").cast("decimal(20,0)") * F.pow(F.lit(2.0), (q - range_ * RANGE).cast("double")).cast("decimal(10,0)")
    one = lambda when: (F.coalesce(when.cast("int"), F.lit(0)) * n).cast("long")
    sums = {
        "part": F.coalesce(F.when(finite, number), F.lit(0)).cast(WIDE) * n.cast("decimal(1,0)"),
        "whole": F.coalesce(l_, F.lit(0)).cast(WIDE) * n.cast("decimal(1,0)"),
        "doubles": one(d.isNotNull()),
        "nan": one(F.isnan(d) & d.isNotNull()),
        "up": one(d == float("inf")),
        "down": one(d == float("-inf")),
        "known": one(d.isNotNull() | l_.isNotNull()),
        "total": one(F.lit(True)),
    }
    return rows.select(*by, range_.alias("range"), *[c.cast(WIDE if name in ("part", "whole") else "long").alias(name) for name, c in sums.items()])


def tally(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Contributions, and tallies from before, added up; ranges in which nothing is left go."""
    out = parts.groupBy(*by, "range").agg(*[F.sum(c).cast(WIDE if c in ("part", "whole") else "long").alias(c) for c in SUMS])
    return out.where(" or ".join(f"{c} <> 0" for c in SUMS))


def rounded(parts: Column) -> Column:
    """The double nearest to the sum of an array of (range, part)."""

    def nearest(own) -> float | None:
        if own is None or not len(own):
            return None
        low = min(p["range"] for p in own)
        number = sum(int(p["part"]) << RANGE * (p["range"] - low) for p in own)
        power = RANGE * low
        try:
            # Division of whole numbers rounds once, correctly.
            return float(number << power) if power >= 0 else number / (1 << -power)
        except OverflowError:
            return float("inf") if number > 0 else float("-inf")

    def each(items: pd.Series) -> pd.Series:
        return pd.Series([nearest(x) for x in items], dtype="float64")

    return F.pandas_udf(each, "double")(parts)


def value(tallies: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., l, d, known, total) of tallies."""
    counts = [c for c in SUMS if c not in ("part", "whole")]
    each = tallies.groupBy(*by).agg(
        F.sum("whole").alias("whole"), *[F.sum(c).alias(c) for c in counts], F.collect_list(F.when(F.col("part") != 0, F.struct("range", "part"))).alias("parts")
    )
    each = each.withColumn("finite", rounded(F.when(F.col("doubles") > 0, F.col("parts"))))
    some, whole = F.col("doubles") > 0, wrapped(F.col("whole"))
    apart = F.when((F.col("nan") > 0) | ((F.col("up") > 0) & (F.col("down") > 0)), float("nan")).when(F.col("up") > 0, float("inf")).when(F.col("down") > 0, float("-inf"))
    d = F.coalesce(apart, F.coalesce("finite", F.lit(0.0)) + whole.cast("double"))
    return each.select(*by, F.when(~some & (F.col("known") > 0), whole).alias("l"), F.when(some, d).alias("d"), "known", "total")


def summed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., l, d, known, total): SUM of the rows (by.., l, d) of each key."""
    return value(tally(contributions(rows, by), by), by)
