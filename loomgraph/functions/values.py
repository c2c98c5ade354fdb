"""Typed values: a property is a LONG, DOUBLE, BOOLEAN or TEXT, by object.

A ``Cell`` holds one column for each type the value can have; of these one is
not null where the property is there.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.selector import Literal


@dataclass
class Cell:
    long: Column | None = None
    double: Column | None = None
    boolean: Column | None = None
    text: Column | None = None

    def parts(self) -> list[Column]:
        return [c for c in (self.long, self.double, self.boolean, self.text) if c is not None]

    def as_text(self) -> Column:
        return F.coalesce(*[c.cast("string") for c in self.parts()])

    def present(self) -> Column:
        return any_of(c.isNotNull() for c in self.parts())


def sure(predicate: Column) -> Column:
    """Two-valued: what cannot be compared does not match."""
    return F.coalesce(predicate, F.lit(False))


def _leaf(cell: Cell):
    """How the comparison of one part is taken.

    Of a value of one type it may stay null where the value is absent: filters
    take null for false, conjunctions and disjunctions keep it below true, and
    a negation makes its operand two-valued. So a comparison with a bound
    column stays one that the scan understands.
    """
    return (lambda p: p) if len(cell.parts()) == 1 else sure


def any_of(predicates: Iterable[Column]) -> Column:
    out = F.lit(False)
    for p in predicates:
        out = out | p
    return out


def equal(cell: Cell, lit: Literal) -> Column:
    found, take = [], _leaf(cell)
    if cell.long is not None and lit.number is not None:
        found.append(take(cell.long == F.lit(lit.whole).cast("long") if lit.whole is not None else cell.long.cast("double") == F.lit(lit.number)))
    if cell.double is not None and lit.number is not None:
        found.append(take(cell.double == F.lit(float(lit.whole) if lit.whole is not None else lit.number)))
    if cell.boolean is not None:
        found.append(take(cell.boolean.cast("string") == lit.text))
    if cell.text is not None:
        found.append(take(cell.text == lit.text))
    return any_of(found)


def ordered(cell: Cell, op: str, lit: Literal) -> Column:
    def compare(value: Column, other: Column) -> Column:
        return {"<": value < other, "<=": value <= other, ">": value > other, ">=": value >= other}[op]

    found, take = [], _leaf(cell)
    if cell.long is not None:
        found.append(take(compare(cell.long, F.lit(lit.whole).cast("long")) if lit.whole is not None else compare(cell.long.cast("double"), F.lit(lit.number))))
    if cell.double is not None:
        found.append(take(compare(cell.double, F.lit(lit.number)) & ~F.isnan(cell.double)))
    return any_of(found)


def matches(cell: Cell, op: str | None, lit: Literal | None) -> Column:
    if op is None:
        return cell.present()
    if op == "=":
        return equal(cell, lit)
    if op == "!=":
        return cell.present() & ~equal(cell, lit)
    if op == "~":
        return any_of(_leaf(cell)(c.cast("string").contains(lit.text)) for c in cell.parts())
    return ordered(cell, op, lit)


def wrapped(total: Column) -> Column:
    """A decimal total as a 64-bit whole number that wraps around."""
    half, full = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (63, 64))
    shifted = F.pmod(total.cast("decimal(38,0)") + half, full)
    return (shifted - half).cast("long")


def fold_sum_long(value: Column) -> Column:
    return wrapped(F.sum(value.cast("decimal(38,0)")))


def fold_min_double(value: Column) -> Column:
    """Least value, NaN where one is NaN; the built-in minimum would pass over it."""
    return F.when(F.bool_or(F.isnan(value)), F.lit(float("nan"))).otherwise(F.min(value))


def canonical(cell: Cell) -> Column:
    """Text of a typed value from which its type can be told: text that looks like another type is quoted."""
    plain = []
    for c in (cell.long, cell.double, cell.boolean):
        if c is not None:
            plain.append(c.cast("string"))
    if cell.text is not None:
        escaped = F.regexp_replace(cell.text, r'([,\\"])', r"\\$1")
        other = cell.text.rlike(r"^[-+.]?[0-9]") | cell.text.isin("true", "false", "NaN", "Infinity", "-Infinity")
        plain.append(F.when(other, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(escaped))
    return F.coalesce(*plain)
