"""1.0 coercions and comparison: the first item of a node-set, booleans first, then numbers, then strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import core
from .core import Val


def to_boolean(v: Val) -> Column:
    """A node-set is true if it has a node, a number if it is neither 0 nor NaN, a string if it isn't empty."""
    return F.size(v.col) > 0 if v.many else core.ebv(v)


def to_number(v: Val) -> Column:
    return F.coalesce(core.to_num(v), core.nan())


def to_string(v: Val) -> Column:
    return core.str0(v)


def compare(op: str, a: Val, b: Val) -> Column:
    """The comparison of 1.0 as the compatibility mode has it: of first items; nothing equals an empty side.

    ``<`` compares numbers, ``<=`` adds equality, ``>`` and ``>=`` are their negations.
    """
    if op == "!=":
        return ~compare("=", a, b)
    if op == ">":
        return ~compare("<=", a, b)
    if op == ">=":
        return ~compare("<", a, b)
    a, b = core.one(a), core.one(b)
    x, y = to_number(a), to_number(b)
    less = F.when(F.isnan(x) | F.isnan(y), False).otherwise(x < y)
    if op == "<":
        return less
    if "empty" in (a.kind, b.kind):
        equal = F.lit(False)
    elif "bool" in (a.kind, b.kind):
        equal = to_boolean(a) == to_boolean(b)
    elif "num" in (a.kind, b.kind):
        equal = ~F.isnan(x) & ~F.isnan(y) & (x == y)
    else:
        equal = to_string(a) == to_string(b)
    for v in (a, b):
        if v.kind != "empty":
            equal = F.when(v.col.isNull(), False).otherwise(equal)
    return equal if op == "=" else less | equal
