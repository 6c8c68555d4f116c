"""Predicates for row rules. Each one is TRUE when the row violates the rule.

SQL's three-valued logic makes ``NULL NOT IN (...)`` neither true nor false, so a
plain membership test lets NULL through. The predicates that compare therefore
take ``null_is_violation``; with ``False`` they behave like the bare comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(name: str) -> Column:
    return F.col(name).isNull()


def blank(name: str) -> Column:
    return F.col(name).isNull() | (F.length(name) == 0)


def not_positive(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) <= 0)


def negative(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) < 0)


def outside_range(name: str, above: float, at_most: float) -> Column:
    value = F.col(name)
    return value.isNull() | (value <= above) | (value > at_most)


def outside(name: str, allowed: Sequence[str], null_is_violation: bool = True) -> Column:
    member = F.col(name).isin(*allowed)
    return ~F.coalesce(member, F.lit(False)) if null_is_violation else ~member


def differs(left: str, right: str, null_is_violation: bool = True) -> Column:
    if null_is_violation:
        return ~F.col(left).eqNullSafe(F.col(right))
    return F.col(left) != F.col(right)


def earlier(later: str, reference: str) -> Column:
    """``later`` lies before ``reference``; unknown when either is NULL."""
    return F.col(later) < F.col(reference)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
