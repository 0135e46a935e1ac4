"""Result algebra: true, false, maybe, error, yes, too_far, not_applicable and missing_*."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASSING = ("true", "yes", "too_far", "not_applicable")


def passing(x: Column) -> Column:
    return x.isin(*PASSING)


def normalized(x: Column) -> Column:
    """What ``pass all`` shows: passing values are true, missing_* is false."""
    return F.when(passing(x), "true").when(x.isin("maybe", "error"), x).otherwise("false")


def all_of(*xs: Column) -> Column:
    """false, then error, then maybe, then any other failure (false), else true; empty is true."""
    if not xs:
        return F.lit("true")
    a = F.array(*xs)
    return (
        F.when(F.array_contains(a, "false"), "false").when(F.array_contains(a, "error"), "error").when(F.array_contains(a, "maybe"), "maybe")
        .when(F.exists(a, lambda x: ~passing(x)), "false").otherwise("true")
    )


def any_of(*xs: Column) -> Column:
    """Passing wins, then maybe, then error, else false."""
    if not xs:
        return F.lit("false")
    a = F.array(*xs)
    return F.when(F.exists(a, passing), "true").when(F.array_contains(a, "maybe"), "maybe").when(F.array_contains(a, "error"), "error").otherwise("false")


def negated(x: Column) -> Column:
    return F.when(x.isin("maybe", "error"), x).when(passing(x), "false").otherwise("true")


def from_bool(x: Column) -> Column:
    return F.when(x, "true").otherwise("false")
