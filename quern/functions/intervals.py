"""Interval expressions: 1-based inclusive coordinates that may be reversed, and signed coordinates without a zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lo(a, b) -> Column:
    return F.least(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def hi(a, b) -> Column:
    return F.greatest(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def contained(start, end, first, last) -> Column:
    """Does [first, last], bounds in either order, hold the hit?"""
    f, t = F.lit(first), F.lit(last)
    return (lo(start, end) >= F.least(f, t)) & (hi(start, end) <= F.greatest(f, t))


def relative(x: Column, anchor: Column) -> Column:
    """Coordinate of x where the anchor is 1 and the residue before it is -1."""
    return F.when(x >= anchor, x - anchor + 1).otherwise(x - anchor)


def absolute(r: Column, anchor: Column) -> Column:
    """Inverse of relative; there is no coordinate 0 (null)."""
    return F.when(r > 0, r + anchor - 1).when(r < 0, r + anchor)


def in_window(r: Column, first: int, last: int) -> Column:
    """Signed position within swappable bounds; 0 is no position."""
    return (r != 0) & r.between(min(first, last), max(first, last))


def most_disjoint(spans: Column) -> Column:
    """Largest number of pairwise disjoint intervals of array<struct<lo, hi>>: earliest end first."""
    by_end = F.array_sort(F.transform(spans, lambda s: F.struct(s["hi"].alias("hi"), s["lo"].alias("lo"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-(2**31)).alias("last"))

    def step(a, s):
        return F.when(s["lo"] > a["last"], F.struct((a["n"] + 1).alias("n"), s["hi"].alias("last"))).otherwise(a)

    return F.aggregate(by_end, start, step, lambda a: a["n"])


def any_overlap(spans: Column) -> Column:
    """Do two intervals of a (lo, hi)-sorted array touch or overlap?  Neighbours suffice."""
    pairs = F.zip_with(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), lambda a, b: a["hi"] >= b["lo"])
    return F.exists(pairs, lambda x: x)
