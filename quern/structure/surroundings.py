"""Whether something lies around each of many rows, searched in rounds over growing slices of the surroundings.

A row is asked about its surroundings: the 27 grid cells around each cell that it has points in.  A round compares it with a slice of them
only, a share by hash that starts at FIRST expected rows a cell and grows by GROWTH each time; what is answered doesn't go on, what isn't
has met everything at the end.  So the work follows the rows and not the pairs, wherever answers are found early.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

FIRST, GROWTH = 16, 4
#: Rows of either side that meet in one group, expected.
ASKED, MET = 512, 4096
#: Cells with open rows up to which their list goes to all tasks.
_FEW = 200_000
_BITS = (1 << 20) - 1


def _code(cell: list[Column]) -> Column:
    """One number for a cell; far-off cells can share it, which only adds rows to compare."""
    x, y, z = (c.bitwiseAND(F.lit(_BITS).cast("long")) for c in cell)
    return F.shiftleft(x, 40).bitwiseOR(F.shiftleft(y, 20)).bitwiseOR(z)


def _at(p: Column, size: float) -> list[Column]:
    return [F.floor(p[c] / size).cast("long") for c in "xyz"]


def cells(points: Column, size: float) -> Column:
    """The cells of an array of points (x, y, z)."""
    return F.array_distinct(F.transform(points, lambda p: _code(_at(p, size))))


def around(points: Column, size: float) -> Column:
    """The cells that an array of points is in the surroundings of."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    near = lambda p: F.array(*(_code([c + d for c, d in zip(_at(p, size), step, strict=True)]) for step in steps))
    return F.array_distinct(F.flatten(F.transform(points, near)))


def share(*columns: str) -> Column:
    """A number from 0 to 1 by hash: the place of a row in the order in which it is met."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def rounds(asked: DataFrame, others: DataFrame, keys: list[str], compare: Callable, schema: str, close: Callable) -> DataFrame:
    """The rows of asked as ``close`` left them, after all of them were answered or had met all of their surroundings.

    asked: keys, id, cells and what compare needs; others: keys, share, around and what compare needs.  compare(asked, others), two Arrow
    tables, returns rows of the schema; close(asked, those) returns the asked rows that are still open or keeps what is known of them.
    """
    at = [*keys, "cell"]
    others = settled(others)
    n = settled(others.select(*keys, F.explode("around").alias("cell")).groupBy(*at).agg(F.count(F.lit(1)).alias("n")))
    low, high = 0, FIRST
    while True:
        there = asked.where("open").withColumn("cell", F.explode("cells")).drop("cells", "open")
        parts = F.ceil((F.least(F.col("n"), F.lit(high)) - low) / MET).cast("int")
        held = settled(there.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("chunks")).join(n, at).where(F.col("n") > low).withColumn("parts", parts))
        few = held.count()
        if not few:
            return asked
        held = F.broadcast(held) if few <= _FEW else held
        group = [*at, "chunk", "part"]
        left = there.join(held, at).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("n", "chunks", "parts")
        met = others.withColumn("cell", F.explode("around")).drop("around").join(held, at).withColumn("met", F.col("share") * F.col("n")).where((F.col("met") >= low) & (F.col("met") < high))
        met = met.withColumn("part", F.floor((F.col("met") - low) / MET).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("n", "chunks", "parts", "met", "share")
        left, met = (t.select(*(F.col(c).alias(c) for c in t.columns)) for t in (left, met))  # both can come from one table
        asked = close(asked, left.groupBy(*group).cogroup(met.groupBy(*group)).applyInArrow(compare, schema))
        low, high = high, high * GROWTH
