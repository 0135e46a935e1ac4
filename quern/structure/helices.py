"""Helices that only a short kink parts: neighbours judged once by their local axes, chains of them merged, segments named anew.

residues: model, chain, number, code (secondary structure, null where unassigned), x, y, z of the Cα atom (null where missing).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

KEYS = ["model", "chain"]


def segments(residues: DataFrame) -> DataFrame:
    """model, chain, code, start, end: runs of one code over consecutive numbers; residues without a code have the code ``?``."""
    r = residues.select(*KEYS, "number", F.coalesce("code", F.lit("?")).alias("code"))
    by = Window.partitionBy(*KEYS).orderBy("number")  # a chain's residues
    new = ~((F.lag("code").over(by) == F.col("code")) & (F.lag("number").over(by) == F.col("number") - 1))
    run = r.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*KEYS, "run", "code").agg(F.min("number").alias("start"), F.max("number").alias("end")).drop("run")


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def local_axes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The local helical axis (unit length, from N to C) of four Cα atoms each (n x 4 x 3), and its problem or None.

    The axis is at right angles to the changes of direction at the two inner atoms.  Problems: coordinates (one is missing or not
    finite), degenerate (the changes are parallel), direction (the axis runs neither way along the four).
    """
    with np.errstate(all="ignore"):
        bend = np.diff(points, 2, axis=1)
        raw, way = np.cross(bend[:, 0], bend[:, 1]), points[:, 3] - points[:, 0]
        norm = np.sqrt((raw * raw).sum(1))
        along = (raw * way).sum(1) / norm
        axis = raw / norm[:, None] * np.where(along > 0, 1.0, -1.0)[:, None]
    problem = np.full(len(points), None, object)
    problem[np.abs(along) < 1e-10] = "direction"
    problem[norm < 1e-10] = "degenerate"
    problem[~np.isfinite(points).all((1, 2))] = "coordinates"
    return axis, problem


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments of residues that come by chain and number; the last segment of a batch waits for the next one."""

    def found(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        last = np.append(first[1:], len(t)) - 1
        xyz = np.stack([t[c].to_numpy() for c in "xyz"], axis=1)
        axes = []
        for at in (first[:, None] + np.arange(4), last[:, None] - np.arange(3, -1, -1)):
            points = xyz[np.clip(at, 0, len(t) - 1)]
            axis, problem = local_axes(points)
            known = np.equal(problem, None) & (last - first >= 3)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(known * 3)).astype("i4"), axis[known].ravel(), mask=pa.array(~known))
            axes += [lists, pa.array(problem, pa.string())]
        begin, end = t.take(first), t["number"].take(last)
        columns = [*(begin[c] for c in (*KEYS, "code", "number")), end, *axes]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema).combine_chunks().to_batches()[0]

    def as_before(a: pa.ChunkedArray) -> np.ndarray:
        x, y = a.slice(1), a.slice(0, len(a) - 1)
        return pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy()

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
        if not len(t):
            continue
        number = t["number"]
        same = pc.fill_null(pc.equal(number.slice(1), pc.add(number.slice(0, len(t) - 1), 1)), False).to_numpy()
        for c in (*KEYS, "code"):
            same = same & as_before(t[c])
        first = np.append(0, np.flatnonzero(~same) + 1)
        if len(first) > 1:
            yield found(t.slice(0, first[-1]), first[:-1])
        rest = t.slice(first[-1])
    if rest is not None and len(rest):
        yield found(rest, np.array([0]))


def _followed(residues: DataFrame) -> DataFrame:
    """The segments of a chain in order, each with the local axes of its first and of its last four residues and what lies before it.

    model, chain, code, start, end; head, head_problem, tail, tail_problem: axes as of local_axes (segments of four residues or more);
    passed, barred: residues of code -, T or S and of other codes but H so far; before: the same of the helix before.  Residues are dealt
    out and sorted once and nothing is joined; windows run over segments.
    """
    r = residues.select(*KEYS, "number", F.coalesce("code", F.lit("?")).alias("code"), *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "xyz"))
    kind = {f.name: f.dataType for f in r.schema}
    axis = [(n, k) for side in ("head", "tail") for n, k in ((side, ArrayType(DoubleType())), (f"{side}_problem", StringType()))]
    schema = StructType([StructField(n, k) for n, k in [*((c, kind[c]) for c in (*KEYS, "code")), ("start", kind["number"]), ("end", kind["number"]), *axis]])
    # Spark's names, Arrow's kinds: those of the keys are taken from the first batch
    kinds = [pa.list_(pa.float64()), pa.string()] * 2

    def runs(batches):
        first = next(batches, None)
        if first is not None:
            at = first.schema
            arrow = [at.field(c).type for c in (*KEYS, "code", "number", "number")] + kinds
            yield from _runs((b for part in ((first,), batches) for b in part), pa.schema(list(zip(schema.names, arrow, strict=True))))

    s = r.repartition(*KEYS).sortWithinPartitions(*KEYS, "number").mapInArrow(runs, schema)
    by = Window.partitionBy(*KEYS).orderBy("start")  # a chain's segments
    size, good, helix = F.col("end") - F.col("start") + 1, F.col("code").isin("-", "T", "S"), F.col("code") == "H"
    so_far = lambda which: F.sum(F.when(which, size).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    s = s.select("*", so_far(good).alias("passed"), so_far(~good & ~helix).alias("barred"))
    before = F.last(F.when(helix, F.struct("start", "end", "tail", "tail_problem", "passed", "barred")), True)
    return s.withColumn("before", before.over(by.rowsBetween(Window.unboundedPreceding, -1)))


def _judged(runs: DataFrame, connector: int, angle: float) -> DataFrame:
    """runs with pair (it is a helix behind a short connector), problem, degrees and merged."""
    if connector < 1 or not 0 < angle <= 180:
        raise ValueError("a connector is at least 1 residue long and an angle above 0 and at most 180 degrees")
    gap = F.col("start") - F.col("before.end") - 1
    connected = (gap >= 1) & (gap <= connector) & (F.col("passed") - F.col("before.passed") == gap) & (F.col("barred") == F.col("before.barred"))
    short = (F.col("before.end") - F.col("before.start") < 3) | (F.col("end") - F.col("start") < 3)
    j = runs.withColumn("pair", (F.col("code") == "H") & F.coalesce(connected, F.lit(False)))
    j = j.withColumn("problem", F.when(F.col("pair"), F.when(short, "short").otherwise(F.coalesce("before.tail_problem", "head_problem"))))
    cosine = _dot([F.col("before.tail")[i] for i in range(3)], [F.col("head")[i] for i in range(3)])
    j = j.withColumn("degrees", F.when(F.col("pair") & F.col("problem").isNull(), F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))))
    return j.withColumn("merged", F.coalesce(F.col("degrees") < angle, F.lit(False)))


def judged_kinks(residues: DataFrame, connector: int = 1, angle: float = 70.0) -> DataFrame:
    """model, chain, left_start, left_end, right_start, right_end, degrees, merged, problem: neighbouring helices (code H) with 1 to
    ``connector`` residues between, all of code -, T or S.  They merge if their facing ends bend by less than ``angle`` degrees.
    A chain has each number once."""
    j = _judged(_followed(residues), connector, angle).where("pair")
    return j.select(*KEYS, F.col("before.start").alias("left_start"), F.col("before.end").alias("left_end"), F.col("start").alias("right_start"), F.col("end").alias("right_end"), "degrees", "merged", "problem")


def normalized(residues: DataFrame, connector: int = 1, angle: float = 70.0) -> DataFrame:
    """model, chain, label, code, start, end: the segments once judged helices are merged; the original neighbours are judged, once.

    Segments inside a merged helix go.  Helices are named alpha1, alpha2, ..., and segments of code -, T or S loop1, loop2, ..., in order.
    """
    helix = F.col("code") == "H"
    by = Window.partitionBy(*KEYS).orderBy("start")
    j = _judged(_followed(residues), connector, angle).select(*KEYS, "code", "start", "end", "merged")
    # From a helix that doesn't merge with the one before up to the next such: its end is that of its last helix, and what starts before lies inside.
    j = j.withColumn("g", F.sum(F.when(helix & ~F.col("merged"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    j = j.withColumn("reach", F.max(F.when(helix, F.col("end"))).over(Window.partitionBy(*KEYS, "g")))
    kept = j.where((helix & ~F.col("merged")) | (~helix & (F.col("reach").isNull() | (F.col("start") > F.col("reach"))))).withColumn("end", F.when(helix, F.col("reach")).otherwise(F.col("end")))
    family = F.when(helix, "alpha").when(F.col("code").isin("-", "T", "S"), "loop")
    nth = F.count(family).over(Window.partitionBy(*KEYS, family).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return kept.select(*KEYS, F.concat(family, nth.cast("string")).alias("label"), "code", "start", "end")
