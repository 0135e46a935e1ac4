"""Accession expressions: versions, prefixes, region identifiers, safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REGION = r"^(.+)_([^_]+)_([0-9]+)_([0-9]+)(?:_domain_([0-9]+))?$"


def unversioned(x: Column) -> Column:
    return F.split_part(x, F.lit("."), F.lit(1))


def same_or_versioned(x: Column, wanted: str) -> Column:
    """x is the accession itself or a version of it; a dot inside the wanted accession is kept."""
    return (x == wanted) | x.startswith(f"{wanted}.")


def region_id(protein: Column, target: Column, start: Column, end: Column, domain: Column | None = None) -> Column:
    base = F.concat_ws("_", protein, target, start.cast("string"), end.cast("string"))
    return base if domain is None else F.when(domain.isNull(), base).otherwise(F.concat(base, F.lit("_domain_"), domain.cast("string")))


def parse_region(x: Column) -> Column:
    """struct<protein, target, start, end, domain>, null where x doesn't round-trip (leading zeros, start after end)."""
    g = [F.regexp_extract(x, _REGION, i) for i in range(1, 6)]
    start, end, domain = (F.expr("null").cast("int") if c is None else c.try_cast("int") for c in (g[2], g[3], g[4]))
    back = region_id(g[0], g[1], start, end, domain)
    ok = (back == x) & (start >= 1) & (start <= end) & (domain.isNull() | (domain >= 1))
    return F.when(ok, F.struct(g[0].alias("protein"), g[1].alias("target"), start.alias("start"), end.alias("end"), domain.alias("domain")))


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "_")


def leader_id(protein: Column, label: Column) -> Column:
    """``<protein>_with_leader_<label>_M``; in an ``accession|description`` id the suffix goes before the pipe."""
    suffix = F.concat(F.lit("_with_leader_"), label, F.lit("_M"))
    return before_pipe(protein, suffix)


def before_pipe(x: Column, suffix: Column) -> Column:
    at = F.instr(x, "|")
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), suffix, F.substring(x, at, F.length(x)))).otherwise(F.concat(x, suffix))
