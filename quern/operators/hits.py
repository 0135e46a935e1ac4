"""Hit search: interval hits grouped by protein, filtered, ranked and matched against domain architectures.

A hit has query_accession, query_database, query_type, target_accession, query_start, query_end (1-based inclusive,
either order), target_start, target_end, evalue, bitscore and bitscore_threshold (text, numeric or not).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accessions import region_id, unversioned
from ..functions.intervals import any_overlap, hi, lo, most_disjoint

PROTEIN = ("query_accession", "query_database")
RANKS = ("domain", "kingdom", "phylum", "class", "order", "family", "genus", "species", "organism")


def eligible(hits: DataFrame) -> DataFrame:
    """Hits without a numeric threshold, or with a score that reaches it; a non-numeric score never does."""
    limit = F.col("bitscore_threshold").try_cast("double")
    score = F.col("bitscore").try_cast("double")
    return hits.where(limit.isNull() | (score >= limit))


def ranked(hits: DataFrame) -> DataFrame:
    """evalue_rank among all targets of the protein; ties share a rank, null e-values come last."""
    by = Window.partitionBy(*PROTEIN, "query_type").orderBy(F.asc_nulls_last("evalue"))
    return hits.withColumn("evalue_rank", F.rank().over(by))


def find_hits(hits: DataFrame, targets: list[str], *, rank: int | None = 1, evalue: float | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Distinct (accession, database, start, end) of eligible hits; every condition holds for one and the same hit.

    The target filter stands above the rank window on purpose: the rank is among all targets.
    """
    out = ranked(eligible(hits)).where(F.col("target_accession").isin(*targets))
    for column, most in (("evalue_rank", rank), ("evalue", evalue)):
        if most is not None:
            out = out.where(F.col(column) <= most)
    if start is not None:
        out = out.where(F.col("query_start") >= start)
    if end is not None:
        out = out.where(F.col("query_end") <= end)
    return out.select(*PROTEIN, "query_start", "query_end").distinct()


def hits_of(hits: DataFrame, keys: DataFrame, database: str | None = None) -> DataFrame:
    """Hits of the proteins in ``keys`` (accession), by a semi-join; the database filter reaches the scan."""
    mine = hits if database is None else hits.where(F.col("query_database") == database)
    return mine.join(keys, F.col("query_accession") == F.col("accession"), "left_semi")


def with_source(matches: DataFrame, manifest: DataFrame, source: str) -> DataFrame:
    """Semi-join on the manifest's (sequence_accession, sequence_database) with the wanted source."""
    keys = manifest.where((F.col("sequence_source") == source) & (F.col("sequence_type") == "protein"))
    return matches.join(keys, (F.col("query_accession") == F.col("sequence_accession")) & (F.col("query_database") == F.col("sequence_database")), "left_semi")


def genomes_of(taxonomy: DataFrame, taxon: str, ranks=RANKS) -> DataFrame:
    """Genomes of which any rank, trimmed and case-folded, is the taxon."""
    there = [c for c in ranks if c in taxonomy.columns]
    folded = F.transform(F.array(*there), lambda x: F.lower(F.trim(x)))
    return taxonomy.where(F.array_contains(folded, taxon.strip().lower())).select("genome").distinct()


def with_taxon(matches: DataFrame, taxonomy: DataFrame, taxon: str) -> DataFrame:
    return matches.join(genomes_of(taxonomy, taxon), F.col("query_database") == F.col("genome"), "left_semi")


def counts(hits: DataFrame, target: str, lowest: int, highest: int | None = None, *, overlaps: bool = True) -> DataFrame:
    """Proteins with lowest..highest hits of the target; without overlaps the largest disjoint set counts."""
    mine = hits.where(unversioned(F.col("target_accession")) == target.split(".")[0])
    spans = F.collect_list(F.struct(lo("query_start", "query_end").alias("lo"), hi("query_start", "query_end").alias("hi")))
    n = F.count(F.lit(1)) if overlaps else most_disjoint(spans)
    out = mine.groupBy(*PROTEIN).agg(n.cast("long").alias("n_hits"))
    return out.where(F.col("n_hits").between(lowest, highest if highest is not None else 2**31))


def envelopes(hits: DataFrame) -> DataFrame:
    """Per protein and target: first and last residue and the span between them."""
    a, b = F.min(lo("query_start", "query_end")), F.max(hi("query_start", "query_end"))
    return hits.groupBy(*PROTEIN, "target_accession").agg(a.alias("first_aa"), b.alias("last_aa"), (b - a + 1).alias("span"))


def anchors(hits: DataFrame) -> DataFrame:
    """Earliest inferred start of the target on each protein: query_start - (target_start - 1), a null target_start being 1."""
    at = F.col("query_start") - (F.coalesce("target_start", F.lit(1)) - 1)
    return hits.groupBy(*PROTEIN, "target_accession").agg(F.min(at).alias("anchor"))


def best_hits(hits: DataFrame, order: str) -> DataFrame:
    """The hit with the highest score of each protein; the first by ``order`` on ties."""
    top = F.max(F.struct(F.col("bitscore"), (-F.col(order)).alias("o"), F.col("target_accession"))).alias("top")
    return hits.groupBy(*PROTEIN).agg(top).select(*PROTEIN, F.col("top.bitscore").alias("bitscore"), F.col("top.target_accession").alias("target_accession"))


@dataclass(frozen=True)
class Domain:
    """A requested domain: ``PF1`` (one or more), ``PF1?``, ``PF1*``, ``PF1+``, ``PF1{2}``, ``PF1{1,3}``."""

    accession: str
    lowest: int = 1
    highest: int | None = None

    @classmethod
    def parse(cls, text: str) -> Domain:
        m = re.fullmatch(r"([^?*+{}]+)(?:([?*+])|\{(\d+)(?:,(\d+))?\})?", text)
        if not m:
            raise ValueError(f"not a domain expression: {text!r}")
        if m[2]:
            return cls(m[1], 1 if m[2] == "+" else 0, 1 if m[2] == "?" else None)
        if m[3]:
            a, b = int(m[3]), int(m[4] or m[3])
            if a > b:
                raise ValueError(f"bounds out of order: {text!r}")
            return cls(m[1], a, b)
        return cls(m[1])


def architectures(hits: DataFrame, wanted: list[str], *, ordered: bool = False, overlaps: bool = False, versioned: bool = False, evalue: float | None = None) -> DataFrame:
    """Proteins whose requested domains satisfy the expressions; proteins with other hits only are candidates too.

    Hits are a set of (accession, lo, hi).  Unordered: the count of each accession lies within the summed bounds of its
    distinct expressions.  Ordered: the hits by (lo, hi) read as the expressions in order, and no two domains share a lo.
    """
    domains = [Domain.parse(w) for w in wanted]
    names = sorted({d.accession for d in domains})
    rows = hits if evalue is None else hits.where(F.col("evalue") <= evalue)
    name = F.col("target_accession") if versioned else unversioned(F.col("target_accession"))
    mine = F.when(name.isin(*names), F.struct(lo("query_start", "query_end").alias("lo"), hi("query_start", "query_end").alias("hi"), name.alias("acc")))
    per = rows.groupBy(*PROTEIN).agg(F.sort_array(F.collect_set(mine)).alias("d"))  # collect_set drops nulls: zero-hit proteins stay
    ok: Column = F.lit(True) if overlaps else ~any_overlap(F.col("d"))
    if ordered:
        ok &= ~F.exists(F.zip_with(F.slice("d", 1, F.greatest(F.size("d") - 1, F.lit(0))), F.slice("d", 2, F.greatest(F.size("d") - 1, F.lit(0))), lambda a, b: (a["lo"] == b["lo"]) & (a["acc"] != b["acc"])), lambda x: x)
        letter = {a: f"{k}," for k, a in enumerate(names)}
        code = F.create_map(*[F.lit(x) for a in names for x in (a, letter[a])])
        text = F.array_join(F.transform("d", lambda x: F.element_at(code, x["acc"])), "")
        regex = "".join(f"(?:{letter[d.accession]}){{{d.lowest},{'' if d.highest is None else d.highest}}}" for d in domains)
        ok &= text.rlike(f"^{regex}$")
    else:
        for a in names:
            mine_ = {d for d in domains if d.accession == a}
            most = None if any(d.highest is None for d in mine_) else sum(d.highest for d in mine_)
            n = F.size(F.filter("d", lambda x: x["acc"] == a))
            ok &= n >= sum(d.lowest for d in mine_)
            if most is not None:
                ok &= n <= most
    return per.where(ok).select(*PROTEIN)


def regions(hits: DataFrame, sequences: DataFrame, target: str, *, lowest: int = 1, highest: int = 1, left: int | None = None, right: int | None = None, left_offset: int = 0, right_offset: int = 0, per_domain: bool = False) -> DataFrame:
    """Sub-sequences (id, sequence) around a protein's hits of the target, and why a protein has none (column problem).

    left and right pick a hit by 1-based index in (lo, hi) order, by default the extremes; offsets are added after that.
    """
    mine = hits.where((F.col("target_accession") == target) | F.col("target_accession").startswith(f"{target}."))
    span = F.struct(lo("query_start", "query_end").alias("lo"), hi("query_start", "query_end").alias("hi"))
    per = mine.groupBy("query_accession").agg(F.sort_array(F.collect_set(span)).alias("d"))
    rows = per.join(sequences.select(F.col("id").alias("query_accession"), "sequence"), "query_accession", "left")
    good = F.size("d").between(lowest, highest)
    if per_domain:
        cut = F.transform("d", lambda x, i: F.struct(x["lo"].alias("a"), x["hi"].alias("b"), (i + 1).alias("n")))
    else:
        a = F.array_min(F.transform("d", lambda x: x["lo"])) if left is None else F.try_element_at("d", F.lit(left))["lo"]
        b = F.array_max(F.transform("d", lambda x: x["hi"])) if right is None else F.try_element_at("d", F.lit(right))["hi"]
        cut = F.array(F.struct(a.alias("a"), b.alias("b"), F.lit(None).cast("int").alias("n")))
    each = rows.select("query_accession", "sequence", good.alias("good"), F.explode(cut).alias("c"))
    first, last = F.col("c.a") + left_offset, F.col("c.b") + right_offset
    inside = (first >= 1) & (last <= F.length("sequence")) & (first <= last)
    problem = F.when(~F.col("good"), "count").when(F.col("sequence").isNull(), "no sequence").when(~F.coalesce(inside, F.lit(False)), "bounds")
    return each.select(
        "query_accession", problem.alias("problem"), F.when(problem.isNull(), region_id(F.col("query_accession"), F.lit(target), first, last, F.col("c.n"))).alias("id"),
        F.when(problem.isNull(), F.expr("substring(sequence, c.a + %d, c.b - c.a + 1 + %d)" % (left_offset, right_offset - left_offset))).alias("sequence"),
    )
