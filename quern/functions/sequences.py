"""Nucleotide and protein sequence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard genetic code, codons in TCAG order.
_BASES = "TCAG"
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# IUPAC complement.
_FROM, _TO = "ACGTUacgtuRYKMBDHVrykmbdhv", "TGCAAtgcaaYRMKVHDByrmkvhdb"


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, _FROM, _TO))


def translate_codons(dna: Column) -> Column:
    """Standard table; stops are ``*``, unknown codons ``X``, a partial last codon is dropped."""
    table = F.create_map(*[F.lit(x) for i, a in enumerate(_CODE) for x in (_BASES[i // 16] + _BASES[i // 4 % 4] + _BASES[i % 4], a)])

    codons = F.regexp_extract_all(F.translate(F.upper(dna), "U", "T"), F.lit("(?s)..."), F.lit(0))  # one pass; cutting by place would walk from the start each time
    return F.coalesce(F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), ""), F.lit(""))


def gc_percent(dna: Column) -> Column:
    """All bases are in the denominator; null for an empty sequence."""
    n = F.length(dna)
    return F.when(n > 0, 100.0 * (n - F.length(F.regexp_replace(dna, "[GCgc]", ""))) / n)


def usable(s: Column, shortest: int, longest: int, letters: str) -> Column:
    """Is the length within the bounds and every letter of the alphabet?"""
    return F.length(s).between(shortest, longest) & (F.translate(s, letters, "") == "")


def slice_1b(s: Column, first: Column, last: Column) -> Column:
    """Residues first..last, clipped to the sequence; empty if they don't meet it."""
    a = F.greatest(first, F.lit(1))
    return F.substring(s, a, F.greatest(F.least(last, F.length(s)) - a + 1, F.lit(0)))


def starts_with_met(s: Column, within: Column) -> Column:
    """1-based positions of M among the first ``within`` residues."""
    letters = F.split(F.substring(s, F.lit(1), within), "")  # one pass
    at = F.filter(F.transform(letters, lambda c, i: F.when(c == "M", i + 1)), lambda i: i.isNotNull())
    return F.coalesce(at, F.array().cast("array<int>"))


def after_last_stop(protein: Column) -> Column:
    return F.element_at(F.split(protein, r"\*", -1), -1)


def strip_organism(description: Column) -> Column:
    return F.regexp_replace(description, r"\s*\[[^\[\]]*\]\s*$", "")


def codon_positions(aa_pos: Column, cds: Column, minus: Column) -> Column:
    """Genomic positions of a residue's three bases; cds: array<struct<s,e>> in ascending genomic order.

    Bases are counted along the strand; null where the coding sequence is too short.
    """
    along = F.when(minus, F.reverse(cds)).otherwise(cds)

    def base(k):
        want = (aa_pos - 1) * 3 + k
        start = F.struct(F.lit(0).alias("done"), F.lit(None).cast("int").alias("at"))

        def step(a, x):
            n = x["e"] - x["s"] + 1
            here = want - a["done"]
            at = F.when(a["at"].isNull() & (here >= 0) & (here < n), F.when(minus, x["e"] - here).otherwise(x["s"] + here)).otherwise(a["at"])
            return F.struct((a["done"] + n).cast("int").alias("done"), at.cast("int").alias("at"))

        return F.aggregate(along, start, step, lambda a: a["at"])

    return F.array(*(base(k) for k in range(3)))
