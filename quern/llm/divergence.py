"""Operator 11, an audit of sources: how far each source's words stray from its language's and from each other source's.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A language keeps the V terms that at least MIN_DOCS
of its documents have; a unit (a language or one of its sources) gives a kept term with count occurrences there
p = 1 + floor(SCALE (count + 2) / (N + 2 V)), N the unit's occurrences of kept terms.  The divergence of p and q is
f = floor((p - q)**2 / (p + q)); all in whole numbers.

**Pairs.**  A term that neither of two sources has counts f(p0, q0), where p0 and q0 are what each gives to an absent term.  So
the sum over all V terms is V f(p0, q0), plus for each source the change by its own terms against the other's p0, plus, for terms
that both have, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).  The second part depends on a term's count alone and goes over the
distinct counts of a source; only the last one joins on terms, and only terms that both sources have.

**Ranks.**  ``top`` finds each group's k-th largest value by radix selection: a histogram over the leading bits names the bin that holds
it, the next bits refine that bin, and rows below it leave.  Equal values are refined alike by the bytes of the item.  What
is sorted within a group in the end are k rows and a last bin of at most LAST_BIN.  ``ranks`` numbers all rows of a group by a histogram of
the same kind: the rows of a bin are numbered among themselves and shifted by the bins before.

Hot sources and languages: words are counted in tasks before they travel; joins of rows to one row a group or language go by a
salt too, so that a hot group's rows are dealt over SALTS tasks.  Terms meet by (language, term), where a group is no
larger than the number of sources.

Edge cases: a null text, lang or source is the empty string; a group without kept terms still has its pairs, and no term rows; where a
language keeps no term all its pairs have value 0; repeated rows count as often as they occur; equal values are ranked by item;
very long texts and terms are read whole; an empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, tidy

MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Bits of a value that one histogram resolves, and rows of a group's last bin that are sorted as they are.
DIGIT_BITS, LAST_BIN = 10, 1000
SALTS = 32
#: Distinct terms that a task counts before it hands them on.
MOST_TERMS = 400_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), c (occurrences), docs (documents with it); a row with a null term for each (lang, source)."""
    bounded_batches(docs.sparkSession)

    @tidy
    def counted(batches):
        terms, within, held = defaultdict(Counter), defaultdict(Counter), 0

        def rows():
            for (lang, source), counts in terms.items():
                seen, keys = within[lang, source], list(counts)
                for k in range(0, len(keys), 50_000):
                    part = keys[k : k + 50_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n), pa.array([source] * n), pa.array(part, pa.binary()), pa.array([counts[t] for t in part], pa.int64()), pa.array([seen[t] for t in part], pa.int64())], names=["lang", "source", "term", "c", "docs"]
                    )

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
                words = text.as_py().translate(_LETTERS).split()
                counts = terms[lang, source]
                before = len(counts)
                counts[None] = 0
                counts.update(words)
                within[lang, source].update(set(words))
                held += len(counts) - before
            if held > MOST_TERMS:
                yield from rows()
                terms, within, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows()

    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).alias("text"))
    found = rows.mapInArrow(counted, "lang string, source string, term binary, c long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def share(c: Column, n: Column, v: Column, scale: int = SCALE) -> Column:
    """p of a term with c occurrences in a unit with n of v kept terms; decimals keep the product exact."""
    whole = (F.lit(scale).cast("decimal(12,0)") * (c + 2).cast("decimal(20,0)"), (n + 2 * v).cast("decimal(20,0)"))
    return F.call_function("div", *whole) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _met(rows: DataFrame, few: DataFrame, on: Sequence[str], spread: str) -> DataFrame:
    """rows joined to few, which has at most some rows for each value of on; a hot value's rows are dealt by a hash of spread."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "salt"]).drop("salt")


def _narrowed(rows: DataFrame, state: DataFrame, by: Sequence[str], digit: Column) -> DataFrame:
    """state, one row a group with the need of rows and their prefix, after one more digit: rows carry live (in the group's bin) and digit."""
    bins = rows.where("live").groupBy(*by, digit.alias("digit")).agg(F.count("*").alias("m"))
    order = Window.partitionBy(*by).orderBy("digit")
    upto = bins.withColumn("upto", F.sum("m").over(order)).withColumn("last", F.max("digit").over(Window.partitionBy(*by)))
    met = upto.join(state, list(by)).where(((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("m") < F.col("need"))) | ((F.col("digit") == F.col("last")) & (F.col("upto") < F.col("need"))))
    return met.select(*by, (F.col("need") - (F.col("upto") - F.col("m"))).alias("need"), F.col("digit").alias("chosen"), F.col("m").alias("held"))


def top(rows: DataFrame, by: Sequence[str], value: str, item: str, k: int = TOP, bits: int = 30, last_bin: int = LAST_BIN) -> DataFrame:
    """The k rows of each group with the largest value (0 to 2**bits - 1), of equal values the first items bytewise, with rank."""
    rounds = -(-bits // DIGIT_BITS)
    state = rows.select(*by).distinct().withColumn("need", F.lit(k).cast("long"))
    rows = rows.withColumn("live", F.lit(True)).withColumn("octets", F.col(item).cast("binary"))
    held = None

    def step(rows, state, digit):
        state = cut(_narrowed(rows, state, by, digit))
        # Live rows before the chosen digit are in, those after it are out, those with it stay live.
        met = _met(rows, state.drop("need", "held"), by, "octets")
        kept = met.where(~F.col("live") | (digit <= F.col("chosen"))).withColumn("live", F.col("live") & (digit == F.col("chosen"))).drop("chosen")
        return cut(kept), state.drop("chosen", "held"), state.agg(F.max("held")).first()[0] or 0

    for r in reversed(range(rounds)):
        # Digits ascend as values descend.
        digit = (1 << DIGIT_BITS) - 1 - F.shiftright(F.col(value), r * DIGIT_BITS).bitwiseAND((1 << DIGIT_BITS) - 1)
        rows, state, held = step(rows, state, digit)
    at, longest = 0, (rows.agg(F.max(F.octet_length("octets"))).first()[0] or 0) if held > last_bin else 0
    while held > last_bin and at <= longest:
        rows, state, held = step(rows, state, F.substring("octets", at + 1, 2))
        at += 2
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), "octets")))
    return ranked.where(F.col("rank") <= k).drop("live", "octets")


def ranks(rows: DataFrame, by: Sequence[str], value: str, item: str, bits: int = 31) -> DataFrame:
    """All rows with rank by value, descending, then item: numbered within bins of the value's leading bits."""
    binned = rows.withColumn("bin", F.shiftright(F.col(value), bits - DIGIT_BITS))
    bins = binned.groupBy(*by, "bin").agg(F.count("*").alias("m"))
    before = bins.select(*by, "bin", (F.sum("m").over(Window.partitionBy(*by).orderBy(F.desc("bin"))) - F.col("m")).alias("before"))
    order = Window.partitionBy(*by, "bin").orderBy(F.desc(value), F.col(item).cast("binary"))
    met = binned.withColumn("at", F.row_number().over(order)).join(before, [*by, "bin"])
    return met.withColumn("rank", (F.col("before") + F.col("at")).cast("int")).drop("bin", "before", "at")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (pair), and the k terms a source favours most (term)."""
    counts = cut(term_counts(docs))
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    # No more rows meet in a window than there are sources.
    every = Window.partitionBy("lang", "term")
    known = counts.where(F.col("term").isNotNull()).withColumn("all_docs", F.sum("docs").over(every)).withColumn("all_c", F.sum("c").over(every))
    kept = cut(known.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "c", "all_c"))
    langs = kept.groupBy("lang", "term").agg(F.sum("c").alias("c")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("all_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    filled = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "all_n"])
    none = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.nullif(F.col("v"), F.lit(0).cast("long")), scale))
    units = cut(filled.select("*", none.alias("p0")))
    given = share(F.col("c"), F.col("n"), F.col("v"), scale).alias("p"), share(F.col("all_c"), F.col("all_n"), F.col("v"), scale).alias("base")
    terms = cut(_met(kept, units, ["lang", "source"], "term").select("lang", "source", "term", "p0", *given))

    # Each p of a source against every other source's p0, and the sources themselves (m null) against each other.
    own = terms.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    own = own.unionByName(units.select("lang", "source", F.col("p0").alias("p"), "p0", F.lit(None).cast("long").alias("m")))
    others = units.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "v")
    met = _met(own, others, ["lang"], "p").where(F.col("source") != F.col("item"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    absent = divergence(p0, q0)
    change = F.when(F.col("m").isNull(), F.coalesce(F.col("v") * absent, F.lit(0))).otherwise(F.col("m") * (divergence(p, q0) - absent))
    alone = met.groupBy("lang", "source", "item", F.col("m").isNull().alias("once")).agg(F.sum(change).alias("value"))
    # Terms that both have, each pair of sources once.
    other = terms.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = terms.select("lang", "term", "source", "p", "p0").join(other, ["lang", "term"]).where(F.col("source") < F.col("item"))
    extra = divergence(p, q) - divergence(p, q0) - divergence(p0, q) + absent
    joint = shared.groupBy("lang", "source", "item").agg(F.sum(extra).alias("value")).withColumn("once", F.lit(False))
    parts = alone.unionByName(joint)
    back = parts.where(~F.col("once")).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = cut(parts.select("lang", "source", "item", "value").unionByName(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    favoured = terms.where(F.col("p") > F.col("base")).select("lang", "source", F.col("term").alias("item"), divergence(p, F.col("base")).alias("value"))
    best = top(cut(favoured), ["lang", "source"], "value", "item", k)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        ranks(pairs, ["lang", "source"], "value", "item").withColumn("part", F.lit("pair")).select(*columns)
        .unionByName(best.withColumn("part", F.lit("term")).withColumn("item", F.col("item").cast("string")).select(*columns))
    )
