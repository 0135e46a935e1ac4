"""Queries through rules, channels, genomics and structure operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import channels, rules
from ..functions import intervals, sequences
from ..operators import genomics as G
from ..operators import tables as T
from ..operators.contigs import Contigs, leader_of
from ..structure import classify, contacts, helices
from .registry import HITS, hits, query, read


def _k() -> Column:
    return F.col("o_orderkey")


def _c() -> Column:
    return F.col("o_custkey")


def _text(spark, sf, name="documents", key="doc_id") -> DataFrame:
    return read(spark, sf, name).select(F.col(key).alias("k"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("u"))


_U = "t AS (SELECT doc_id AS k, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS u FROM documents)"
_ALL, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN"
_DNA = f"{_U}, dna AS (SELECT k, translate(u, '{_ALL}', '{_TO}') AS s FROM t)"


def _dna(spark, sf) -> DataFrame:
    return _text(spark, sf).select("k", F.translate("u", _ALL, _TO).alias("s"))


def _digest(c) -> Column:
    return F.md5(F.col(c).cast("binary")).alias("digest")


#: SQL: translation of the DNA text {d}; a stop is *, a codon with another letter X.
def _translated(d: str) -> str:
    code = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    at = " + ".join(f"{w} * (strpos('TCAG', substr({d}, i * 3 + {j}, 1)) - 1)" for j, w in ((1, 16), (2, 4), (3, 1)))
    known = " AND ".join(f"strpos('TCAG', substr({d}, i * 3 + {j}, 1)) > 0" for j in (1, 2, 3))
    return f"array_to_string(list_transform(range(CAST(length({d}) // 3 AS BIGINT)), lambda i: CASE WHEN {known} THEN substr('{code}', CAST(1 + {at} AS INT), 1) ELSE 'X' END), '')"


@query(f"WITH {_DNA} SELECT k, md5({_translated('s')}) AS digest FROM dna")
def g10_translation(spark, sf):
    return _dna(spark, sf).select("k", sequences.translate_codons(F.col("s")).alias("p")).select("k", _digest("p"))


@query(f"""WITH {_DNA}, b AS (SELECT k, CASE WHEN k % 2 = 0 THEN substr(s, 1, CAST(k % 300 + 39 AS INT)) ELSE reverse(translate(substr(s, CAST(k % 300 + 41 AS INT)), 'ACGT', 'TGCA')) END AS before FROM dna),
w AS (SELECT k, substr(before, CAST(length(before) % 3 + 1 AS INT)) AS x FROM b), p AS (SELECT k, split_part({_translated('x')}, '*', -1) AS tail FROM w)
SELECT k, tail, regexp_replace(tail, '^.*M', 'M') AS prefix FROM p""")
def g09_leader_prefix(spark, sf):
    d = _dna(spark, sf)
    first, minus = (F.col("k") % 300 + 40).cast("int"), F.col("k") % 2 == 1
    store = Contigs.of(d.select(F.col("k").alias("id"), F.col("s").alias("sequence")), 400)
    tails = store.upstream_tails(d.select(F.col("k").alias("key"), F.col("k").alias("id"), first.alias("start"), minus.alias("minus")), 120)  # some read on
    return tails.select(F.col("key").alias("k"), "tail", leader_of(F.col("tail")).alias("prefix"))


def _proteins(spark, sf) -> DataFrame:
    return _text(spark, sf).select(F.concat(F.lit("p"), "k").alias("protein"), F.col("u").alias("sequence"), F.translate(F.lpad((F.col("k") % 10_000).cast("string"), 4, "0"), "0123456789", "MAKMLEMGHM").alias("tail"), (F.col("k") % 30 + 1).cast("int").alias("anchor"))


_PROTEINS = f"{_U}, p AS (SELECT 'p' || k AS protein, u AS sequence, translate(lpad(CAST(k % 10000 AS VARCHAR), 4, '0'), '0123456789', 'MAKMLEMGHM') AS tail, k % 30 + 1 AS anchor FROM t)"


# Contigs are FASTA files of lines of 60 bases; two fragments a protein, the second one behind the first on its strand; a start is trimmed, found upstream or missing.
@query(f"""WITH {_DNA}, f AS (SELECT k, s, length(s) AS n, k % 2 = 1 AS minus, k % 3 AS kind, k % 11 = 5 AS lost, k % 13 = 6 AS torn FROM dna),
p AS (SELECT *, CASE WHEN minus THEN n - k % 40 - 30 ELSE k % 40 + 31 END AS first, CASE kind WHEN 0 THEN 'MAKL' WHEN 1 THEN 'LMAKL' ELSE 'AAKL' END AS protein FROM f),
e AS (SELECT *, CASE WHEN minus THEN first - 59 ELSE first + 59 END AS last, CASE kind WHEN 1 THEN 1 ELSE 0 END AS trim,
 CASE WHEN minus THEN reverse(translate(substr(s, CAST(first + 1 AS INT)), 'ACGT', 'TGCA')) ELSE substr(s, 1, CAST(first - 1 AS INT)) END AS before FROM p),
x AS (SELECT *, substr(before, CAST(length(before) % 3 + 1 AS INT)) AS x FROM e),
y AS (SELECT *, CASE WHEN kind = 2 THEN regexp_replace(split_part({_translated('x')}, '*', -1), '^.*M', 'M') ELSE '' END AS prefix FROM x),
l AS (SELECT *, first + CASE WHEN minus THEN -1 ELSE 1 END * 3 * (trim - length(prefix)) AS "start", CASE WHEN torn THEN 'contigs' WHEN lost THEN 'contig missing' END AS known FROM y WHERE n >= 140),
q AS (SELECT *, CASE WHEN known IS NOT NULL THEN known WHEN least("start", last) < 1 THEN 'before the contig' END AS problem, substr(s, CAST(least("start", last) AS INT), CAST(abs("start" - last) + 1 AS INT)) AS d FROM l)
SELECT k AS protein, CASE WHEN problem IS NULL THEN "start" END AS "start", CASE WHEN problem IS NULL THEN last END AS "end", CASE WHEN problem IS NULL THEN prefix END AS prefix, CASE WHEN problem IS NULL THEN prefix || substr(protein, trim + 1) END AS sequence,
 CASE WHEN problem IS NULL THEN md5(CASE WHEN minus THEN reverse(translate(d, 'ACGT', 'TGCA')) ELSE d END) END AS dna, problem FROM q""")
def g06_detected_loci(spark, sf):
    k, d = F.col("k"), _dna(spark, sf)
    n = F.length("s")
    d = d.where(n >= 140).select("k", "s", n.alias("n"), (k % 2 == 1).alias("minus"))
    wrapped = F.regexp_extract_all("s", F.lit("(.{1,60})"), 1)
    kept = d.where(k % 11 != 5)
    texts = kept.select(F.concat(F.lit("f"), k % 3).alias("file"), k, F.posexplode(F.concat(F.array(F.concat(F.lit(">c"), k, F.lit(" a contig"))), wrapped)).alias("i", "line"))
    store = Contigs.from_fasta(texts.select("file", (k * 100_000 + F.col("i")).alias("ord"), "line"), 500)
    first = F.when(F.col("minus"), F.col("n") - k % 40 - 30).otherwise(k % 40 + 31)
    step = F.when(F.col("minus"), -1).otherwise(1)
    contig = F.concat(F.lit("c"), k)
    parts = F.array(F.struct(contig.alias("contig"), first.alias("start"), (first + step * 29).alias("end"), F.lit(1).alias("target_start"), F.lit(10).alias("target_end"), F.lit(0).alias("ord")),
                    F.struct(F.when(k % 13 == 6, "elsewhere").otherwise(contig).alias("contig"), (first + step * 30).alias("start"), (first + step * 59).alias("end"), F.lit(11).alias("target_start"), F.lit(20).alias("target_end"), F.lit(1).alias("ord")))
    fragments = d.select(k.alias("protein"), F.explode(parts).alias("p")).select("protein", "p.*")
    proteins = d.select(k.alias("protein"), F.when(k % 3 == 0, "MAKL").when(k % 3 == 1, "LMAKL").otherwise("AAKL").alias("sequence"))
    out = G.detected_loci(fragments, proteins, store)
    return out.select("protein", "start", "end", "prefix", "sequence", F.md5(F.col("dna").cast("binary")).alias("dna"), "problem")


@query(f"""WITH {_PROTEINS} SELECT protein, protein AS accession, 'original' AS start_label, 1 AS "start", md5(sequence) AS digest, true AS is_original FROM p
UNION ALL SELECT protein, protein || '_with_leader_' || i || '_M', CAST(i AS VARCHAR), i, md5(substr(sequence, CAST(i AS INT))), false FROM p, (SELECT unnest(generate_series(2, 10)) AS i) WHERE substr(sequence, CAST(i AS INT), 1) = 'M'""")
def g01_leader_candidates(spark, sf):
    return G.leader_candidates(_proteins(spark, sf)).select("protein", "accession", "start_label", F.col("start").cast("long").alias("start"), _digest("sequence"), "is_original")


@query(f"""WITH {_PROTEINS}, a AS (SELECT protein, sequence, tail || sequence AS x, i FROM p LEFT JOIN (SELECT unnest(generate_series(1, 14)) AS i) ON substr(tail || sequence, CAST(i AS INT), 1) = 'M'),
l AS (SELECT *, CASE WHEN i IS NULL THEN 'original' WHEN i - 4 <= 0 THEN 'u' || (1 - (i - 4)) ELSE CAST(i - 4 AS VARCHAR) END AS label FROM a)
SELECT protein, label AS start_label, CASE WHEN i IS NULL THEN protein ELSE protein || '_with_leader_' || label || '_M' END AS accession, CASE WHEN i IS NULL THEN 1 ELSE i - 4 END AS "start", md5(CASE WHEN i IS NULL THEN sequence ELSE substr(x, CAST(i AS INT)) END) AS digest FROM l""")
def g02_curated_candidates(spark, sf):
    return G.curated_candidates(_proteins(spark, sf)).select("protein", "start_label", "accession", F.col("start").cast("long").alias("start"), _digest("sequence"))


@query(f"""WITH {_PROTEINS}, a AS (SELECT protein, tail || sequence AS x, unnest(generate_series(1, length(tail || sequence))) AS i, 4 + anchor AS a FROM p),
r AS (SELECT *, CASE WHEN i >= a THEN i - a + 1 ELSE i - a END AS rel FROM a WHERE substr(x, CAST(i AS INT), 1) = 'M')
SELECT protein, rel AS anchor_start, CASE WHEN rel < 0 THEN 'u' || -rel ELSE CAST(rel AS VARCHAR) END AS start_label, md5(substr(x, CAST(i AS INT))) AS digest FROM r WHERE rel BETWEEN -20 AND 15""")
def g03_anchored_candidates(spark, sf):
    return G.anchored_candidates(_proteins(spark, sf), 15, -20).select("protein", F.col("anchor_start").cast("long").alias("anchor_start"), "start_label", _digest("sequence"))


def _places(spark, sf) -> DataFrame:
    """Three exons of 1 to 11 bases for each order, from base 100 on, 10 bases apart."""
    lengths = [(_k() % 7 + 1), (_c() % 11 + 1), (_k() % 5 + 1)]
    cds, at = [], F.lit(100)
    for n in lengths:
        cds.append(F.struct(at.cast("int").alias("s"), (at + n - 1).cast("int").alias("e")))
        at = at + n + 10
    return read(spark, sf, "orders").select(_k(), F.concat(F.lit("p"), _k()).alias("protein"), F.when(_c() % 2 == 0, "-").otherwise("+").alias("strand"), F.array(*cds).alias("cds"))


_EXONS = """o AS (SELECT o_orderkey AS k, 'p' || o_orderkey AS protein, o_custkey % 2 = 0 AS minus, o_orderkey % 7 + 1 AS n1, o_custkey % 11 + 1 AS n2, o_orderkey % 5 + 1 AS n3 FROM orders),
x AS (SELECT k, protein, minus, i, CASE i WHEN 1 THEN 100 WHEN 2 THEN 110 + n1 ELSE 120 + n1 + n2 END AS s, CASE i WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS n FROM o, (VALUES (1), (2), (3)) v(i)),
e AS (SELECT *, s + n - 1 AS e, CASE WHEN minus THEN 4 - i ELSE i END AS exon, coalesce(sum(n) OVER (PARTITION BY k ORDER BY CASE WHEN minus THEN 4 - i ELSE i END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)"""


@query(f"""WITH {_EXONS} SELECT protein, exon, CAST(before // 3 + 1 AS BIGINT) AS first_aa, CAST(ceil((before + n) / 3) AS BIGINT) AS last_aa, CAST((3 - before % 3) % 3 AS BIGINT) AS head_bases, CAST((before + n) % 3 AS BIGINT) AS tail_bases FROM e""")
def w10_exon_residues(spark, sf):
    return G.exon_residues(_places(spark, sf))


@query(f"""WITH {_EXONS}, w AS (SELECT protein, minus, exon, CASE WHEN minus THEN e ELSE s END AS a, CASE WHEN minus THEN s ELSE e END AS b FROM e)
SELECT protein, CASE WHEN minus THEN '-' ELSE '+' END AS strand, f AS feature, CAST(CASE WHEN f IN ('start', 'ass') THEN a ELSE b END AS INT) AS position FROM w, (VALUES ('start'), ('stop'), ('dss'), ('ass')) v(f)
WHERE (f = 'start' AND exon = 1) OR (f = 'stop' AND exon = 3) OR (f = 'dss' AND exon < 3) OR (f = 'ass' AND exon > 1)""")
def g17_locus_features(spark, sf):
    return G.locus_features(_places(spark, sf))


@query(f"""WITH {_EXONS}, b AS (SELECT protein, k, CASE WHEN minus THEN e - j ELSE s + j END AS base, before + j + 1 AS nth FROM e, (SELECT unnest(generate_series(0, 10)) AS j) WHERE j < n),
a AS (SELECT protein, list(base ORDER BY nth) AS l, any_value(k % 5 + 1) AS aa FROM b GROUP BY 1) SELECT protein, CAST(l[CAST(aa * 3 - 2 AS INT)] AS INT) AS base1, CAST(l[CAST(aa * 3 - 1 AS INT)] AS INT) AS base2, CAST(l[CAST(aa * 3 AS INT)] AS INT) AS base3 FROM a""")
def j14_codon_positions(spark, sf):
    at = sequences.codon_positions((_k() % 5 + 1).cast("int"), F.col("cds"), F.col("strand") == "-")
    return _places(spark, sf).select("protein", at.alias("at")).select("protein", *(F.get("at", F.lit(i)).alias(f"base{i + 1}") for i in range(3)))


@query("""SELECT 'p' || o_orderkey AS protein, 'chr' || (o_custkey % 6) AS seqid, s AS strand, CASE WHEN s = '-' THEN hi ELSE lo END AS "start", CASE WHEN s = '-' THEN lo ELSE hi END AS "end", 2 AS n_cds
FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN '-' ELSE '+' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 100 + 1 ELSE o_orderkey * 100 + 10 END AS lo, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 100 + 99 ELSE o_orderkey * 100 + 90 END AS hi FROM orders)""")
def g07_loci(spark, sf):
    row = lambda kind, a, b, **attrs: F.struct(F.lit(kind).alias("type"), (_k() * 100 + a).alias("start"), (_k() * 100 + b).alias("end"), F.create_map(*[x for n, v in attrs.items() for x in (F.lit(n), v)]).alias("attrs"))
    cds = lambda a, b: row("CDS", a, b, ID=F.concat(F.lit("c"), _k()), protein_id=F.concat(F.lit("p"), _k()), Parent=F.concat(F.lit("x,t"), _k()))
    tx = row("mRNA", 1, 99, ID=F.when(_k() % 3 == 0, F.concat(F.lit("t"), _k())).otherwise("none"), protein_id=F.lit(""), Parent=F.lit("g"))
    f = read(spark, sf, "orders").select(F.concat(F.lit("chr"), _c() % 6).alias("seqid"), F.when(_c() % 2 == 0, "-").otherwise("+").alias("strand"), F.explode(F.array(cds(60, 90), cds(10, 40), tx)).alias("f")).select("seqid", "strand", "f.*")
    return G.loci(f).select("protein", "seqid", "strand", "start", "end", F.size("cds").alias("n_cds"))


@query(f"""WITH {_DNA}, p AS (SELECT *, k % 2 = 1 AS minus, k % 200 + 3 AS lo, k % 200 + 30 AS hi FROM dna), w AS (SELECT *, greatest(lo - 1 - CASE WHEN minus THEN 4 ELSE 7 END, 0) AS a, least(hi + CASE WHEN minus THEN 7 ELSE 4 END, length(s)) AS b FROM p)
SELECT k, CAST(a AS INT) AS window_0b, CAST(b AS INT) AS window_0b_excl, CASE WHEN minus THEN reverse(translate(x, 'ACGT', 'TGCA')) ELSE x END AS sequence FROM (SELECT *, substr(s, CAST(a + 1 AS INT), CAST(greatest(b - a, 0) AS INT)) AS x FROM w)""")
def g08_locus_window(spark, sf):
    d = _dna(spark, sf)
    lo, hi, minus = (F.col("k") % 200 + 3).cast("int"), (F.col("k") % 200 + 30).cast("int"), F.col("k") % 2 == 1
    places = d.select(F.col("k").cast("string").alias("protein"), F.concat(F.lit("k"), "k").alias("seqid"), F.when(minus, "-").otherwise("+").alias("strand"), F.when(minus, hi).otherwise(lo).alias("start"), F.when(minus, lo).otherwise(hi).alias("end"))
    store = Contigs.of(d.select(F.concat(F.lit("k"), "k").alias("id"), F.col("s").alias("sequence")), 17)  # windows run over several chunks
    w = G.locus_window(places, store, 7, 4)
    return w.select(F.col("protein").cast("long").alias("k"), "window_0b", "window_0b_excl", "sequence")


@query("""WITH f AS (SELECT conv_id, turn, turn * 20 + 1 AS first, turn * 20 + 10 + turn % 3 AS last, repeat(chr(CAST(65 + turn % 20 AS INT)), CAST(10 + turn % 3 AS INT)) AS s FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
g AS (SELECT *, greatest(first - coalesce(lag(last) OVER (PARTITION BY conv_id ORDER BY first), first - 1) - 1, 0) AS gap FROM f)
SELECT conv_id AS protein, string_agg(repeat('X', CAST(gap AS INT)) || s, '' ORDER BY first) AS sequence FROM g GROUP BY 1""")
def g12_collate_fragments(spark, sf):
    t = F.col("turn")
    f = read(spark, sf, "conversations").select("conv_id", "turn").distinct()
    letter = F.char(65 + t % 20)
    return G.collate_fragments(f.select(F.col("conv_id").alias("protein"), (t * 20 + 1).alias("first"), (t * 20 + 10 + t % 3).alias("last"), F.repeat(letter, (10 + t % 3).cast("int")).alias("sequence")))


@query("""WITH r AS (SELECT 'c' || (o_custkey % 300) AS accession, CASE WHEN o_custkey % 300 < 100 THEN 'same name' ELSE o_orderpriority END AS name FROM orders) SELECT accession, min(name) AS name, CASE WHEN count(DISTINCT name) > 1 THEN 'conflict' END AS problem FROM r GROUP BY 1""")
def g13_protein_names(spark, sf):
    name = F.when(_c() % 300 < 100, "same name").otherwise(F.col("o_orderpriority"))
    return G.protein_names(read(spark, sf, "orders").select(F.concat(F.lit("c"), _c() % 300).alias("id"), F.concat(name, F.lit(" [organism "), "o_orderstatus", F.lit("]")).alias("description")))


# Model L has 8 positions and R 10; each sequence is aligned to both by the digits of a number (0: a gap, else a residue), hits are lines of an order.
@query(f"""WITH {_U}, h AS (SELECT l_orderkey AS k, l_linenumber % 2 AS side, 1 + (l_partkey % 3) // 2 AS a, 7 + l_suppkey % 4 AS b FROM lineitem WHERE l_linenumber < 4 OR l_orderkey % 5 = 0),
o AS (SELECT k, side, count(*) AS n, min(a) AS a, min(b) AS b FROM h GROUP BY 1, 2),
m AS (SELECT k, side, i, substr(lpad(CAST(k * CASE side WHEN 1 THEN 7919 ELSE 104729 END % 10000000000 AS VARCHAR), 10, '1'), CAST(i AS INT), 1) <> '0' AS there FROM t, (SELECT unnest([0, 1]) AS side), (SELECT unnest(generate_series(1, 10)) AS i)),
p AS (SELECT k, side, i, CASE WHEN there THEN CAST(sum(CASE WHEN there THEN 1 ELSE 0 END) OVER (PARTITION BY k, side ORDER BY i) + CASE side WHEN 0 THEN k % 13 - 2 ELSE k % 3 END AS INT) END AS pos FROM m),
j AS (SELECT t.k, u, l.n AS ln, r.n AS rn, l.a <= 2 AND 2 <= l.b AS lspan, r.a <= 10 AND 10 <= r.b AS rspan, lp.pos AS first, rp.pos AS last FROM t LEFT JOIN o l ON l.k = t.k AND l.side = 1 LEFT JOIN o r ON r.k = t.k AND r.side = 0
 LEFT JOIN p lp ON lp.k = t.k AND lp.side = 1 AND lp.i = 2 LEFT JOIN p rp ON rp.k = t.k AND rp.side = 0 AND rp.i = 10),
q AS (SELECT *, CASE WHEN coalesce(ln, 0) <> 1 OR coalesce(rn, 0) <> 1 THEN 'hits' WHEN NOT lspan OR NOT rspan THEN 'span' WHEN first IS NULL OR last IS NULL THEN 'deletion' WHEN first > last THEN 'order' WHEN first < 1 OR last > length(u) THEN 'outside' END AS problem FROM j)
SELECT 's' || k || '|rest' AS id, CASE WHEN problem IS NULL THEN 's' || k || '_bounded_' || first || '-' || last || '|rest|core' END AS bounded_id, CASE WHEN problem IS NULL THEN substr(u, first, last - first + 1) END AS sequence, problem FROM q""")
def g16_bounded(spark, sf):
    name = lambda k: F.concat(F.lit("s"), k, F.lit("|rest"))
    s = _text(spark, sf).select(name(F.col("k")).alias("id"), F.col("u").alias("sequence"))
    li = read(spark, sf, "lineitem").where("l_linenumber < 4 OR l_orderkey % 5 = 0")
    h = li.select(name(F.col("l_orderkey")).alias("sequence"), (F.col("l_linenumber") % 2).alias("side"), (1 + F.floor(F.col("l_partkey") % 3 / 2)).cast("int").alias("hmm_from"), (7 + F.col("l_suppkey") % 4).cast("int").alias("hmm_to"))

    def mapped(times, shift):
        k, digits = F.col("k"), F.lpad((F.col("k") * times % 10_000_000_000).cast("string"), 10, "1")
        cells = _text(spark, sf).select(k, F.posexplode(F.split(digits, "")).alias("i", "d")).where("i < 10").withColumn("there", F.col("d") != "0")
        pos = F.sum(F.col("there").cast("int")).over(Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) + shift
        cell = F.when(F.col("there"), F.struct(pos.cast("int").alias("pos"), F.lit("A").alias("aa")))
        each = cells.select(k, F.struct((F.col("i") + 1).alias("hmm"), cell.alias("cell")).alias("e"))
        return each.groupBy("k").agg(F.map_from_entries(F.collect_list("e")).alias("hmm")).select(name(k).alias("id"), "hmm")

    left, right = (h.where(F.col("side") == side).withColumn("model_length", F.lit(n)) for side, n in ((1, 8), (0, 10)))
    return G.bounded(s, left, right, mapped(7919, F.col("k") % 3), mapped(104_729, F.col("k") % 13 - 2), 2, None, "core")


@query(f"""WITH {_DNA}, b AS (SELECT k, i, substr(s, CAST(i + 1 AS INT), 1) = 'N' AS n, length(s) AS len FROM (SELECT k, s, unnest(range(length(s))) AS i FROM dna)),
w AS (SELECT k, i, len, sum(CAST(n AS INT)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM b), o AS (SELECT k, i, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM w WHERE i + 10 <= len AND n / 10.0 <= 0.1)
SELECT k AS id, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last FROM o GROUP BY k, g""")
def w11_open_starts(spark, sf):
    return G.open_starts(_dna(spark, sf).select(F.col("k").alias("id"), F.col("s").alias("sequence")), 10)


@query("""WITH r AS (SELECT o_orderkey, translate(lpad(CAST(o_orderkey * 7919 % 10000000000 AS VARCHAR), 10, '0'), '0123456789', 'ACDEFGHIKL') AS s FROM orders), l AS (SELECT translate(s, 'DG', '-.') AS lead FROM r ORDER BY o_orderkey LIMIT 1),
k AS (SELECT o_orderkey, (SELECT string_agg(substr(CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN lead ELSE s END, CAST(i AS INT), 1), '' ORDER BY i) FROM l, generate_series(1, 10) g(i) WHERE substr(lead, CAST(i AS INT), 1) NOT IN ('-', '.')) AS kept FROM r, l)
SELECT o_orderkey AS ord, substr(substr(coalesce(kept, ''), 1, 7), 2) AS sequence FROM k""")
def p19_match_columns(spark, sf):
    o = read(spark, sf, "orders")
    s = F.translate(F.lpad((_k() * 7919 % 10_000_000_000).cast("string"), 10, "0"), "0123456789", "ACDEFGHIKL")
    first = o.agg(F.min("o_orderkey").alias("first"))
    rows = o.crossJoin(F.broadcast(first)).select(_k().alias("ord"), F.when(_k() == F.col("first"), F.translate(s, "DG", "-.")).otherwise(s).alias("sequence"))  # one row
    return G.match_columns(rows, left=2, right=7)


@query("""WITH r AS (SELECT 'p' || (o_custkey % 400) AS protein, o_orderkey AS ord, CASE WHEN o_custkey % 400 < 150 THEN 'S' ELSE o_orderstatus END AS sequence FROM orders)
SELECT protein, ord, sequence, problem FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY ord) AS k, CASE WHEN min(sequence) OVER (PARTITION BY protein) <> max(sequence) OVER (PARTITION BY protein) THEN 'sequences differ' END AS problem FROM r) WHERE k = 1""")
def j21_first_genome(spark, sf):
    return G.first_genome(read(spark, sf, "orders").select(F.concat(F.lit("p"), _c() % 400).alias("protein"), _k().alias("ord"), F.when(_c() % 400 < 150, "S").otherwise(F.col("o_orderstatus")).alias("sequence")))


# Channels over the benchmark's texts: windows as lists of letters.
_RES = """b AS (SELECT item_id AS k, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS u FROM benchmark), r AS (SELECT k, u, unnest(generate_series(1, length(u))) AS i FROM b),
w AS (SELECT k, u, i, substr(u, CAST(i AS INT), 1) AS c, string_split(substr(u, CAST(greatest(i - {r}, 1) AS INT), CAST(least(i + {r}, length(u)) - greatest(i - {r}, 1) + 1 AS INT)), '') AS l FROM r)"""


def _scale(table: dict[str, float]) -> str:
    return "[" + ", ".join(str(table.get(chr(65 + i), 0.0)) + "::DOUBLE" for i in range(26)) + "]"


def _channel(spark, sf, channel: channels.Channel) -> DataFrame:
    rows = _text(spark, sf, "benchmark", "item_id").select(F.lit("b").alias("filename"), F.col("k").cast("string").alias("sequence_id"), F.col("u").alias("sequence"))
    return channels.ChannelSet(channel).table(rows).select(F.col("sequence_id").cast("long").alias("k"), F.col("position").cast("long").alias("position"), "residue", (F.round(channel.name, 9) + 0.0).alias("v"))


# The published scales, written out again so that the SQL doesn't read the library's.
_KD = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
_EIS = {"I": 0.73, "F": 0.61, "V": 0.54, "L": 0.53, "W": 0.37, "M": 0.26, "A": 0.25, "G": 0.16, "C": 0.04, "Y": 0.02, "P": -0.07, "T": -0.18, "S": -0.26, "H": -0.40, "E": -0.62, "N": -0.64, "Q": -0.69, "D": -0.72, "K": -1.10, "R": -1.76}
_IDP = {"W": -0.884, "F": -0.697, "Y": -0.510, "I": -0.486, "M": -0.397, "L": -0.326, "V": -0.121, "N": 0.007, "C": 0.02, "T": 0.059, "A": 0.06, "G": 0.166, "R": 0.18, "D": 0.192, "H": 0.303, "Q": 0.318, "S": 0.341, "K": 0.586, "E": 0.736, "P": 0.987}


def _mean(table) -> str:
    return f"list_sum(list_transform(l, lambda x: {_scale(table)}[ascii(x) - 64])) / len(l)"


@query(f"WITH {_RES.format(r=3)} SELECT k, i AS position, c AS residue, round({_mean(_KD)}, 9) + 0.0 AS v FROM w")
def c04_hydropathy(spark, sf):
    return _channel(spark, sf, channels.Scale("kd", 3))


@query(f"WITH {_RES.format(r=4)} SELECT k, i AS position, c AS residue, round({_mean(_IDP)}, 9) + 0.0 AS v FROM w")
def c06_disorder(spark, sf):
    return _channel(spark, sf, channels.disorder("idp", 4))


@query(f"""WITH {_RES.format(r=5)}, m AS (SELECT k, i, c, len(l) AS n, list_sum(list_transform(range(len(l)), lambda j: {_scale(_EIS)}[ascii(l[j + 1]) - 64] * cos(radians(100.0 * j)))) AS x, list_sum(list_transform(range(len(l)), lambda j: {_scale(_EIS)}[ascii(l[j + 1]) - 64] * sin(radians(100.0 * j)))) AS y FROM w)
SELECT k, i AS position, c AS residue, round(sqrt(x * x + y * y) / n, 9) AS v FROM m""")
def c05_moment(spark, sf):
    return _channel(spark, sf, channels.Moment("m", 5))


@query(f"""WITH {_RES.format(r=3)} SELECT k, i AS position, c AS residue, round(0.0 - list_sum(list_transform(list_distinct(l), lambda x: len(list_filter(l, lambda y: y = x)) / len(l) * log2(len(list_filter(l, lambda y: y = x)) / len(l)))), 9) AS v FROM w""")
def c07_entropy(spark, sf):
    return _channel(spark, sf, channels.Entropy("h", 3))


@query(f"""WITH {_RES.format(r=6)} SELECT k, i AS position, c AS residue, CASE WHEN length(u) >= 2 THEN round(len(list_filter(range(1, len(l)), lambda j: l[j] = 'T' AND l[j + 1] = 'H')) / (len(l) - 1), 9) END AS v FROM w""")
def c08_dipeptide(spark, sf):
    return _channel(spark, sf, channels.Dipeptide("th", 6, "TH"))


@query(f"""WITH {_RES.format(r=2)} SELECT k, i AS position, c AS residue, CASE WHEN regexp_matches(array_to_string(l, ''), 'A.E') AND ((i >= 3 AND regexp_matches(substr(u, CAST(i - 2 AS INT), 3), '^A.E$')) OR (i >= 2 AND regexp_matches(substr(u, CAST(i - 1 AS INT), 3), '^A.E$')) OR regexp_matches(substr(u, CAST(i AS INT), 3), '^A.E$')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM w""")
def c02_motif(spark, sf):
    return _channel(spark, sf, channels.Motif("mo", 0, "A.E"))


# Rules.
def _values(results: DataFrame, rule, *keys) -> DataFrame:
    return results.select(*keys, *(F.col(f"`{label}`").alias(f"r{i}") for i, label in enumerate(rule.atoms())), F.col("`pass all`").alias("passed"))


@query(f"""WITH {_U}, r AS (SELECT k, length(u) BETWEEN 300 AND 3000 AS a, regexp_matches(u, 'TH.{{0,3}}ER') AS b, length(u) >= 5 AND regexp_matches(substr(u, 5, 396), '[KR][AE]S') AS c FROM t)
SELECT k, CASE WHEN a THEN 'true' ELSE 'false' END AS r0, CASE WHEN b THEN 'true' ELSE 'false' END AS r1, CASE WHEN c THEN 'true' ELSE 'false' END AS r2, CASE WHEN a AND (b OR NOT c) THEN 'true' ELSE 'false' END AS passed FROM r""")
def r14_sequence_rules(spark, sf):
    rule = rules.Sequence.length_between(3000, 300) & (rules.Sequence.matches_regex("TH.{0,3}ER") | ~rules.Sequence.matches_regex("[KR][AE]S").between_aa(400, 5))
    return _values(rule.evaluate(_text(spark, sf).withColumnRenamed("u", "sequence")), rule, "k")


@query(f"""WITH {HITS}, {_U}, h AS (SELECT query_accession AS q, min(query_start - (coalesce(target_start, 1) - 1)) AS anchor FROM hits WHERE target_accession = 'PF00003' OR starts_with(target_accession, 'PF00003.') GROUP BY 1),
j AS (SELECT k, u, anchor, CASE WHEN k % 5 > 0 THEN k % 90 + 1 END AS ps FROM t LEFT JOIN h ON q = CAST(k AS VARCHAR)), p AS (SELECT *, CASE WHEN anchor >= ps THEN anchor - ps + 1 ELSE anchor - ps END AS rel FROM j),
x AS (SELECT *, greatest(rel - 20, 1) AS a, least(rel + 29, length(u)) AS b FROM p)
SELECT k, CASE WHEN anchor IS NULL THEN 'false' WHEN ps IS NULL THEN 'error' WHEN a <= b AND regexp_matches(substr(u, CAST(a AS INT), CAST(b - a + 1 AS INT)), 'S[TE]') THEN 'true' ELSE 'false' END AS r0 FROM x""")
def p12_relative_pattern(spark, sf):
    d, k = _text(spark, sf), F.col("k")
    proteins = d.select(k.cast("string").alias("protein"), k, F.col("u").alias("sequence"), F.when(k % 5 > 0, (k % 90 + 1).cast("int")).alias("protein_start"))
    rule = rules.Sequence.matches_regex("S[TE]").relative_to("PF00003", 30, -20)
    return _values(rule.evaluate(rules.facts(proteins, Pfam=hits(spark, sf))), rule, "k").select("k", "r0")


_HMM = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN translate(lpad(CAST(o_orderkey * 7919 % 100000000 AS VARCHAR), 8, '0'), '0123456789', 'AC-DEFGHIK') END AS s, o_orderkey % 5 AS d FROM orders),
r AS (SELECT o_orderkey, s IS NOT NULL AND substr(s, 3, 2) = 'AC' AS a, s IS NOT NULL AND NOT contains(substr(s, 2, 3), '-') AS b, s IS NOT NULL AND regexp_matches(s, '^-{0,1}[^-]') AND regexp_matches(s, '[^-]-{0,2}$') AS c,
 s IS NOT NULL AND regexp_matches(substr(s, 4), '^[ACD]-?E') AS e, s IS NOT NULL AND NOT contains(substr(s, 2, 3), '-') AND d + 2 >= 4 AND d + 4 <= 7 AS f FROM o)"""


@query(f"WITH {_HMM} SELECT o_orderkey, " + ", ".join(f"CASE WHEN {c} THEN 'true' ELSE 'false' END AS r{i}" for i, c in enumerate("abcef")) + ", CASE WHEN a OR b OR c OR e OR f THEN 'true' ELSE 'false' END AS passed FROM r")
def r15_profile_rules(spark, sf):
    s = F.translate(F.lpad((_k() * 7919 % 100_000_000).cast("string"), 8, "0"), "0123456789", "AC-DEFGHIK")
    cell = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct(i.alias("k"), F.when(F.substring(F.col("s"), i, F.lit(1)) != "-", F.struct((i + _k() % 5).cast("int").alias("pos"), F.substring(F.col("s"), i, F.lit(1)).alias("aa"))).alias("v")))
    facts = read(spark, sf, "orders").select(_k(), s.alias("s")).select("o_orderkey", F.create_map(F.lit("X"), F.when(_k() % 7 > 0, F.map_from_entries(cell))).alias("hmm"))
    hmm = rules.HMM("X")
    rule = hmm.is_at("AC", 3) | hmm.covers(4, 2) | hmm.spans(2, 6) | hmm.matches_regex("[ACD]-?E", 4) | hmm.covers(2, 4).between(7, 4)
    return _values(rule.evaluate(facts), rule, "o_orderkey")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 9 = 0 AS no_t, o_custkey % 8 = 0 AS no_d, (o_custkey % 100) / 100.0 AS p_no, (o_orderkey % 100) / 100.0 AS p_m, ((o_orderkey + o_custkey) % 100) / 100.0 AS p_s, o_orderstatus AS loc, o_orderkey % 3 = 0 AS nls, o_orderkey % 6 = 0 AS one FROM orders),
c AS (SELECT *, CASE WHEN greatest(p_no, p_m, p_s) = 0 THEN '' WHEN p_no >= p_m AND p_no >= p_s THEN 'noTP' WHEN p_m >= p_s THEN 'mTP' ELSE 'SP' END AS call FROM o)
SELECT o_orderkey, call AS "call", CASE WHEN no_t THEN 'error' WHEN call = 'mTP' THEN 'true' ELSE 'false' END AS r0, CASE WHEN no_t THEN 'error' WHEN call = 'SP' THEN 'true' ELSE 'false' END AS r1, CASE WHEN no_d THEN 'maybe' WHEN loc = 'F' THEN 'true' ELSE 'false' END AS r2, CASE WHEN no_d THEN 'maybe' WHEN nls AND one THEN 'true' ELSE 'false' END AS r3 FROM c""")
def r18_leader_rules(spark, sf):
    share = lambda x: x % 100 / 100.0
    t = F.struct(share(_c()).alias("p_noTP"), share(_k()).alias("p_mTP"), share(_k() + _c()).alias("p_SP"))
    d = F.struct(F.col("o_orderstatus").alias("localizations"), F.when(_k() % 3 == 0, F.array(F.lit("Nuclear localization signal"))).otherwise(F.array(F.lit("Peroxisomal"))).alias("signals"), F.create_map(F.lit("Nuclear localization signal"), F.when(_k() % 6 == 0, 1.0).otherwise(0.0)).alias("scores"))
    facts = read(spark, sf, "orders").select(_k(), t.alias("told"), F.when(_k() % 9 > 0, t).alias("targetp"), F.when(_c() % 8 > 0, d).alias("deeploc"))
    who = rules.Leader()
    rule = who.is_mTP() | who.is_SP() | who.localize_at("F") | who.is_NLS()
    return _values(rule.evaluate(facts.withColumn("call", rules.targetp_call(F.col("told")))), rule, "o_orderkey", "call").drop("passed")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 11 = 0 AS na, o_orderkey % 13 = 0 AS none, o_orderkey % 17 = 0 AS failed, o_orderkey % 50 AS s1, o_custkey % 80 AS s2, o_custkey % 3 = 0 AS low FROM orders),
m AS (SELECT *, s1 >= 10 AND s1 + 5 <= 60 AS h1, s2 >= 10 AND s2 + 5 <= 60 AND NOT low AS h2, greatest(0, s1 - s2 - 5, s2 - s1 - 5) AS gap FROM o)
SELECT o_orderkey, CASE WHEN na THEN 'not_applicable' WHEN none THEN 'false' WHEN failed THEN 'error' WHEN h1 THEN 'yes' ELSE 'missing_MA1' END AS r0,
 CASE WHEN na THEN 'not_applicable' WHEN none THEN 'false' WHEN failed THEN 'error' WHEN NOT h1 AND NOT h2 THEN 'missing_MA1_and_MA2' WHEN NOT h1 THEN 'missing_MA1' WHEN NOT h2 THEN 'missing_MA2' WHEN gap <= 12 THEN 'yes' ELSE 'too_far' END AS r1 FROM m""")
def r20_motif_rules(spark, sf):
    hit = lambda name, s, score: F.struct(F.lit(name).alias("motif"), s.cast("int").alias("start"), (s + 5).cast("int").alias("end"), score.cast("double").alias("score"))
    motifs = F.array(hit("MA1.2", _k() % 50, F.lit(9)), hit("MA2", _c() % 80, F.when(_c() % 3 == 0, 1).otherwise(8)))
    scopes = F.array(F.struct(F.lit(10).alias("s"), F.lit(60).alias("e")))
    facts = read(spark, sf, "orders").select(_k(), F.when(_k() % 17 > 0, motifs).alias("motifs"), F.when(_k() % 11 == 0, None).when(_k() % 13 == 0, F.slice(scopes, 1, 0)).otherwise(scopes).alias("scopes"))
    rule = rules.Motifs("MA1", lowest_score=5.0) & rules.Motifs("MA1", "MA2", 12, 5.0)
    return _values(rule.evaluate(facts), rule, "o_orderkey").drop("passed")


# A few proteins share all lines of orders as motif hits; two scopes each, and some proteins without a genome, a scope or a scan.
_MOTIFS = """h AS (SELECT l_suppkey % 50 AS p, l_partkey % 3 AS m, l_orderkey * 7 + l_partkey % 11 AS s, l_orderkey * 7 + l_partkey % 11 + 6 AS e, l_linenumber AS score FROM lineitem), c AS (SELECT DISTINCT p FROM h),
k AS (SELECT p, 100 + p AS s, 3000 + 50 * p AS e FROM c WHERE p % 9 <> 4 UNION ALL SELECT p, 4000, 4100 FROM c WHERE p % 9 <> 4),
i AS (SELECT DISTINCT h.* FROM h JOIN k ON h.p = k.p AND h.s >= k.s AND h.e <= k.e WHERE score >= 3), a AS (SELECT * FROM i WHERE m = 0 AND p % 10 <> 5), b AS (SELECT * FROM i WHERE m = 1 AND p % 6 <> 5),
n AS (SELECT DISTINCT a.p FROM a JOIN b ON a.p = b.p AND b.s <= a.e + 2 AND b.e >= a.s - 2)"""


@query(f"""WITH {_MOTIFS} SELECT 'p' || p AS protein, CASE WHEN p % 11 = 7 THEN 'not_applicable' WHEN p % 9 = 4 THEN 'false' WHEN p % 13 = 3 THEN 'error' WHEN p NOT IN (SELECT p FROM a) AND p NOT IN (SELECT p FROM b) THEN 'missing_MA0_and_MA1'
 WHEN p NOT IN (SELECT p FROM a) THEN 'missing_MA0' WHEN p NOT IN (SELECT p FROM b) THEN 'missing_MA1' WHEN p IN (SELECT p FROM n) THEN 'yes' ELSE 'too_far' END AS result FROM c""")
def j13_motif_distances(spark, sf):
    c = F.col
    p, m, start = c("l_suppkey") % 50, c("l_partkey") % 3, c("l_orderkey") * 7 + c("l_partkey") % 11
    h = read(spark, sf, "lineitem").select(p.alias("p"), F.concat(F.lit("MA"), m, F.lit(".1")).alias("motif"), start.alias("start"), (start + 6).alias("end"), c("l_linenumber").cast("double").alias("score"), m.alias("m"))
    h = h.withColumn("protein", F.concat(F.lit("p"), "p")).where(~((c("m") == 0) & (c("p") % 10 == 5)) & ~((c("m") == 1) & (c("p") % 6 == 5)))
    every = read(spark, sf, "lineitem").select(p.alias("p")).distinct().withColumn("protein", F.concat(F.lit("p"), "p"))
    scopes = every.where("p % 9 <> 4").select("protein", F.explode(F.array(F.struct((100 + c("p")).alias("s"), (3000 + 50 * c("p")).alias("e")), F.struct(F.lit(4000).cast("long").alias("s"), F.lit(4100).cast("long").alias("e")))).alias("x")).select("protein", "x.*")
    return rules.motif_verdicts(every.select("protein", (c("p") % 11 != 7).alias("has_genome")), scopes, h, every.where("p % 13 = 3"), "MA0", "MA1", 2, 3.0)


@query("""WITH i AS (SELECT 'c' || (o_custkey % 97) AS id, o_orderkey * 10 AS first, o_orderkey * 10 + o_custkey % 40 - 3 AS last FROM orders), n AS (SELECT *, last - first + 1 AS n FROM i WHERE last >= first),
b AS (SELECT *, sum(n) OVER (ORDER BY id, first) - n AS before FROM n), t AS (SELECT sum(n) AS total FROM n), d AS (SELECT o_orderkey AS nth, o_orderkey * 7919 % (SELECT total FROM t) AS k FROM orders)
SELECT nth, id, CAST(first + k - before AS BIGINT) AS start FROM d JOIN b ON k >= before AND k < before + n""")
def g19_starts(spark, sf):
    o = read(spark, sf, "orders")
    i = G.numbered_intervals(o.select(F.concat(F.lit("c"), _c() % 97).alias("id"), (_k() * 10).alias("first"), (_k() * 10 + _c() % 40 - 3).alias("last")))
    total = i.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0]
    return G.starts_at(i, o.select(_k().alias("nth"), (_k() * 7919 % total).alias("k")), total).select("nth", "id", "start")


@query("""WITH c AS (SELECT 'p' || (o_custkey % 300) AS protein, 'a' || o_orderkey AS accession, CAST(o_orderkey % 41 - 20 AS INT) AS "start", o_orderkey % 10 = 0 AS orig FROM orders),
m AS (SELECT *, "start" <> 0 AND "start" BETWEEN -5 AND 8 AND NOT orig AS a, "start" <> 0 AND "start" BETWEEN 12 AND 15 AND NOT orig AS b FROM c), x AS (SELECT *, bool_or(a) OVER (PARTITION BY protein) AS any_a, bool_or(b) OVER (PARTITION BY protein) AS any_b FROM m)
SELECT protein, accession, "start" FROM x WHERE a OR orig OR b""")
def r08_scopes(spark, sf):
    c = read(spark, sf, "orders").select(F.concat(F.lit("p"), _c() % 300).alias("protein"), F.concat(F.lit("a"), _k()).alias("accession"), (_k() % 41 - 20).cast("int").alias("start"), (_k() % 10 == 0).alias("is_original"))
    who = rules.Leader()
    rule = who.is_mTP().within(8, -5) | who.is_SP().within(12, 15, original=False)
    return rule.scope(c).select("protein", "accession", "start")


@query(f"""WITH {HITS}, c AS (SELECT CAST(o_orderkey AS VARCHAR) AS protein, 'a' || o_orderkey || CASE WHEN o_custkey % 2 = 0 THEN '|x' ELSE '' END AS accession, CASE WHEN o_custkey % 60 = 0 THEN 1 ELSE o_custkey % 60 - 30 END AS s, repeat(o_orderpriority, 40) AS sequence FROM orders),
d AS (SELECT *, CASE WHEN s = 0 THEN 5 ELSE s END AS st FROM c), b AS (SELECT query_accession AS protein, max(hi) AS bound FROM hits WHERE starts_with(target_accession, 'PF00004.') GROUP BY 1), j AS (SELECT * FROM d LEFT JOIN b USING (protein) WHERE bound IS NULL OR st <= bound)
SELECT protein, CASE WHEN bound IS NULL THEN accession WHEN contains(accession, '|') THEN replace(accession, '|', '_to_Pfam_end|') ELSE accession || '_to_Pfam_end' END AS accession, CAST(length(CASE WHEN bound IS NULL THEN sequence ELSE substr(sequence, 1, CAST(CASE WHEN st > 0 THEN bound - st + 1 ELSE bound - st END AS INT)) END) AS BIGINT) AS n FROM j""")
def g05_bound_candidates(spark, sf):
    s = F.when(_c() % 60 == 0, 1).otherwise(_c() % 60 - 30)
    c = read(spark, sf, "orders").select(_k().cast("string").alias("protein"), F.concat(F.lit("a"), _k(), F.when(_c() % 2 == 0, "|x").otherwise("")).alias("accession"), F.when(s == 0, 5).otherwise(s).cast("int").alias("start"), F.repeat("o_orderpriority", 40).alias("sequence"))
    return rules.bound_candidates(c, hits(spark, sf), "PF00004", "Pfam").select("protein", "accession", F.length("sequence").cast("long").alias("n"))


@query("""WITH r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'maybe' WHEN 2 THEN 'error' ELSE 'false' END AS result FROM orders) SELECT result, count(*) AS n FROM r GROUP BY 1""")
def a17_result_counts(spark, sf):
    return rules.result_counts(_results(spark, sf), "pass all")


def _results(spark, sf) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, ("true", "maybe", "error", "false"))), (_k() % 4 + 1).cast("int"))
    return read(spark, sf, "orders").select(_k(), F.col("o_orderstatus").alias("rule one"), value.alias("pass all"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1")
def p10_passing_rows(spark, sf):
    r = _results(spark, sf)
    return rules.passing_rows(r, **{"rule one": "F"}).unionByName(rules.passing_rows(r, **{"pass all": "maybe"})).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'error' WHEN o_totalprice / (o_custkey % 7) > 20000 THEN 'true' ELSE 'false' END AS r0, CASE WHEN o_custkey % 7 = 0 THEN 'error' WHEN o_totalprice / (o_custkey % 7) > 20000 THEN 'true' ELSE 'false' END AS passed FROM orders""")
def r07_isolated_errors(spark, sf):
    rule = rules.Python("share", lambda row: row["o_totalprice"] / (row["o_custkey"] % 7) > 20000, ("o_totalprice", "o_custkey"))
    return _values(rule.evaluate(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")), rule, "o_orderkey")


# Tables.
@query("""SELECT c_custkey, coalesce(max(o_totalprice), 0.0) AS score FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def j03_scored(spark, sf):
    best = read(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(_c().alias("c_custkey")).agg(F.max("o_totalprice").alias("score"))
    return T.scored(read(spark, sf, "customer").select("c_custkey"), best, "c_custkey").select("c_custkey", "score")


@query("""SELECT c_custkey, coalesce(CAST(max(o_orderkey) AS VARCHAR), '') AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def j06_attached(spark, sf):
    return T.attached(read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").where("o_orderstatus = 'P'").select(_c().alias("c_custkey"), _k().alias("best")), "c_custkey", "best")


@query("""SELECT 0 AS part, o_orderkey AS ord, o_custkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 1, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 0""")
def u02_concatenated(spark, sf):
    o = read(spark, sf, "orders").select(_k().alias("ord"), "o_custkey", "o_orderstatus")
    parts = [o.where(w).select("ord", "o_custkey") for w in ("o_orderstatus = 'P'", "o_orderstatus = 'F'", "ord % 5 = 0")]
    return T.concatenated(*parts, order="ord")


@query("""WITH d AS (SELECT o_orderstatus AS g, o_custkey AS id, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS k FROM d)
SELECT g, list(id ORDER BY id) FILTER (k <= 5) AS first_ids, count(*) AS n_ids FROM r GROUP BY 1""")
def o05_first_offenders(spark, sf):
    d = T.duplicates(read(spark, sf, "orders").select(F.col("o_orderstatus").alias("g"), _c().alias("id")), ["g", "id"], "x")
    return T.first_offenders(d, ["g"], "id")


@query("""SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus DESC) AS INT) AS rank FROM orders""")
def w02_competition_rank(spark, sf):
    return T.competition_rank(read(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderpriority"), F.desc("o_orderstatus")]).select("o_custkey", "o_orderkey", "rank")


@query("""WITH r AS (SELECT 0 AS part, o_orderkey AS ord, o_custkey % 500 AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_orderkey, o_custkey % 500, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, arg_min(part, part * 100000000 + ord) AS part, arg_min(ord, part * 100000000 + ord) AS ord, arg_max(v, part * 100000000 + ord) AS v FROM r GROUP BY 1""")
def u05_union_last_value(spark, sf):
    o = read(spark, sf, "orders")
    part = lambda r, v: o.where(_k() % 2 == r).select((_c() % 500).alias("k"), _k().alias("ord"), F.col(v).alias("v"))
    return T.union_last_value_first_place(part(0, "o_orderstatus"), part(1, "o_orderpriority"), "k", "ord")


@query("""SELECT o_orderkey, r, r <> 0 AND r BETWEEN -7 AND 9 AS inside, CASE WHEN r > 0 THEN r + 99 WHEN r < 0 THEN r + 100 END AS back FROM (SELECT o_orderkey, o_custkey % 41 - 20 AS r FROM orders)""")
def p13_signed_windows(spark, sf):
    r = F.col("r")
    return read(spark, sf, "orders").select(_k(), (_c() % 41 - 20).alias("r")).select("o_orderkey", "r", intervals.in_window(r, 9, -7).alias("inside"), intervals.absolute(r, F.lit(100)).alias("back"))


# Structure.
def _residues(spark, sf, scale: float = 20.0) -> DataFrame:
    e, v = read(spark, sf, "embeddings"), F.col("vec_id")
    xyz = [(scale * F.element_at("embedding", i + 1)).cast("double").alias(c) for i, c in enumerate("xyz")]
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (v % 5 + 1).cast("int"))
    return e.select(F.lit("m").alias("model"), F.concat(F.lit("C"), F.col("label") % 4).alias("chain"), v.alias("number"), (v % 101).cast("double").alias("plddt"), pick("LYS", "ASP", "ALA", "SEP", "SER").alias("resname"), pick("NZ", "OD1", "CB", "O1P", "OG").alias("name"), pick("N", "O", "C", "O", "O").alias("element"), *xyz)


_ATOMS = """a AS (SELECT 'C' || (label % 4) AS chain, vec_id AS number, vec_id % 101 AS plddt, vec_id % 5 AS t, {s} * CAST(embedding[1] AS DOUBLE) AS x, {s} * CAST(embedding[2] AS DOUBLE) AS y, {s} * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


#: Atoms that tell readings apart: a modified residue's oxygen, a thiol, backbone atoms, proline's nitrogen, an acid's carbon, a hydrogen.
_KINDS = [
    ("LYS", "NZ", "N"), ("ASP", "OD1", "O"), ("ALA", "CB", "C"), ("SEP", "O1P", "O"), ("SER", "OG", "O"), ("CYS", "SG", "S"), ("CYS", "CB", "C"), ("LEU", "CA", "C"), ("PRO", "N", "N"), ("GLY", "N", "N"), ("SEP", "N", "N"), ("GLY", "O", "O"),
    ("GLU", "CD", "C"), ("TPO", "P", "P"), ("HIS", "ND1", "N"), ("ALA", "HB1", "H"),
]

#: From the rule's words: who is basic, acidic, a phosphate's oxygen, a donor, an acceptor, a nonpolar side-chain atom, and radii.
_KIND_SQL = """(VALUES (0, true, false, false, true, false, false, 1.55), (1, false, true, false, false, true, false, 1.52), (2, false, false, false, false, false, true, 1.7), (3, false, false, true, false, false, false, 1.52),
 (4, false, false, false, true, true, false, 1.52), (5, false, false, false, false, false, true, 1.8), (6, false, false, false, false, false, true, 1.7), (7, false, false, false, false, false, false, 1.7), (8, false, false, false, false, false, false, 1.55),
 (9, false, false, false, true, false, false, 1.55), (10, false, false, false, false, false, false, 1.55), (11, false, false, false, false, true, false, 1.52), (12, false, false, false, false, false, false, 1.7), (13, false, false, false, false, false, false, 1.8),
 (14, false, false, false, true, true, false, 1.55)) k(t, basic, acidic, phosphate, donor, acceptor, greasy, radius)"""


@query(f"""WITH a AS (SELECT 'C' || (label % 4) AS chain, vec_id AS number, 40 * CAST(embedding[1] AS DOUBLE) AS x, 40 * CAST(embedding[2] AS DOUBLE) AS y, 40 * CAST(embedding[3] AS DOUBLE) AS z, k.* FROM embeddings JOIN {_KIND_SQL} ON vec_id % 16 = t),
d AS (SELECT p.chain AS chain_a, q.chain AS chain_b, p.number AS na, q.number AS nb, p AS p, q AS q, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM a p JOIN a q ON p.chain < q.chain AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 20.25),
i AS (SELECT *, 'salt_bridge' AS kind FROM d WHERE d <= 4 AND ((p.basic AND q.acidic) OR (p.acidic AND q.basic)) UNION ALL SELECT *, 'phosphate' FROM d WHERE d <= 4 AND ((p.basic AND q.phosphate) OR (p.phosphate AND q.basic))
 UNION ALL SELECT *, 'hydrogen_bond' FROM d WHERE d <= 3.5 AND ((p.donor AND q.acceptor) OR (q.donor AND p.acceptor)) UNION ALL SELECT *, 'nonpolar' FROM d WHERE p.greasy AND q.greasy
 UNION ALL SELECT *, 'steric' FROM d WHERE p.radius + q.radius - d > 0.6 AND NOT (p.t = 5 AND q.t = 5 AND d BETWEEN 1.8 AND 2.2))
SELECT chain_a, chain_b, kind, count(DISTINCT (na, nb)) AS n, round(min(d), 5) AS shortest FROM i GROUP BY 1, 2, 3""")
def a15_interaction_counts(spark, sf):
    kind = F.element_at(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("resname", "name", "element"), k, strict=True))) for k in _KINDS)), (F.col("number") % 16 + 1).cast("int"))
    atoms = _residues(spark, sf, 40.0).drop("resname", "name", "element").withColumn("k", kind).select("*", "k.*").drop("k")
    t = contacts.interaction_counts(contacts.interactions(atoms))
    return t.select("chain_a", "chain_b", "kind", "n", F.round("shortest", 5).alias("shortest"))


# Residues are eight points each, spread wide, so that a scan often meets a pair beyond twice the cutoff before one within it.
@query("""WITH a AS (SELECT label % 4 AS place, vec_id // 32 AS number, vec_id AS ord, vec_id % 101 AS plddt, row_number() OVER (PARTITION BY label % 4, vec_id // 32 ORDER BY vec_id) = 1 AS ca, [60 * CAST(embedding[1] AS DOUBLE), 60 * CAST(embedding[2] AS DOUBLE), 60 * CAST(embedding[3] AS DOUBLE)] AS c FROM embeddings),
d AS (SELECT p.place AS c1, p.number AS n1, q.place AS c2, q.number AS n2, list_distance(p.c, q.c) AS d, row_number() OVER (PARTITION BY p.place, p.number, q.place, q.number ORDER BY p.ord, q.ord) AS i FROM a p JOIN a q ON p.place <> q.place),
t AS (SELECT c1, n1, c2, n2 FROM d GROUP BY ALL HAVING min(i) FILTER (d < 6) < coalesce(min(i) FILTER (d > 12), 1000000)), r AS (SELECT place, number, plddt FROM a WHERE ca),
o AS (SELECT DISTINCT c1, n1 FROM t), l AS (SELECT DISTINCT c1, n2 + 10000 * c2 AS n, c2 FROM t),
m AS (SELECT c1, plddt FROM o JOIN r ON r.place = c1 AND r.number = n1 UNION ALL SELECT c1, plddt FROM l JOIN r ON r.number = l.n AND r.place <> c1 AND l.c2 <= r.place),
b AS (SELECT c1, avg(plddt) AS p FROM m GROUP BY 1), k AS (SELECT c1, count(*) AS n FROM (SELECT c1, n1 FROM o UNION ALL SELECT c1, n FROM l) GROUP BY 1)
SELECT 'C' || place AS chain, coalesce(n, 0) AS n_residues, round(coalesce(p, 0), 9) AS interface_plddt, round(avg(plddt), 9) AS mean_plddt, round(0.702605033 / (1 + exp(-0.0270621128 * (coalesce(ln(n) * p, 0) - 291.749822))) + 0.0225416051, 9) AS score
FROM r LEFT JOIN b ON b.c1 = place LEFT JOIN k ON k.c1 = place GROUP BY place, n, p""")
def a20_legacy_score(spark, sf):
    t = _residues(spark, sf, 60.0).withColumns({"ord": F.col("number"), "place": F.substring("chain", 2, 1).cast("int")}).withColumn("number", F.floor(F.col("number") / 32))
    first = F.min("ord").over(Window.partitionBy("chain", "number"))
    got = contacts.legacy_scores(t.withColumn("name", F.when(F.col("ord") == first, "CA").otherwise("X")), 6.0)
    return got.select("chain", "n_residues", *(F.round(c, 9).alias(c) for c in ("interface_plddt", "mean_plddt", "score")))


# 24 points a sphere; an atom's point is free where no other atom's grown sphere holds it.
@query(f"""WITH a AS (SELECT 'C' || (label % 4) AS chain, vec_id AS v, vec_id // 8 AS number, 40 * CAST(embedding[1] AS DOUBLE) AS x, 40 * CAST(embedding[2] AS DOUBLE) AS y, 40 * CAST(embedding[3] AS DOUBLE) AS z, CASE vec_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'N' WHEN 2 THEN 'O' ELSE 'S' END AS element,
 1.4 + CASE vec_id % 4 WHEN 0 THEN 1.7 WHEN 1 THEN 1.55 WHEN 2 THEN 1.52 ELSE 1.8 END AS r FROM embeddings),
s AS (SELECT k, (k + 0.5) * (2.0 / 24) - 1 AS py, sqrt(1 - ((k + 0.5) * (2.0 / 24) - 1) ** 2) AS pr, k * pi() * (3 - sqrt(5)) AS phi FROM (SELECT unnest(range(24)) AS k)),
p AS (SELECT a.chain, v, number, element, r, k, x + r * pr * cos(phi) AS qx, y + r * py AS qy, z + r * pr * sin(phi) AS qz FROM a, s),
h AS (SELECT p.chain, p.v, p.k, b.chain AS other FROM p JOIN a b ON b.v <> p.v AND (b.x - qx) ** 2 + (b.y - qy) ** 2 + (b.z - qz) ** 2 < b.r ** 2 GROUP BY ALL),
f AS (SELECT p.* FROM p ANTI JOIN h ON h.v = p.v AND h.k = p.k AND h.other = p.chain), c AS (SELECT DISTINCT chain FROM a), g AS (SELECT l.chain AS chain_a, r.chain AS chain_b FROM c l JOIN c r ON l.chain < r.chain),
w AS (SELECT chain_a, chain_b, f.chain, number, element, 4 * pi() / 24 * r * r AS area, EXISTS (SELECT 1 FROM h WHERE h.v = f.v AND h.k = f.k AND h.other = CASE WHEN f.chain = chain_a THEN chain_b ELSE chain_a END) AS hid FROM f JOIN g ON f.chain IN (chain_a, chain_b)),
e AS (SELECT DISTINCT chain_a, chain_b, a.chain, number FROM a JOIN g ON a.chain IN (chain_a, chain_b)),
t AS (SELECT chain_a, chain_b, chain, number, sum(area) AS iso, sum(CASE WHEN hid THEN 0 ELSE area END) AS com, sum(CASE WHEN hid AND element IN ('C', 'S') THEN area ELSE 0 END) AS np FROM w GROUP BY ALL)
SELECT chain_a, chain_b, chain, number, round(coalesce(iso, 0), 6) AS sasa_isolated, round(coalesce(com, 0), 6) AS sasa_complex, round(coalesce(iso - com, 0), 6) + 0.0 AS buried_area, round(coalesce(np, 0), 6) AS buried_nonpolar_area FROM e LEFT JOIN t USING (chain_a, chain_b, chain, number)""")
def g37_burial(spark, sf):
    v = F.col("number")
    element = F.element_at(F.array(*map(F.lit, ("C", "N", "O", "S"))), (v % 4 + 1).cast("int"))
    atoms = _residues(spark, sf, 40.0).withColumns({"element": element, "name": v.cast("string")}).withColumn("number", F.floor(v / 8))
    t = contacts.burial(atoms, points=24)
    return t.select("chain_a", "chain_b", "chain", "number", *(F.round(c, 6).alias(c) for c in ("sasa_isolated", "sasa_complex", "buried_area", "buried_nonpolar_area")))


# C0 has a residue of another kind beside phosphates, C1 none that is modified, the others phosphates only.
@query(f"""WITH {_ATOMS.format(s=1)}, k AS (SELECT *, CASE WHEN t = 3 AND chain = 'C0' AND number % 10 = 3 THEN 5 ELSE t END AS u FROM a WHERE chain <> 'C1' OR t <> 3),
g AS (SELECT chain, count(*) AS n, avg(CASE u WHEN 0 THEN -3.9 WHEN 1 THEN -3.5 WHEN 2 THEN 1.8 WHEN 4 THEN -0.8 END) AS h, CAST(sum(CASE u WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS BIGINT) AS q, count(*) FILTER (u = 3) AS p, count(*) FILTER (u = 5) AS x FROM k GROUP BY 1)
SELECT chain, n, CASE WHEN p + x = 0 THEN round(h, 9) END AS hydropathy, CASE WHEN p + x = 0 THEN q END AS charge, p AS phosphates, x AS unknown, CASE WHEN x = 0 AND p > 0 THEN q - p END AS charge_phosphate_1, CASE WHEN x = 0 AND p > 0 THEN q - 2 * p END AS charge_phosphate_2 FROM g""")
def a16_composition(spark, sf):
    r = _residues(spark, sf).where("chain <> 'C1' OR resname <> 'SEP'")
    r = r.withColumn("resname", F.when((F.col("resname") == "SEP") & (F.col("chain") == "C0") & (F.col("number") % 10 == 3), "MSE").otherwise(F.col("resname")))
    return contacts.composition(r, "chain").withColumn("hydropathy", F.round("hydropathy", 9))


@query(f"WITH {_ATOMS.format(s=1)} SELECT 'm' AS model, count(*) FILTER (plddt > 90) AS very_high, count(*) FILTER (plddt > 70 AND plddt <= 90) AS high, count(*) FILTER (plddt > 50 AND plddt <= 70) AS low, count(*) FILTER (plddt <= 50) AS very_low FROM a")
def a20_quality_bins(spark, sf):
    return contacts.quality_bins(_residues(spark, sf))


@query("""WITH s AS (SELECT vec_id, 'C' || (label % 4) AS chain FROM embeddings) SELECT vec_id AS number, 'there' AS what FROM s WHERE chain = 'C2' AND vec_id BETWEEN 3 AND 150 UNION ALL SELECT i, 'missing' FROM generate_series(3, 150) g(i) WHERE i NOT IN (SELECT vec_id FROM s WHERE chain = 'C2')""")
def p14_regions(spark, sf):
    r = _residues(spark, sf)
    there = contacts.select_region(r, "C2", 3, 150).select("number", F.lit("there").alias("what"))
    return there.unionByName(contacts.missing_positions(r, "C2", 3, 150).select(F.col("number").cast("long").alias("number"), F.lit("missing").alias("what")))


@query(f"""WITH {_ATOMS.format(s=20)}, p AS (SELECT p.chain AS chain_a, q.chain AS chain_b, p.number AS number_a, q.number AS number_b, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 AS d2, p.number % 3 AS s FROM a p JOIN a q ON p.chain < q.chain AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 2.25)
SELECT chain_a, chain_b, number_a, number_b, CASE WHEN d2 <= 1.44 AND s > 0 AND NOT s < 2 THEN 'lost' WHEN d2 <= 1.44 AND s > 0 THEN 'kept' ELSE 'gained' END AS change FROM p WHERE (d2 <= 1.44 AND s > 0) OR s < 2""")
def u03_contact_changes(spark, sf):
    r = _residues(spark, sf)
    got = contacts.changed_contacts(r, r, (1.2, 1.5), (F.expr("a.number % 3 > 0"), F.expr("a.number % 3 < 2")))
    return got.select("chain_a", "chain_b", "number_a", "number_b", "change")


@query("""WITH r AS (SELECT vec_id AS number, 'C' || (label % 4) AS chain, row_number() OVER (PARTITION BY label % 4 ORDER BY vec_id) AS i FROM embeddings), s AS (SELECT * FROM r WHERE number % 9 = 0)
SELECT r.chain AS chain, r.number AS number, bool_or(r.i < s.i) AS upstream, bool_or(r.i > s.i) AS downstream FROM r JOIN s USING (chain) WHERE r.number % 9 <> 0 AND abs(s.i - r.i) <= 2 GROUP BY 1, 2""")
def g36_flanks(spark, sf):
    r = _residues(spark, sf)
    return contacts.flanks(r.where("number % 9 = 0"), r, 2).select("chain", "number", "upstream", "downstream")


@query(f"""WITH {_ATOMS.format(s=20)} SELECT chain, number FROM a WHERE number % 9 = 0 UNION SELECT q.chain, q.number FROM a p JOIN a q ON p.chain = q.chain AND p.number % 9 = 0 AND q.number % 9 <> 0 AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 2.25""")
def g38_salt_patch(spark, sf):
    r = _residues(spark, sf)
    return contacts.salt_patch(r.where("number % 9 = 0"), r, 1.5).select("chain", "number")


@query("""WITH f AS (SELECT o_orderkey, [CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END, CASE WHEN o_orderkey % 4 = 0 THEN 'C' ELSE 'A' END, CASE WHEN o_orderkey % 5 = 0 THEN 'D' ELSE 'A' END] AS i FROM orders)
SELECT o_orderkey, 'any' AS what FROM f WHERE list_has_any(i, ['C', 'D']) UNION ALL SELECT o_orderkey, 'only' FROM f WHERE list_has_all(['A', 'B'], i) AND len(list_distinct(i)) <= 1""")
def p18_select_folds(spark, sf):
    pick = lambda test, a, b: F.when(test, a).otherwise(b)
    f = read(spark, sf, "orders").select(_k(), F.array(pick(_c() % 3 == 0, "A", "B"), pick(_k() % 4 == 0, "C", "A"), pick(_k() % 5 == 0, "D", "A")).alias("inputs"))
    some, only = classify.select_folds(f, ["C", "D"]), classify.select_folds(f, ["A", "B"], every=True, max_chains=3, max_inputs=1)
    return some.select("o_orderkey", F.lit("any").alias("what")).unionByName(only.select("o_orderkey", F.lit("only").alias("what")))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS model_id, CAST(o_orderkey % 100 AS DECIMAL(18, 6)) * 8 + CAST(o_custkey % 10 AS DECIMAL(18, 6)) * 2 AS score FROM orders WHERE o_orderkey % 7 > 0)
SELECT o_custkey, o_orderkey AS ord FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey, model_id) AS k FROM s) WHERE k = 1""")
def a19_best_models(spark, sf):
    r = read(spark, sf, "orders").select("o_custkey", _k().alias("ord"), (_k() % 3).alias("model_id"), F.when(_k() % 7 > 0, _k() % 100 / 100).alias("iptm"), (_c() % 10 / 100).alias("ptm"))
    return classify.best_models(r, ["o_custkey"]).select("o_custkey", "ord")


_RULES = [
    ("DD", "Ia", "alpha1", "2", "mandatory"), ("DD", "Ia", "alpha2", "3", "alternative_or"), ("DD", "Ia", "alpha3", "1", "alternative_or"), ("DD", "Ib", "alpha2", "2", "mandatory"), ("DD", "Ib", "alpha4", "1", "optional"),
    ("DD", "IIa", "alpha1", "2", "mandatory"), ("DD", "IIIa", "alpha1", "2", "mandatory"), ("CARD", "IIb", "alpha1", "4", "mandatory"), ("CARD", "IIb", "alpha2", "2", "mandatory"), ("CARD", "IIIb", "alpha5", "1", "mandatory"),
]


# Coverage is contacting residues over all residues of an element (may exceed 1 in these tables); IIa and IIIa always tie and follow the order of faces.
@query("""WITH c AS (SELECT 'c' || o_custkey AS chain, CASE WHEN o_custkey % 3 = 0 THEN 'CARD' ELSE 'DD' END AS domain, 4 + o_custkey % 3 AS s1, o_custkey % 4 AS s2, 9 AS s3, count(*) FILTER (o_orderkey % 4 = 0) AS n1, count(*) FILTER (o_orderkey % 4 = 1) AS n2, count(*) FILTER (o_orderkey % 4 = 2) AS n3 FROM orders GROUP BY ALL),
v AS (SELECT *, n1 / s1 AS v1, CASE WHEN s2 > 0 THEN n2 / s2 ELSE 0 END AS v2, n3 / s3 AS v3 FROM c),
f AS (SELECT chain, 'Ia' AS face, 1 AS place, n1 >= 2 AND (n2 >= 3 OR n3 >= 1) AS whole, n1 + n2 + n3 > 0 AS touched, least(v1, greatest(v2, v3)) AS low, (v1 + greatest(v2, v3)) / 2 AS mean FROM v WHERE domain = 'DD'
 UNION ALL SELECT chain, 'Ib', 2, n2 >= 2, n2 > 0, v2, v2 FROM v WHERE domain = 'DD' UNION ALL SELECT chain, 'IIa', 3, n1 >= 2, n1 > 0, v1, v1 FROM v WHERE domain = 'DD'
 UNION ALL SELECT chain, 'IIIa', 5, n1 >= 2, n1 > 0, v1, v1 FROM v WHERE domain = 'DD' UNION ALL SELECT chain, 'IIb', 4, n1 >= 4 AND n2 >= 2, n1 + n2 > 0, least(v1, v2), (v1 + v2) / 2 FROM v WHERE domain = 'CARD'),
g AS (SELECT chain, list(face || CASE WHEN whole THEN '' ELSE ' (partial)' END ORDER BY NOT whole, low DESC, mean DESC, place) AS faces FROM f WHERE touched GROUP BY 1)
SELECT c.chain, coalesce(faces, []) AS faces FROM c LEFT JOIN g USING (chain)""")
def g43_faces(spark, sf):
    table = spark.createDataFrame(_RULES, "domain string, face string, element string, min_residues string, requirement_type string").withColumn("min_residues", F.col("min_residues").cast("int"))
    o = read(spark, sf, "orders").select(F.concat(F.lit("c"), _c()).alias("chain"), F.when(_c() % 3 == 0, "CARD").otherwise("DD").alias("domain"), _k(), _c())
    sizes = {"alpha1": 4 + _c() % 3, "alpha2": _c() % 4, "alpha3": F.lit(9), "alpha4": F.lit(5)}
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("element"), (_k() % 4 == i).cast("int").alias("n"), s.cast("long").alias("size")) for i, (e, s) in enumerate(sizes.items()))))
    return classify.faces(table, o.select("chain", "domain", each.alias("e")).groupBy("chain", "domain", "e.element").agg(F.sum("e.n").alias("n"), F.max("e.size").alias("size")))


# Rows of the rules table with a fault each, by order number.
@query("""WITH r AS (SELECT 'D' || o_orderkey AS domain, 'Ia' AS face, 'alpha1' AS element, '3' AS m, 'mandatory' AS kind, o_orderkey AS k, 0 AS copy FROM orders
 UNION ALL SELECT 'D' || o_orderkey, 'Ia', 'alpha1', '1', 'mandatory', o_orderkey, 1 FROM orders WHERE o_orderkey % 9 = 7),
f AS (SELECT CASE WHEN k % 9 = 1 AND copy = 0 THEN NULL ELSE domain END AS domain, CASE WHEN k % 9 = 2 THEN 'IVa' ELSE face END AS face, CASE WHEN k % 9 = 3 THEN 'alpha7' ELSE element END AS element,
 CASE WHEN k % 9 = 4 THEN '2.5' WHEN k % 9 = 5 THEN '0' ELSE m END AS m, CASE WHEN k % 9 = 6 THEN 'optional' WHEN k % 9 = 8 THEN 'maybe' ELSE kind END AS kind, k FROM r)
SELECT domain, face, element, CASE k % 9 WHEN 1 THEN 'incomplete' WHEN 2 THEN 'face' WHEN 3 THEN 'element' WHEN 4 THEN 'min_residues' WHEN 5 THEN 'min_residues' WHEN 7 THEN 'duplicate' WHEN 8 THEN 'requirement' END AS problem FROM f WHERE k % 9 NOT IN (0, 6)
UNION ALL SELECT domain, face, NULL, 'only optional' FROM f WHERE k % 9 = 6""")
def s29_rule_problems(spark, sf):
    o, r = read(spark, sf, "orders"), _k() % 9
    good = o.select(_k(), F.lit("3").alias("m"), F.lit(0).alias("copy")).unionByName(o.where(r == 7).select(_k(), F.lit("1").alias("m"), F.lit(1).alias("copy")))
    pick = lambda n, bad, right: F.when(r == n, bad).otherwise(right)
    rows = good.select(
        pick(1, None, F.concat(F.lit("D"), _k())).alias("domain"), pick(2, "IVa", "Ia").alias("face"), pick(3, "alpha7", "alpha1").alias("element"),
        F.when(r == 4, "2.5").when(r == 5, "0").otherwise(F.col("m")).alias("min_residues"), F.when(r == 6, "optional").when(r == 8, "maybe").otherwise("mandatory").alias("requirement_type"),
    )
    return classify.rule_problems(rows)


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ['Ia'] WHEN 1 THEN ['Ia (partial)', 'IIa'] WHEN 2 THEN ['none'] WHEN 3 THEN [] ELSE NULL END AS a, CASE o_custkey % 4 WHEN 0 THEN ['Ib'] WHEN 1 THEN ['Ib (partial)'] WHEN 2 THEN ['IIb', 'Ia'] ELSE ['IIIa'] END AS b FROM orders)
SELECT o_orderkey, CASE WHEN a IS NULL THEN NULL WHEN len(a) = 0 OR list_contains(a, 'none') THEN 'None'
 WHEN (list_contains(a, 'Ia') AND list_contains(b, 'Ib')) OR (list_contains(a, 'IIa') AND list_contains(b, 'IIb')) THEN 'Canonical'
 WHEN (len(list_filter(a, lambda x: starts_with(x, 'Ia'))) > 0 AND len(list_filter(b, lambda x: starts_with(x, 'Ib'))) > 0) THEN 'Variant' ELSE 'Atypical' END AS face_class FROM x""")
def g44_face_class(spark, sf):
    arr = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    a = F.when(_k() % 5 == 0, arr("Ia")).when(_k() % 5 == 1, arr("Ia (partial)", "IIa")).when(_k() % 5 == 2, arr("none")).when(_k() % 5 == 3, arr())
    b = F.when(_c() % 4 == 0, arr("Ib")).when(_c() % 4 == 1, arr("Ib (partial)")).when(_c() % 4 == 2, arr("IIb", "Ia")).otherwise(arr("IIIa"))
    return read(spark, sf, "orders").select(_k(), classify.face_class(a, b).alias("face_class"))


@query("""WITH d AS (SELECT 'm' || (o_orderkey % 4) AS model, 'C' || (o_custkey % 9) AS chain, 'n' || (o_custkey % 30) AS name FROM orders)
SELECT model, chain, name, CASE WHEN chain IN ('C0', 'C1') THEN 'over' WHEN model = 'm2' AND chain = 'C3' THEN 'told' WHEN name IN (SELECT 'n' || n_nationkey FROM nation) THEN 'table' END AS domain, CASE WHEN NOT (chain IN ('C0', 'C1') OR (model = 'm2' AND chain = 'C3') OR name IN (SELECT 'n' || n_nationkey FROM nation)) THEN 'no domain' END AS problem FROM d""")
def j19_domains(spark, sf):
    chains = read(spark, sf, "orders").select(F.concat(F.lit("m"), _k() % 4).alias("model"), F.concat(F.lit("C"), _c() % 9).alias("chain"), F.concat(F.lit("n"), _c() % 30).alias("name"))
    over = spark.createDataFrame([("C0", "over"), ("C1", "over")], "chain string, domain string")
    told = spark.createDataFrame([("m2", "C3", "told"), ("m2", "C0", "told")], "model string, chain string, domain string")
    table = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.lit("table").alias("domain"))
    return classify.domain_of_chain(chains, over, told, table)


@query("""WITH g AS (SELECT o_custkey, list_sort(list('o' || o_orderkey)) AS l FROM orders GROUP BY 1) SELECT o_custkey, left(sha256('["tag","id' || o_custkey || '","m",[' || array_to_string(['"' || x || '"' for x in l], ',') || ']]'), 32) AS patch FROM g""")
def g46_patch_id(spark, sf):
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("o"), _k())).alias("l"))
    return g.select("o_custkey", classify.patch_id("tag", F.concat(F.lit("id"), _c()), F.lit("m"), F.col("l")).alias("patch"))


@query("""WITH p AS (SELECT 'm' || (o_custkey % 50) AS model, 'p' || o_orderkey AS patch, 'A:' || (o_orderkey * 7919 % 1000003) || ',B:' || o_orderkey AS residues, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 9 END AS score, o_custkey % 5 AS contacts, CASE WHEN o_orderkey % 3 = 0 THEN 'split' ELSE 'leaf' END AS status FROM orders)
SELECT model, patch, CAST(row_number() OVER w AS INT) AS rank, CASE WHEN status = 'leaf' THEN CAST(sum(CASE WHEN status = 'leaf' THEN 1 ELSE 0 END) OVER w AS BIGINT) END AS leaf_rank FROM p WINDOW w AS (PARTITION BY model ORDER BY coalesce(score, -1) DESC, contacts DESC, residues)""")
def w09_patch_ranks(spark, sf):
    residues = F.concat(F.lit("A:"), _k() * 7919 % 1_000_003, F.lit(",B:"), _k())
    p = read(spark, sf, "orders").select(F.concat(F.lit("m"), _c() % 50).alias("model"), F.lit("A").alias("chain_a"), F.lit("B").alias("chain_b"), F.concat(F.lit("p"), _k()).alias("patch"), residues.alias("residues"), F.when(_k() % 11 > 0, _k() % 9).alias("score"), (_c() % 5).alias("contacts"), F.when(_k() % 3 == 0, "split").otherwise("leaf").alias("status"))
    return contacts.patch_ranks(p).select("model", "patch", "rank", "leaf_rank")


# Chains of helices (60 residues of an order each, by rule of its key) whose kinks are 1 or 2 residues long, of a good or a bad code, some bent, some short.
_HELIX = """o AS (SELECT o_orderkey AS k FROM orders), n AS (SELECT k, i, i % 20 AS j, i // 20 AS seg FROM o, (SELECT unnest(generate_series(1, 59)) AS i)),
c AS (SELECT k, i, CASE WHEN j = 0 OR (j = 1 AND k % 4 = 1) THEN CASE WHEN k % 5 = 2 THEN 'G' WHEN k % 5 = 3 AND seg = 1 THEN NULL ELSE substr('-TS', CAST(1 + k % 3 AS INT), 1) END WHEN k % 7 = 3 AND j > 3 AND seg = 1 THEN 'E' ELSE 'H' END AS code,
 {coords} FROM n)"""


@query(f"""WITH {_HELIX.format(coords="0 AS x")}, s AS (SELECT k, i, coalesce(code, '?') AS code, i - row_number() OVER (PARTITION BY k, coalesce(code, '?') ORDER BY i) AS g FROM c),
r AS (SELECT k, code, min(i) AS a, max(i) AS b FROM s GROUP BY k, code, g), h AS (SELECT *, lead(a) OVER (PARTITION BY k ORDER BY a) AS a2, lead(b) OVER (PARTITION BY k ORDER BY a) AS b2 FROM r WHERE code = 'H'),
j AS (SELECT *, b - a < 3 OR b2 - a2 < 3 AS short FROM h WHERE a2 - b = 2 AND EXISTS (SELECT 1 FROM c WHERE c.k = h.k AND c.i = h.b + 1 AND c.code IN ('-', 'T', 'S'))),
p AS (SELECT c.k, c.i, 2.3 * cos(i * 1.7) AS x, 2.3 * sin(i * 1.7) AS y, 1.5 * i AS z, i // 20 = 1 AND k % 3 = 1 AS tilt FROM c),
q AS (SELECT k, i, x, CASE WHEN tilt THEN z ELSE y END AS y, CASE WHEN tilt THEN -y ELSE z END AS z FROM p),
d AS (SELECT k, i, [lead(x) OVER w - x, lead(y) OVER w - y, lead(z) OVER w - z] AS d FROM q WINDOW w AS (PARTITION BY k ORDER BY i)),
e AS (SELECT k, i, [d2[1] - d[1], d2[2] - d[2], d2[3] - d[3]] AS u, [d3[1] - d2[1], d3[2] - d2[2], d3[3] - d2[3]] AS v, [d[1] + d2[1] + d3[1], d[2] + d2[2] + d3[2], d[3] + d2[3] + d3[3]] AS w FROM (SELECT k, i, d, lead(d) OVER x AS d2, lead(d, 2) OVER x AS d3 FROM d WINDOW x AS (PARTITION BY k ORDER BY i))),
f AS (SELECT k, i, [u[2] * v[3] - u[3] * v[2], u[3] * v[1] - u[1] * v[3], u[1] * v[2] - u[2] * v[1]] AS n, w FROM e WHERE v[3] IS NOT NULL AND w[3] IS NOT NULL),
ax AS (SELECT k, i, list_transform(n, lambda t: t / sqrt(list_dot_product(n, n)) * CASE WHEN list_dot_product(n, w) > 0 THEN 1 ELSE -1 END) AS axis FROM f)
SELECT CAST(j.k AS VARCHAR) AS model, a AS left_start, b AS left_end, a2 AS right_start, b2 AS right_end, CASE WHEN NOT short THEN round(degrees(acos(greatest(least(list_dot_product(l.axis, r.axis), 1), -1))), 6) END AS degrees,
 NOT short AND degrees(acos(greatest(least(list_dot_product(l.axis, r.axis), 1), -1))) < 70 AS merged FROM j LEFT JOIN ax l ON l.k = j.k AND l.i = j.b - 3 LEFT JOIN ax r ON r.k = j.k AND r.i = j.a2""")
def g42_kinks(spark, sf):
    t = helices.judged_kinks(_helices(spark, sf))
    return t.select("model", *(F.col(c).cast("long").alias(c) for c in ("left_start", "left_end", "right_start", "right_end")), F.round("degrees", 6).alias("degrees"), "merged")


def _helices(spark, sf) -> DataFrame:
    k, i = _k(), F.col("i")
    n = read(spark, sf, "orders").select(k, F.explode(F.sequence(F.lit(1), F.lit(59))).alias("i"))
    j, seg = i % 20, F.floor(i / 20)
    mark = F.when(k % 5 == 2, "G").when((k % 5 == 3) & (seg == 1), None).otherwise(F.substring(F.lit("-TS"), (1 + k % 3).cast("int"), F.lit(1)))
    code = F.when((j == 0) | ((j == 1) & (k % 4 == 1)), mark).when((k % 7 == 3) & (j > 3) & (seg == 1), "E").otherwise("H")
    tilt = (seg == 1) & (k % 3 == 1)
    x, y, z = 2.3 * F.cos(i * 1.7), 2.3 * F.sin(i * 1.7), 1.5 * i
    return n.select(k.cast("string").alias("model"), F.lit("A").alias("chain"), i.alias("number"), code.alias("code"), x.alias("x"), F.when(tilt, z).otherwise(y).alias("y"), F.when(tilt, -y).otherwise(z).alias("z"))


# Merging by recursion over the helices in order: a helix goes on where the kink before it was judged good (60 or 70 degrees apart it isn't).
@query(f"""WITH {_HELIX.format(coords="0 AS x")}, s AS (SELECT k, i, coalesce(code, '?') AS code, i - row_number() OVER (PARTITION BY k, coalesce(code, '?') ORDER BY i) AS g FROM c),
r AS (SELECT k, code, min(i) AS a, max(i) AS b FROM s GROUP BY k, code, g), h AS (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0 FROM r WHERE code = 'H' WINDOW w AS (PARTITION BY k ORDER BY a)),
m AS (SELECT k, a, b, CASE WHEN a - b0 = 2 AND b0 - a0 >= 3 AND b - a >= 3 AND k % 3 <> 1 AND EXISTS (SELECT 1 FROM c WHERE c.k = h.k AND c.i = h.b0 + 1 AND c.code IN ('-', 'T', 'S')) THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT k, min(a) AS a, max(b) AS b, count(*) AS parts FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a) AS g FROM m) GROUP BY k, g),
o2 AS (SELECT k, 'H' AS code, a, b FROM g UNION ALL SELECT k, code, a, b FROM r WHERE code <> 'H' AND NOT EXISTS (SELECT 1 FROM g WHERE g.k = r.k AND g.parts > 1 AND r.a BETWEEN g.a AND g.b)),
l AS (SELECT *, CASE WHEN code = 'H' THEN 'alpha' WHEN code IN ('-', 'T', 'S') THEN 'loop' END AS f FROM o2)
SELECT CAST(k AS VARCHAR) AS model, code, a AS "start", b AS "end", f || row_number() OVER (PARTITION BY k, f ORDER BY a) AS label FROM l""")
def g42_helices(spark, sf):
    return helices.normalized(_helices(spark, sf)).select("model", "code", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label")


@query("""WITH c AS (SELECT 'C' || o_orderkey AS chain, o_orderkey AS ord, 'SEQ' || (o_custkey % 40) AS sequence, CASE WHEN o_custkey % 2 = 0 THEN 'HHHEE-' ELSE 'HE----' END AS assignment FROM orders)
SELECT sequence, assignment, list(chain ORDER BY ord) AS chains, CASE WHEN assignment = 'HHHEE-' THEN 50.0 ELSE 100.0 / 6 END AS helix, CASE WHEN assignment = 'HHHEE-' THEN 100.0 / 3 ELSE 100.0 / 6 END AS strand, CASE WHEN assignment = 'HHHEE-' THEN 100.0 / 6 ELSE 200.0 / 3 END AS other FROM c GROUP BY 1, 2""")
def a21_secondary_structure(spark, sf):
    c = read(spark, sf, "orders").select(F.concat(F.lit("C"), _k()).alias("chain"), _k().alias("ord"), F.concat(F.lit("SEQ"), _c() % 40).alias("sequence"), F.when(_c() % 2 == 0, "HHHEE-").otherwise("HE----").alias("assignment"))
    return classify.secondary_structure(c)


@query("""WITH s AS (SELECT item_id AS k, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAN') AS s FROM benchmark),
x AS (SELECT DISTINCT k, substr(s, CAST(i AS INT), 11) AS w FROM (SELECT k, s, unnest(generate_series(1, length(s) - 10)) AS i FROM s)),
y AS (SELECT DISTINCT k, z, substr(s, CAST(i AS INT), 11) AS w FROM (SELECT k, z, s, unnest(generate_series(1, length(s) - 10)) AS i FROM (SELECT k, '+' AS z, s FROM s UNION ALL SELECT k, '-', reverse(translate(s, 'ACGT', 'TGCA')) FROM s))),
n AS (SELECT x.k AS a, y.k AS b, z, count(*) AS n FROM x JOIN y USING (w) GROUP BY ALL HAVING count(*) >= 3) SELECT a AS transcript, b AS locus, max(n) AS n FROM n GROUP BY 1, 2""")
def j15_alignment_pairs(spark, sf):
    d = _text(spark, sf, "benchmark", "item_id").select(F.col("k").alias("id"), F.translate("u", _ALL, _TO).alias("sequence"))
    return G.alignment_pairs(d, d, 11, 3).select("transcript", "locus", "n")
