"""Queries through the readers: lines are spelled out from the driver's tables, the SQL says what they should be read as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..functions import accessions, sequences
from ..operators import hits as H
from ..operators import tables as T
from ..sources import folds, text
from ..sources import tables as S
from .registry import HITS, hits, query, read

def _letters() -> Column:
    return F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))



def _lines(df: DataFrame, file, *rows) -> DataFrame:
    """file, ord, line of rows (ord, line); a null line isn't there."""
    each = F.array(*(F.struct(o.cast("long").alias("ord"), (F.lit(t) if isinstance(t, str) else t).cast("string").alias("line")) for o, t in rows))
    return df.select(file.alias("file"), F.explode(each).alias("r")).select("file", "r.ord", "r.line").where("line IS NOT NULL")


def _records(spark, sf, files: int, header=None, sequence=None) -> DataFrame:
    """FASTA records of the documents: a header, the sequence on two lines, and blank lines where it is empty."""
    d, k = read(spark, sf, "documents"), F.col("doc_id")
    s = F.when(k % 11 == 0, "").when(k % 2 == 0, F.translate(_letters(), "BJOUXZ", "ACDEFG")).otherwise(_letters()) if sequence is None else sequence
    h = F.concat_ws(" ", F.concat(F.lit("P"), k % 400), "lang", "source") if header is None else header
    d = d.select(k, s.alias("s"), h.alias("h"))
    half = F.floor(F.length("s") / 2).cast("int")
    return text.fasta(_lines(d, F.concat(F.lit("f"), k % files), (k * 3, F.concat(F.lit(">"), "h")), (k * 3 + 1, F.substring("s", F.lit(1), half)), (k * 3 + 2, F.substring("s", half + 1, F.length("s")))))


_FA = """fa AS (SELECT doc_id, 'f' || (doc_id % {n}) AS file, 'P' || (doc_id % 400) AS id, lang || ' ' || source AS description, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 2 = 0 THEN translate(u, 'BJOUXZ', 'ACDEFG') ELSE u END AS sequence,
 row_number() OVER (PARTITION BY doc_id % {n} ORDER BY doc_id) - 1 AS ord FROM (SELECT *, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS u FROM documents))"""


@query(f"""WITH {_FA.format(n=7)} SELECT file, ord, id, description, md5(sequence) AS digest,
CASE WHEN row_number() OVER (PARTITION BY file, id ORDER BY ord) > 1 THEN 'duplicate' WHEN sequence = '' THEN 'empty' WHEN regexp_matches(sequence, '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'letters' END AS problem FROM fa""")
def s05_strict_proteins(spark, sf):
    return text.strict_proteins(_records(spark, sf, 7)).select("file", "ord", "id", "description", F.md5(F.col("sequence").cast("binary")).alias("digest"), "problem")


@query(f"""WITH {_FA.format(n=1)}, t AS (SELECT id, ord, replace(sequence, 'U', 'T') AS s, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM fa)
SELECT id, md5(s) AS digest, CASE WHEN regexp_matches(s, '[^ACGTRYSWKMBDHVN]') THEN 'letters' END AS problem FROM t WHERE k = 1""")
def s06_nucleotides(spark, sf):
    return text.nucleotides(_records(spark, sf, 1)).select("id", F.md5(F.col("sequence").cast("binary")).alias("digest"), "problem")


@query("SELECT o_custkey, o_orderstatus, count(*) AS n, 'orders' AS problem FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def s07_duplicates(spark, sf):
    return T.duplicates(read(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "orders")


@query("""WITH h AS (SELECT doc_id, 'P' || (doc_id % 900) || '|' || lang || CASE WHEN doc_id % 5 = 0 THEN ' x' WHEN doc_id % 7 = 0 THEN '|' || source ELSE '' END AS header FROM documents)
SELECT header, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'id' WHEN count(*) OVER (PARTITION BY header) > 1 THEN 'duplicate' END AS problem FROM h""")
def s08_described(spark, sf):
    k = F.col("doc_id")
    header = F.concat(F.lit("P"), k % 900, F.lit("|"), "lang", F.when(k % 5 == 0, " x").when(k % 7 == 0, F.concat(F.lit("|"), "source")).otherwise(""))
    return text.described(_records(spark, sf, 3, header)).select("header", "problem")


@query("""WITH r AS (SELECT 'P' || (doc_id % 700) || ' ' || lang AS header, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)
SELECT md5(header) AS value, count(*) AS n, 'header' AS problem FROM r GROUP BY header HAVING count(*) > 1 UNION ALL SELECT md5(sequence), count(*), 'sequence' FROM r GROUP BY sequence HAVING count(*) > 1""")
def s09_candidate_problems(spark, sf):
    k = F.col("doc_id")
    found = text.candidate_problems(_records(spark, sf, 3, F.concat(F.lit("P"), k % 700, F.lit(" "), "lang"), F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))))
    return found.select(F.md5(F.col("value").cast("binary")).alias("value"), "n", "problem")


@query("""WITH c AS (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'o' || min(o_orderkey) ELSE 'c' || o_custkey END AS cluster FROM orders GROUP BY 1)
SELECT 'f' || (o_custkey % 5) AS file, cluster, 'o' || o_orderkey AS member, upper(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS sequence, o_custkey % 2 = 0 AS is_member FROM orders JOIN c USING (o_custkey)""")
def s10_clusters(spark, sf):
    o, c, k = read(spark, sf, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    file = F.concat(F.lit("f"), c % 5)
    opens = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    heads = _lines(opens, file, (c * 10_000_000, F.concat(F.lit(">"), F.when(c % 2 == 0, F.concat(F.lit("o"), "first")).otherwise(F.concat(F.lit("c"), c)))))
    body = _lines(o, file, (c * 10_000_000 + k * 2 + 1, F.concat(F.lit(">o"), k)), (c * 10_000_000 + k * 2 + 2, F.upper(F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""))))
    return text.clusters(text.fasta(heads.unionByName(body))).select("file", "cluster", "member", "sequence", "is_member")


def _domains(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cells = [F.concat(F.lit("seq"), c), F.lit("-"), F.lit("100"), F.concat(F.lit("M"), k % 9), F.when(k % 4 == 0, "-").otherwise(F.concat(F.lit("PF"), k % 9)), (k % 80).cast("string"), F.concat(F.lit("1e-"), k % 9), (k % 50).cast("string"),
             F.lit("0.1"), F.lit("1"), F.lit("1"), F.lit("0.2"), F.concat(F.lit("2e-"), k % 7), (c % 60).cast("string"), F.lit("0"), F.lit("3"), (k % 90).cast("string"), F.lit("5"), (c % 95).cast("string"), F.lit("1"), F.lit("2"), F.lit("0.9"), F.lit("text of it")]
    good = F.concat_ws("   ", *cells)
    line = F.when(k % 13 == 0, F.concat(F.lit("# "), good)).when(k % 17 == 0, F.concat_ws(" ", *cells[:10])).otherwise(good)
    return text.domtblout(_lines(read(spark, sf, "orders"), F.lit("x"), (k, line)))


_DOM = """dom AS (SELECT 'x' AS file, o_orderkey AS ord, 'seq' || o_custkey AS sequence, 'M' || (o_orderkey % 9) AS model, CASE WHEN o_orderkey % 4 = 0 THEN 'M' ELSE 'PF' END || (o_orderkey % 9) AS accession, CAST(o_orderkey % 80 AS INT) AS model_length,
 CAST('1e-' || (o_orderkey % 9) AS DOUBLE) AS full_evalue, CAST(o_orderkey % 50 AS DOUBLE) AS full_score, CAST('2e-' || (o_orderkey % 7) AS DOUBLE) AS domain_evalue, CAST(o_custkey % 60 AS DOUBLE) AS domain_score,
 3 AS hmm_from, CAST(o_orderkey % 90 AS INT) AS hmm_to, 5 AS seq_from, CAST(o_custkey % 95 AS INT) AS seq_to FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0)"""


@query(f"WITH {_DOM} SELECT * FROM dom")
def s11_domtblout(spark, sf):
    return _domains(spark, sf)


@query("""WITH l AS (SELECT o_custkey % 50 AS f, o_orderkey AS ord, o_custkey, o_orderkey, min(CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey % 50) AS stop FROM orders)
SELECT 'f' || f AS file, ord, 'c' || o_custkey || chr(9) || 'o' || o_orderkey || chr(9) || 'z' AS line FROM l WHERE (stop IS NULL OR ord < stop) AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0""")
def s12_as_tsv(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    good = F.concat(F.lit("  c"), c, F.lit("    o"), k, F.lit("\t z  "))
    line = F.when(k % 19 == 0, "# Program:   x").when(k % 7 == 0, "# a comment").when(k % 5 == 0, "   ").otherwise(good)
    return text.as_tsv(_lines(read(spark, sf, "orders"), F.concat(F.lit("f"), c % 50), (k, line)))


def _thresholds(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.when(k % 23 == 0, "model threshold score_type").when(k % 29 == 0, "M1 short").otherwise(F.concat(F.lit("M"), k % 7, F.lit("  "), c % 45, F.when(c % 2 == 0, " domain").otherwise("\tfull")))
    return text.score_thresholds(_lines(read(spark, sf, "orders"), F.lit("x"), (k, line)))


_THRESHOLDS = """thr AS (SELECT model, threshold, score_type FROM (SELECT 'M' || (o_orderkey % 7) AS model, CAST(o_custkey % 45 AS DOUBLE) AS threshold, CASE WHEN o_custkey % 2 = 0 THEN 'domain' ELSE 'full' END AS score_type,
 row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0) WHERE k = 1)"""


@query(f"WITH {_THRESHOLDS} SELECT * FROM thr")
def s13_score_thresholds(spark, sf):
    return _thresholds(spark, sf)


@query(f"""WITH {_DOM}, {_THRESHOLDS} SELECT ord, sequence, model, threshold, CASE WHEN threshold IS NULL THEN 'no threshold' END AS problem FROM dom LEFT JOIN thr USING (model)
WHERE threshold IS NULL OR CASE score_type WHEN 'domain' THEN domain_score ELSE full_score END >= threshold""")
def p05_above_threshold(spark, sf):
    return text.above_threshold(_domains(spark, sf), _thresholds(spark, sf)).select("ord", "sequence", "model", "threshold", "problem")


@query("""SELECT 'chr' || (o_custkey % 6) AS seqid, CASE WHEN o_orderkey % 3 = 0 THEN 'mRNA' ELSE 'CDS' END AS type, CAST(o_orderkey AS INT) AS "start", CAST(o_orderkey + o_custkey AS INT) AS "end", CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand,
'o' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'second' ELSE 'first x' END AS note, ['p' || (o_custkey % 9), 'q'] AS parents FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def s14_gff(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    attrs = F.concat(F.lit("ID=o"), k, F.lit("; Parent=p"), c % 9, F.lit(",q ;; Note \"first x\""), F.when(k % 5 == 0, ";Note=second").otherwise(""))
    good = F.concat_ws("\t", F.concat(F.lit("chr"), c % 6), F.lit("src"), F.when(k % 3 == 0, "mRNA").otherwise("CDS"), k.cast("string"), (k + c).cast("string"), F.lit("."), F.when(k % 2 == 0, "-").otherwise("+"), F.lit("0"), attrs)
    rows = text.gff(_lines(read(spark, sf, "orders"), F.lit("x"), (k, F.when(k % 11 == 0, F.concat(F.lit("#"), good)).when(k % 13 == 0, "chr1\tshort").otherwise(good))))
    at = lambda name: F.try_element_at("attrs", F.lit(name))
    return rows.select("seqid", "type", "start", "end", "strand", at("ID").alias("id"), at("Note").alias("note"), text.values_of(F.col("attrs"), "Parent").alias("parents"))


@query("""WITH r AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN 'c' || o_custkey ELSE 'o' || o_orderkey END AS id, o_orderstatus AS localizations, o_orderkey % 4 AS s, o_totalprice FROM orders)
SELECT id, localizations, CASE s WHEN 0 THEN '' WHEN 1 THEN 'Peroxisomal' WHEN 2 THEN 'A+B' ELSE '' END AS signals, CASE WHEN s < 3 THEN o_totalprice END AS nucleus, CASE WHEN s < 3 THEN 1 ELSE 0 END AS n_scores, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate' END AS problem FROM r""")
def s15_deeploc(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(c % 7 == 0, F.concat(F.lit("c"), c)).otherwise(F.concat(F.lit("o"), k))
    table = read(spark, sf, "orders").select(
        name.alias("﻿Protein_ID"), F.col("o_orderstatus").alias("Localizations"), F.when(k % 4 == 0, None).when(k % 4 == 1, "Peroxisomal").when(k % 4 == 2, "A|B").otherwise("|").alias("Signals"),
        F.when(k % 4 < 3, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("Nucleus"), F.lit("none").alias("Membrane type"),
    )
    out = S.deeploc(table)
    return out.select("id", "localizations", F.array_join("signals", "+").alias("signals"), F.try_element_at("scores", F.lit("Nucleus")).alias("nucleus"), F.size("scores").alias("n_scores"), "problem")


@query("""SELECT 'o' || o_orderkey || '|d' || o_custkey AS accession, CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS n, CASE o_orderkey % 4 WHEN 1 THEN 'o' || o_orderkey || '_d' || o_custkey WHEN 0 THEN NULL ELSE 'o' || o_orderkey END AS call_id,
CASE WHEN o_orderkey % 4 = 3 THEN 'ambiguous' END AS problem FROM orders""")
def s16_resolve_ids(spark, sf):
    o, k, c = read(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    whole, short, safe = F.concat(F.lit("o"), k, F.lit("|d"), c), F.concat(F.lit("o"), k), F.concat(F.lit("o"), k, F.lit("_d"), c)
    calls = o.select(F.explode(F.array_compact(F.array(F.when(k % 4 >= 2, short), F.when(k % 4 == 1, safe), F.when(k % 4 == 3, whole)))).alias("id"))
    return S.resolve_ids(calls, o.select(whole.alias("accession"))).select("accession", "n", "call_id", "problem")


@query("""SELECT 'o' || o_orderkey AS id, o_orderstatus AS call, CAST(o_custkey % 100 AS DOUBLE) / 100 AS "p_noTP", CAST(o_orderkey % 50 AS DOUBLE) / 100 AS "p_SP", CASE WHEN o_orderkey % 3 > 0 THEN 0.25::DOUBLE END AS "p_mTP" FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0""")
def s17_targetp(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda x: F.format_string("%.2f", x / 100)
    good = F.concat_ws("\t", F.concat(F.lit("o"), k), "o_orderstatus", two(c % 100), two(k % 50), F.when(k % 3 > 0, "0.25").otherwise("nan?"))
    return text.targetp(_lines(read(spark, sf, "orders"), F.lit("x"), (k, F.when(k % 9 == 0, "# TargetP").when(k % 8 == 0, "a b").otherwise(good))))


@query("""SELECT 'o' || o_custkey AS sequence, CAST(o_orderkey % 500 AS INT) AS "start", CAST(o_orderkey % 500 + 9 AS INT) AS "end", 'MA' || (o_custkey % 8) || '.1' AS motif, CAST(o_orderkey % 30 AS DOUBLE) / 2 AS score, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand
FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0 AND o_orderkey % 7 <> 0""")
def s17_motif_scan(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    good = F.concat_ws(" ", F.concat(F.lit("o"), c), F.when(k % 7 == 0, "x").otherwise((k % 500).cast("string")), (k % 500 + 9).cast("string"), F.concat(F.lit("MA"), c % 8, F.lit(".1")), F.format_string("%.1f", k % 30 / 2), F.when(k % 2 == 0, "+").otherwise("-"))
    return text.motif_scan(_lines(read(spark, sf, "orders"), F.lit("x"), (k, F.when(k % 9 == 0, "sequence start end feature score strand").when(k % 8 == 0, "# none").otherwise(good))))


@query("""WITH o AS (SELECT 'f' || o_orderkey AS file, 's' || o_custkey AS id, translate(lpad(CAST(o_orderkey * 7919 % 100000000 AS VARCHAR), 8, '0'), '0123456789', 'ACD-EfG.HK') AS text, o_orderkey % 3 > 0 AS has_rf, translate(lpad(CAST(o_orderkey * 104729 % 100000000 AS VARCHAR), 8, '0'), '0123456789', 'x.x-xxxxxx') AS rf FROM orders),
c AS (SELECT file, id, i, text[i:i] AS ch, CASE WHEN has_rf THEN rf[i:i] NOT IN ('.', '-') ELSE true END AS m FROM o, (SELECT unnest(generate_series(1, 8)) AS i)),
p AS (SELECT *, sum(CAST(m AS INT)) OVER w AS k, sum(CASE WHEN ch IN ('.', '-') THEN 0 ELSE 1 END) OVER w AS pos FROM c WINDOW w AS (PARTITION BY file ORDER BY i))
SELECT file, id, CAST(k AS INT) AS hmm, CASE WHEN ch NOT IN ('.', '-') THEN CAST(pos AS INT) END AS pos, CASE WHEN ch NOT IN ('.', '-') THEN ch END AS aa FROM p WHERE m""")
def s18_alignment_map(spark, sf):
    k = F.col("o_orderkey")
    eight = lambda x, to: F.translate(F.lpad((x % 100_000_000).cast("string"), 8, "0"), "0123456789", to)
    seq, rf = eight(k * 7919, "ACD-EfG.HK"), eight(k * 104_729, "x.x-xxxxxx")
    name = F.concat(F.lit("s"), F.col("o_custkey"))
    lines = _lines(  # each sequence and its reference line in two blocks
        read(spark, sf, "orders"), F.concat(F.lit("f"), k), (F.lit(0), "# STOCKHOLM 1.0"), (F.lit(1), F.concat_ws("  ", name, F.substring(seq, 1, 5))), (F.lit(2), F.when(k % 3 > 0, F.concat(F.lit("#=GC RF  "), F.substring(rf, 1, 5)))),
        (F.lit(3), ""), (F.lit(4), F.concat_ws("  ", name, F.substring(seq, 6, 3))), (F.lit(5), F.when(k % 3 > 0, F.concat(F.lit("#=GC RF  "), F.substring(rf, 6, 3)))), (F.lit(6), "//"),
    )
    return text.alignment_map(lines).select("file", "id", F.explode("hmm").alias("hmm", "c")).select("file", "id", "hmm", "c.pos", "c.aa")


@query("""WITH p AS (SELECT o_orderkey, 'm' || (o_custkey % 40) AS model, 'C' || (o_orderkey % 3) AS chain, CAST(o_orderkey AS INT) AS number, o_orderkey % 10 AS t, CASE WHEN o_orderkey % 4 = 0 THEN 'SEP' ELSE 'ALA' END AS resname FROM orders),
n AS (SELECT *, CASE t WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS n_tokens, t <> 3 AS has_atoms FROM p)
SELECT model, chain, number, CASE WHEN has_atoms THEN resname END AS resname, CASE WHEN n_tokens > 0 THEN CAST(o_orderkey * 4 AS INT) END AS token_index, CASE WHEN n_tokens > 0 THEN n_tokens END AS n_tokens,
 CASE WHEN n_tokens = 0 THEN 'no token' WHEN NOT has_atoms THEN 'no atom' WHEN n_tokens > 1 AND resname = 'ALA' THEN 'tokens' WHEN n_tokens = 3 THEN 'modified residue' END AS problem FROM n""")
def s19_residue_tokens(spark, sf):
    k = F.col("o_orderkey")
    base = read(spark, sf, "orders").select(k, F.concat(F.lit("m"), F.col("o_custkey") % 40).alias("model"), F.concat(F.lit("C"), k % 3).alias("chain"), k.cast("int").alias("number"), F.when(k % 4 == 0, "SEP").otherwise("ALA").alias("resname"))
    atom = lambda name, element: F.struct(F.lit(name).alias("name"), F.lit(element).alias("element"))
    atoms = base.where(k % 10 != 3).select("model", "chain", "number", "resname", F.explode(F.array(atom("CA", "C"), atom("N", "N"), atom("HA", "H"))).alias("a")).select("model", "chain", "number", "resname", "a.*", *(F.lit(0.0).alias(c) for c in ("x", "y", "z")), F.lit(50.0).alias("plddt"), F.lit(None).cast("string").alias("problem"))
    n = F.when(k % 10 == 0, 0).when(k % 10 == 1, 2).when(k % 10 == 2, 3).otherwise(1)
    tokens = base.where(k % 10 != 0).select("model", "chain", "number", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), k).select("model", (k * 4 + F.col("i")).cast("int").alias("token_index"), "chain", "number", F.lit(None).cast("string").alias("problem"))
    got = folds.residues(atoms, tokens)
    return got.select("model", "chain", "number", "resname", "token_index", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"), "problem")


@query("""WITH l AS (SELECT 'd' || (o_custkey % 300) || CASE WHEN o_custkey % 2 = 0 THEN '.zip!/in' ELSE '' END AS fold, CAST(o_orderkey % 5 AS INT) AS n, o_orderkey % 10 AS kind FROM orders)
SELECT fold, list_sort(coalesce(list(DISTINCT n) FILTER (kind < 5), [])) AS models, count(DISTINCT n) FILTER (kind >= 5 AND kind < 8) AS n_summaries FROM l GROUP BY 1""")
def s22_folds(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fold = F.concat(F.lit("d"), c % 300, F.when(c % 2 == 0, ".zip!/in").otherwise(""))
    n = (k % 5).cast("string")
    name = F.when(k % 10 < 5, F.concat(F.lit("x_model_"), n, F.lit(".cif"))).when(k % 10 < 8, F.concat(F.lit("x_summary_confidences_"), n, F.lit(".json"))).otherwise("job_request.json")
    return folds.folds(read(spark, sf, "orders").select(F.concat_ws("/", fold, name).alias("locator"))).select("fold", "models", F.size("summaries").cast("long").alias("n_summaries"))


# Two models a fold (an order), in directories or archives; data, summaries and requests are missing, doubled or broken by rule of the key.
@query("""WITH o AS (SELECT o_orderkey AS k, 'r/d' || o_orderkey || CASE WHEN o_custkey % 2 = 0 THEN '.zip!/in' ELSE '' END AS d FROM orders),
m AS (SELECT k, d, n, d || '/x_model_' || n || '.cif' AS cif FROM o, (VALUES (0), (1)) v(n) UNION ALL SELECT k, d, 0, d || '/y_model_0.cif' FROM o WHERE k % 11 = 3 UNION ALL SELECT k, d, 0, d || '/model0_complex.cif' FROM o WHERE k % 11 = 4),
f AS (SELECT *, CASE WHEN cif LIKE '%/x_model%' AND NOT (k % 7 = 2 AND n = 1) THEN d || '/x_full_data_' || n || '.json' END AS data, CASE WHEN cif LIKE '%/x_model%' AND k % 5 > 0 THEN d || '/x_summary_confidences_' || n || '.json' END AS summary,
 CASE WHEN cif LIKE '%/x_model%' AND k % 6 > 0 THEN d || '/x_job_request.json' END AS request FROM m)
SELECT d AS source, CAST(n AS INT) AS model, cif, data, summary, request, CASE WHEN request IS NOT NULL AND k % 6 < 3 THEN k END AS seed,
 CASE WHEN n = 0 AND k % 11 IN (3, 4) THEN 'models' WHEN data IS NULL THEN 'data' WHEN request IS NOT NULL THEN CASE k % 6 WHEN 3 THEN 'seeds' WHEN 4 THEN 'seed' WHEN 5 THEN 'request' END END AS problem FROM f""")
def s23_models(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = F.concat(F.lit("r/d"), k, F.when(c % 2 == 0, ".zip!/in").otherwise(""))
    request = F.when(k % 6 == 1, F.concat(F.lit('[{"modelSeeds": ["'), k, F.lit('"]}]'))).when(k % 6 == 2, F.concat(F.lit('{"modelSeeds": ['), k, F.lit("]}"))).when(k % 6 == 3, '{"modelSeeds": [1, 2]}').when(k % 6 == 4, '{"modelSeeds": [-1]}').otherwise("{")
    file = lambda name, body="x", there=F.lit(True): F.when(there, F.struct(F.lit(name).alias("name"), (F.lit(body) if isinstance(body, str) else body).alias("body")))
    every = [file(f"x_model_{n}.cif") for n in (0, 1)] + [file(f"x_summary_confidences_{n}.json", there=k % 5 > 0) for n in (0, 1)]
    every += [file("x_full_data_0.json"), file("x_full_data_1.json", there=k % 7 != 2), file("x_job_request.json", request, k % 6 > 0), file("y_model_0.cif", there=k % 11 == 3), file("model0_complex.cif", there=k % 11 == 4), file("notes.txt")]
    found = read(spark, sf, "orders").select(d.alias("d"), F.explode(F.array_compact(F.array(*every))).alias("f")).select(F.concat_ws("/", "d", "f.name").alias("locator"), F.col("f.body").cast("binary").alias("content"))
    return folds.model_inputs(found)


@query("""WITH r AS (SELECT 'm' || o_orderkey AS model, CAST(o_custkey % 130 AS DOUBLE) / 100 AS iptm, o_orderkey % 5 AS kind FROM orders)
SELECT model, CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN NULL ELSE iptm END AS iptm, CASE WHEN kind IN (0, 2) THEN NULL ELSE 0.5::DOUBLE END AS ptm, CASE WHEN kind = 0 THEN 'json' WHEN kind > 1 AND iptm > 1 THEN 'range' END AS problem FROM r""")
def s24_confidence(spark, sf):
    k, two = F.col("o_orderkey"), F.format_string("%.2f", F.col("o_custkey") % 130 / 100)
    body = F.when(k % 5 == 0, "{iptm").when(k % 5 == 1, '{"iptm": null, "ptm": 0.5}').when(k % 5 == 2, F.concat(F.lit('{"iptm": '), two, F.lit(', "x": [1]}'))).otherwise(F.concat(F.lit('{"ptm": 0.5, "iptm": '), two, F.lit("}")))
    return S.confidence(read(spark, sf, "orders").select(F.concat(F.lit("m"), k).alias("model"), body.alias("json")))


@query("""SELECT 'f' || o_orderkey AS file, n AS name, CASE n WHEN 'total_score' THEN CAST(-(o_custkey % 400) AS DOUBLE) / 2 WHEN 'fa_rep' THEN CASE WHEN o_orderkey % 6 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1.5 END END AS value,
CASE WHEN o_orderkey % 5 = 0 THEN 'rows' WHEN n = 'description' OR (n = 'fa_rep' AND o_orderkey % 6 = 0) THEN 'value' END AS problem FROM orders, (VALUES ('total_score'), ('fa_rep'), ('description')) t(n)""")
def s25_scorefile(spark, sf):
    k = F.col("o_orderkey")
    data = F.concat_ws("  ", F.lit("SCORE:"), F.format_string("%.1f", -(F.col("o_custkey") % 400) / 2), F.when(k % 6 == 0, "NaN").otherwise("1.5"), F.lit("model_one"))
    lines = _lines(read(spark, sf, "orders"), F.concat(F.lit("f"), k), (F.lit(0), "SEQUENCE:"), (F.lit(1), "SCORE: total_score fa_rep   description"), (F.lit(2), data), (F.lit(3), F.when(k % 5 == 0, data)))
    return text.scorefile(lines)


@query("""WITH r AS (SELECT o_custkey % 9 AS f, row_number() OVER (PARTITION BY o_custkey % 9 ORDER BY o_orderkey) - 1 AS ord, 'o' || o_orderkey AS id, 'MKL' || repeat('A', CAST(o_custkey % 4 AS INT)) AS sequence,
 CASE WHEN o_orderkey % 6 = 0 THEN 'IIXO' ELSE repeat('M', CAST(3 + o_orderkey % 4 AS INT)) END AS labels FROM orders)
SELECT 'f' || f AS file, ord, id, sequence, labels, CASE WHEN length(sequence) <> length(labels) THEN 'length' WHEN contains(labels, 'X') THEN 'labels' END AS problem FROM r""")
def s26_topology(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    labels = F.when(k % 6 == 0, "IIXO").otherwise(F.repeat(F.lit("M"), (3 + k % 4).cast("int")))
    return text.topology(_lines(read(spark, sf, "orders"), F.concat(F.lit("f"), c % 9), (k * 5, F.concat(F.lit("> o"), k, F.lit(" | GLOB"))), (k * 5 + 1, F.concat(F.lit("MKL"), F.repeat(F.lit("A"), (c % 4).cast("int")))), (k * 5 + 2, ""), (k * 5 + 3, labels)))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS "protein accession", '' AS "genome accession", 'o' || o_orderkey AS "sequence accession", '1' AS "start label", '1' AS "start aa 1b", '' AS "protein start aa 1b", CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '9' END AS "end aa 1b" FROM orders""")
def s27_artifacts(spark, sf):
    k = F.col("o_orderkey")
    older = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("protein accession"), F.lit(None).cast("string").alias("genome accession"), F.concat(F.lit("o"), k).alias("sequence accession"), F.lit("1").alias("start label"), F.lit("1").alias("start aa 1b"), F.when(k % 2 == 1, "9").alias("end aa 1b"))
    return S.artifacts(older)


@query("""SELECT o_orderkey AS ord, 'l' || o_orderkey AS fold_locator, CASE WHEN k = 0 THEN NULL ELSE 'f' || o_custkey END AS fold_id, CASE WHEN k IN (0, 4) THEN NULL ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS model_id, CASE WHEN k IN (0, 2, 3, 4) THEN NULL ELSE 0.25::DOUBLE END AS iptm, CASE WHEN k IN (0, 4) THEN NULL ELSE 0.5::DOUBLE END AS ptm,
CASE WHEN k = 5 THEN 's1' END AS seed, CASE WHEN k = 4 THEN 'columns' WHEN k = 3 THEN 'ipTM' END AS problem FROM (SELECT *, o_orderkey % 6 AS k FROM orders)""")
def s30_records(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name, fold, model = F.concat(F.lit("l"), k), F.concat(F.lit("f"), c), (k % 5).cast("string")
    iptm = F.when(k % 6 == 2, "NA").when(k % 6 == 3, "high").otherwise("0.25")
    line = F.when(k % 6 == 0, name).when(k % 6 == 4, F.concat_ws("\t", name, fold)).when(k % 6 == 5, F.concat_ws("\t", name, fold, model, iptm, F.lit("0.5"), F.lit("s1"))).otherwise(F.concat_ws("\t", name, fold, model, iptm, F.lit("0.5")))
    return S.records(_lines(read(spark, sf, "orders"), F.lit("x"), (k, line)).drop("file"))


@query("SELECT 'p' || (o_custkey % 500) AS protein, 'g' || (o_custkey % 3) AS genome, min(o_orderkey) AS ord FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey % 500, o_custkey % 3")
def s31_protein_keys(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return S.protein_keys(_lines(read(spark, sf, "orders"), F.lit("x"), (k, F.concat(F.lit("p"), c % 500, F.when(k % 7 == 0, "").otherwise("\t"), F.lit("g"), c % 3))).drop("file"))


@query("SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE '' END || o_orderpriority AS name FROM orders")
def s33_names(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return S.names(_lines(read(spark, sf, "orders"), F.lit("x"), (k * 2, F.concat(F.when(c % 2 == 0, " ").otherwise(""), "o_orderpriority")), (k * 2 + 1, "")).drop("file"))


@query("""WITH t AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'g' || (c_custkey % 200) END AS genome, c_mktsegment AS phylum, n_name AS organism, row_number() OVER (PARTITION BY c_custkey % 200 ORDER BY c_custkey DESC) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 9 <> 0)
SELECT genome, phylum, organism FROM t WHERE k = 1""")
def s04_taxonomy(spark, sf):
    k = F.col("c_custkey")
    t = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = t.select(k.alias("ord"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("g"), k % 200)).alias(" Genome Accession "), F.col("c_mktsegment").alias("Phylum"), F.col("n_name").alias("Organism"))
    return S.taxonomy(named, "ord").select("genome", "phylum", "organism")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'N'")
def s01_hits_scan(spark, sf):
    return S.hits(spark, f"{sf}/lineitem.parquet", "l_quantity > 30", "l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {HITS} SELECT query_accession, target_accession, evalue FROM hits WHERE query_database = 'R' AND query_accession IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')")
def s02_hits_of(spark, sf):
    keys = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("accession"))
    return H.hits_of(hits(spark, sf), keys, "R").select("query_accession", "target_accession", "evalue")


@query("""SELECT '>' || doc_id || chr(10) || regexp_replace(regexp_replace(u, '(.{60})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS value FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS u FROM documents)""")
def k01_fasta_lines(spark, sf):
    return sinks.fasta_lines(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("h"), _letters().alias("s")), F.col("h"), F.col("s"))


@query(f"""WITH {HITS}, s AS (SELECT CAST(doc_id AS VARCHAR) AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)
SELECT '>' || query_accession || '_PF3_' || query_start || '_' || query_end || chr(10) || substr(sequence, lo, hi - lo + 1) AS value FROM hits JOIN s ON id = query_accession WHERE target_accession = 'PF00003.1'""")
def k01_match_fasta(spark, sf):
    s = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), _letters().alias("sequence"))
    found = hits(spark, sf).where("target_accession = 'PF00003.1'")
    return sinks.match_fasta(found, s, "PF3", match_only=True)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'NA' ELSE printf('%.6f', o_totalprice / 7) END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'NA' WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS done, CASE WHEN o_orderkey % 5 = 0 THEN 'NA' ELSE CAST(o_custkey AS VARCHAR) END AS cust FROM orders""")
def k02_cells(spark, sf):
    k = F.col("o_orderkey")
    cell = lambda x, kind, n: sinks.printed(F.when(k % n != 0, x), kind)
    return read(spark, sf, "orders").select(k, cell(F.col("o_totalprice") / 7, "double", 4).alias("price"), cell(F.col("o_orderstatus") == "F", "boolean", 3).alias("done"), cell(F.col("o_custkey"), "long", 5).alias("cust"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 6 = 0)")
def k06_rebuilt_only(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return T.rebuilt_only(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 6 = 0"), ["o_custkey"])


@query("""WITH r AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents) SELECT doc_id, length(s) BETWEEN 300 AND 3000 AND NOT regexp_matches(s, '[^ABCDEFGHIKLMNOPRSTUVWYZ]') AS usable FROM r""")
def p08_usable_sequences(spark, sf):
    return read(spark, sf, "documents").select("doc_id", sequences.usable(_letters(), 300, 3000, "ABCDEFGHIKLMNOPRSTUVWYZ").alias("usable"))


@query(f"""WITH {HITS} SELECT query_accession, target_accession, target_accession = 'PF00003' OR starts_with(target_accession, 'PF00003.') AS pf3, starts_with(target_accession, 'PF00003.1.') OR target_accession = 'PF00003.1' AS pf31,
 regexp_replace(target_accession || ' (' || query_database || ')|x', '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM hits""")
def p03_same_or_versioned(spark, sf):
    t = F.col("target_accession")
    return hits(spark, sf).select("query_accession", "target_accession", accessions.same_or_versioned(t, "PF00003").alias("pf3"), accessions.same_or_versioned(t, "PF00003.1").alias("pf31"), accessions.safe_name(F.concat(t, F.lit(" ("), "query_database", F.lit(")|x"))).alias("safe"))


@query("""SELECT doc_id, split_part(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'Q', -1) AS tail, trim(regexp_replace('name ' || lang || ' [' || source || '] ', '\\s*\\[[^\\[\\]]*\\]\\s*$', '')) AS name, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id || '_with_leader_7_M|b' ELSE 'a' || doc_id || '_with_leader_7_M' END AS leader FROM documents""")
def g09_text_rules(spark, sf):
    k = F.col("doc_id")
    plain = F.concat(F.lit("a"), k, F.when(k % 2 == 0, "|b").otherwise(""))
    return read(spark, sf, "documents").select(
        k, sequences.after_last_stop(F.translate(_letters(), "Q", "*")).alias("tail"), sequences.strip_organism(F.concat(F.lit("name "), "lang", F.lit(" ["), "source", F.lit("] "))).alias("name"), accessions.leader_id(plain, F.lit("7")).alias("leader")
    )
