"""Boundary, tie and error rows of the operators, and brute force where SQL can't express them."""

import io
import itertools
import math
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import channels, rules, sinks, streaming
from quern.functions import accessions, intervals, logic, sequences
from quern.operators import genomics, hits, tables
from quern.operators.contigs import Contigs
from quern.sources import folds, text
from quern.sources import tables as source_tables
from quern.structure import classify, contacts, helices, kernels, overlap

VALUES = ("true", "yes", "too_far", "not_applicable", "false", "maybe", "error", "missing_a")


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def lines(spark, body, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(body.split("\n"))], "file string, ord int, line string")


def test_result_algebra_truth_tables(spark):
    def both(a, b):
        for v in ("false", "error", "maybe"):
            if v in (a, b):
                return v
        return "true" if {a, b} <= set(logic.PASSING) else "false"

    def either(a, b):
        if {a, b} & set(logic.PASSING):
            return "true"
        return next((v for v in ("maybe", "error") if v in (a, b)), "false")

    df = spark.createDataFrame(list(itertools.product(VALUES, VALUES)), "a string, b string")
    for r in df.select("*", logic.all_of(F.col("a"), F.col("b")).alias("both"), logic.any_of(F.col("a"), F.col("b")).alias("either"), logic.negated(F.col("a")).alias("no")).collect():
        assert (r.both, r.either) == (both(r.a, r.b), either(r.a, r.b))
        assert r.no == (r.a if r.a in ("maybe", "error") else "false" if r.a in logic.PASSING else "true")
    r = one(spark, a=logic.all_of(), b=logic.any_of())
    assert (r.a, r.b) == ("true", "false")


def test_signed_coordinates_have_no_zero(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 12)], "x int")
    got = [r[0] for r in df.select(intervals.relative(F.col("x"), F.lit(5))).collect()]
    assert got == [-4, -3, -2, -1, 1, 2, 3, 4, 5, 6, 7]
    back = [r[0] for r in df.select(intervals.absolute(intervals.relative(F.col("x"), F.lit(5)), F.lit(5))).collect()]
    assert back == list(range(1, 12))


def test_most_disjoint_equals_brute_force(spark):
    rng = random.Random(1)
    cases = [[(a := rng.randrange(1, 20), a + rng.randrange(0, 8)) for _ in range(rng.randrange(0, 8))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<struct<lo:int,hi:int>>")
    got = {r.i: r.n for r in df.select("i", intervals.most_disjoint(F.col("s")).alias("n")).collect()}
    for i, c in enumerate(cases):
        best = max(len(s) for k in range(len(c) + 1) for s in itertools.combinations(c, k) if all(x[1] < y[0] or y[1] < x[0] for x, y in itertools.combinations(s, 2)))
        assert got[i] == best


def test_region_accession_round_trip(spark):
    df = spark.createDataFrame([("P_1_PF00001.2_3_40",), ("a_b_3_2",), ("a_b_03_4",), ("q_PF1_1_9_domain_2",), ("x",)], "id string")
    got = [r.p for r in df.select(accessions.parse_region(F.col("id")).alias("p")).collect()]
    assert (got[0].protein, got[0].target, got[0].start, got[0].end, got[0].domain) == ("P_1", "PF00001.2", 3, 40, None)
    assert got[1] is None and got[2] is None and got[4] is None and (got[3].protein, got[3].domain) == ("q", 2)


def test_sequences(spark):
    r = one(spark, t=sequences.translate_codons(F.lit("ATGGCNTAAuuuGG")), rc=sequences.reverse_complement(F.lit("AACGTR")), gc=sequences.gc_percent(F.lit("GGCA")), none=sequences.gc_percent(F.lit("")), m=sequences.starts_with_met(F.lit("MAMMAAAAAMM"), F.lit(10)), o=sequences.strip_organism(F.lit("a [b] protein [Homo sapiens] ")))
    assert (r.t, r.rc, r.gc, r.none, r.m, r.o) == ("MX*F", "YACGTT", 75.0, None, [1, 3, 4, 10], "a [b] protein")
    cds = F.array(F.struct(F.lit(4).alias("s"), F.lit(9).alias("e")), F.struct(F.lit(16).alias("s"), F.lit(21).alias("e")))
    at = one(spark, a=sequences.codon_positions(F.lit(2), cds, F.lit(False)), b=sequences.codon_positions(F.lit(3), cds, F.lit(False)), c=sequences.codon_positions(F.lit(1), cds, F.lit(True)), d=sequences.codon_positions(F.lit(5), cds, F.lit(False)))
    assert (at.a, at.b, at.c, at.d) == ([7, 8, 9], [16, 17, 18], [21, 20, 19], [None, None, None])


HIT = "query_accession string, query_database string, query_type string, target_accession string, query_start int, query_end int, target_start int, evalue double, bitscore string, bitscore_threshold string"


def hit_rows(spark, rows):
    return spark.createDataFrame([(r[0], "d", "protein", *r[1:]) for r in rows], HIT)


def test_rank_is_among_eligible_hits_of_all_targets(spark):
    df = hit_rows(spark, [("p", "K1", 1, 9, 1, 1e-9, "10", "20"), ("p", "K2", 1, 9, 1, 1e-5, "10", None), ("p", "K1", 30, 20, 1, 1e-5, "30", "20"), ("p", "K1", 5, 6, 1, None, "x", "20"), ("q", "K1", 1, 2, 1, 2.0, "x", "n/a"), ("q", "K1", 1, 2, 1, 2.0, "x", "n/a")])
    got = sorted((r.query_accession, r.query_start, r.query_end) for r in hits.find_hits(df, ["K1"], rank=1).collect())
    assert got == [("p", 30, 20), ("q", 1, 2)]
    assert hits.find_hits(df, ["K1"], rank=1, end=10).count() == 1


def test_architectures(spark):
    rows = [("a", "PF1.1", 1, 5), ("a", "PF2", 8, 10), ("b", "PF1", 1, 5), ("b", "PF1", 20, 6), ("c", "PF9", 1, 2), ("d", "PF1", 1, 5), ("d", "PF2", 5, 9), ("e", "PF1", 1, 3), ("e", "PF2", 1, 3), ("b", "PF1", 6, 20)]
    df = hit_rows(spark, [(p, t, s, e, 1, 1.0, "1", None) for p, t, s, e in rows])
    found = lambda *w, **k: sorted(r.query_accession for r in hits.architectures(df, list(w), **k).collect())
    assert found("PF1", "PF2") == ["a"] and found("PF1", "PF2", overlaps=True) == ["a", "d", "e"]
    assert found("PF1+", "PF2?", ordered=True) == ["a", "b"] and found("PF2", "PF1", ordered=True) == []
    assert found("PF1", "PF2", ordered=True, overlaps=True) == ["a", "d"]  # e: two domains at one start
    assert found("PF1{2}") == ["b"] and found("PF1*", "PF2*") == ["a", "b", "c"] and found("PF1{0}", "PF2{0}") == ["c"]
    for bad in ("PF1{2,1}", "PF1{2,}", ""):
        with pytest.raises(ValueError):
            hits.Domain.parse(bad)


def test_merge_is_idempotent_and_refuses_conflicts(spark):
    old = spark.createDataFrame([("a", "s", ""), ("b", "t", "5"), (None, "n", "")], "k string, v string, u string")
    new = spark.createDataFrame([("a", "s", "3"), ("b", "t", "5"), ("c", "x", ""), (None, "n", "")], "k string, v string, u string")
    m = tables.merge(old, new, ["k"], ["v", "u"], ["u"])
    assert {r.k: (r.u, r.status) for r in m.collect()} == {"a": ("3", "upgraded"), "b": ("5", "same"), "c": ("", "added"), None: ("", "same")}
    again = tables.merge(m.drop("status"), new, ["k"], ["v", "u"], ["u"])
    assert {r.status for r in again.collect()} == {"same"} and tables.refuse_conflicts(again).count() == 4
    with pytest.raises(Exception, match="conflict"):
        tables.refuse_conflicts(tables.merge(old, new.withColumn("v", F.lit("zz")), ["k"], ["v", "u"])).collect()


def test_first_shortest_and_union_order(spark):
    df = spark.createDataFrame([("long", 0, "AA"), ("s", 1, "AA"), ("s", 2, "AA"), ("z", 3, "B")], "accession string, ord int, sequence string")
    assert sorted(r.ord for r in tables.shortest_wins(df).collect()) == [1, 2, 3]
    a, b = (spark.createDataFrame(x, "k string, ord int, v string") for x in ([("x", 0, "1"), ("y", 1, "2")], [("y", 0, "3"), ("w", 1, "4")]))
    got = sorted((r.part, r.ord, r.k, r.v) for r in tables.union_last_value_first_place(a, b, "k", "ord").collect())
    assert got == [(0, 0, "x", "1"), (0, 1, "y", "3"), (1, 1, "w", "4")]


def test_greedy_distinct_shares_at_most_a_tenth(spark):
    sets = [list(range(10)), list(range(9, 19)), list(range(8, 20)), [], list(range(30, 33))]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sets)], "g int, o int, m array<int>")
    assert [r.m for r in tables.greedy_distinct(df, ["g"], "m", ["o"]).orderBy("place").collect()] == [sets[0], sets[1], sets[4]]


def test_sweep_without_negatives_has_no_best(spark):
    df = spark.createDataFrame([(1.0, True), (0.0, True)], "score double, positive boolean")
    assert tables.best_threshold(tables.threshold_sweep(df)).count() == 0
    tied = spark.createDataFrame([(2.0, True), (1.0, False), (1.0, True), (0.0, False)], "score double, positive boolean")
    assert tables.best_threshold(tables.threshold_sweep(tied)).first().threshold == 2.0


def test_rules(spark):
    proteins = spark.createDataFrame([("p", "MAAKRLM", 1), ("q", "GG", None)], "protein string, sequence string, protein_start int")
    df = hit_rows(spark, [("p", "PF00001.3", 2, 4, 1, 1.0, "1", None), ("p", "PF00001.3", 3, 6, 1, 1.0, "1", None), ("q", "PF00002", 2, 2, None, 1.0, "1", None)])
    f = rules.facts(proteins, Pfam=df)

    def check(rule, p, q):
        got = {r.protein: r["pass all"] for r in rule.evaluate(f).collect()}
        assert (got["p"], got["q"]) == (p, q), rule.label

    P = rules.Pfam
    check(P.matches("PF00001"), "true", "false")
    check(P.matches("PF00001").times(1, overlapping=False), "true", "false")
    check(P.matches("PF00001").times(3, 2), "true", "false")
    check(P.matches("PF00001").between_aa(5, 1), "true", "false")
    check(P.matches("PF00001").between_aa(1, 5, every=True), "false", "false")
    check(P.matches("PF00001").spans_aa(5, 5), "true", "false")
    check(~P.matches("PF00001.3"), "true", "true")  # a version in the rule never matches a stripped accession
    check(P.matches_only("PF00002"), "false", "true")
    check(rules.Sequence.length_between(7, 3) & ~P.matches("PF00002"), "true", "false")
    check(rules.Sequence.matches_regex("^KR").between_aa(4, 99), "true", "false")
    check(rules.Sequence.matches_regex("^AK").relative_to("PF00001", 2, 3), "true", "false")
    check(rules.Sequence.matches_regex("G").relative_to("PF00002", 1, 1), "false", "error")
    rule = (P.matches("PF00001") | P.matches("PF00002")) & rules.Any((P.matches("PF00001"), rules.Custom("mine", F.lit("maybe"))))
    assert list(rule.atoms()) == ['Pfam.matches("PF00001")', 'Pfam.matches("PF00002")', "mine"] and rule.sources == {"Pfam"}
    check(rule, "true", "maybe")
    end = rules.EndBound("Pfam", "PF00001")
    assert rules.end_bound(end & ~rules.EndBound("Pfam", "PF2")) is end
    with pytest.raises(ValueError):
        rules.end_bound(end & rules.EndBound("Pfam", "PF2"))


def test_leader_calls_motifs_and_profiles(spark):
    call = lambda sp, m, no: one(spark, c=rules.targetp_call(F.struct(F.lit(sp).alias("p_SP"), F.lit(m).alias("p_mTP"), F.lit(no).alias("p_noTP")))).c
    assert [call(0.5, 0.5, 0.5), call(0.5, 0.5, 0.1), call(0.6, 0.2, 0.2), call(0.0, 0.0, 0.004)] == ["noTP", "mTP", "SP", ""]
    motif = "array<struct<motif:string,start:int,end:int,score:double>>"
    df = spark.createDataFrame([(0, [("M1.2", 2, 6, 1.0), ("M2", 9, 12, 1.0)], [(0, 20)]), (1, [("M1.2", 2, 6, 1.0)], [(4, 20)]), (2, None, [(0, 9)]), (3, [], None), (4, [], [])], f"i int, motifs {motif}, scopes array<struct<s:int,e:int>>")
    run = lambda rule: [r.x for r in df.select("i", rule.column().alias("x")).orderBy("i").collect()]
    assert run(rules.Motifs("M1")) == ["yes", "missing_M1", "error", "not_applicable", "false"]
    assert run(rules.Motifs("M1", "M2", 3))[:2] == ["yes", "missing_M1_and_M2"] and run(rules.Motifs("M1", "M2", 2))[0] == "too_far"
    sto = lines(spark, "# STOCKHOLM 1.0\np  AC-dE\n#=GC RF xx.xx\n//")
    m = text.alignment_map(sto).withColumnRenamed("hmm", "x").withColumn("hmm", F.create_map(F.lit("h"), F.col("x")))
    hmm = rules.HMM("h")
    want = {hmm.is_at("AC", 1): "true", hmm.is_at("D", 3): "false", hmm.covers(1, 4): "true", hmm.covers(1, 5): "false", hmm.spans(2, 4): "true", hmm.covers(1, 2).between(1, 2): "true", hmm.covers(1, 3).between(1, 2): "false", hmm.matches_regex("Cd", 2): "true", hmm.matches_regex("d", 9): "false"}
    for rule, v in want.items():
        assert m.select(rule.column().alias("v")).first().v == v, rule.label


def test_candidates(spark):
    p = spark.createDataFrame([("a|x", "AMAM"), ("b", "AAA")], "protein string, sequence string")
    got = sorted((r.accession, r.start, r.sequence) for r in genomics.leader_candidates(p).collect())
    assert got == [("a_with_leader_2_M|x", 2, "MAM"), ("a_with_leader_4_M|x", 4, "M"), ("a|x", 1, "AMAM"), ("b", 1, "AAA")]
    c = spark.createDataFrame([("p", "AAMK", "CM"), ("q", "AA", "")], "protein string, sequence string, tail string")
    got = sorted((r.accession, r.start, r.sequence) for r in genomics.curated_candidates(c).collect())
    assert got == [("p_with_leader_3_M", 3, "MK"), ("p_with_leader_u1_M", 0, "MAAMK"), ("q", 1, "AA")]
    tail = one(spark, a=genomics.upstream_tail(F.lit("CTAAATGGCCATGAAA"), F.lit(11), F.lit(False)), b=genomics.upstream_tail(F.lit("TTTCATGGCCATTTAG"), F.lit(6), F.lit(True)))
    assert tail.a == "MA" and tail.b == "MA"
    bound = rules.bound_candidates(spark.createDataFrame([("p", "p|d", 1, "ABCDE"), ("p", "u", -2, "xyABCDE"), ("p", "late", 5, "E"), ("z", "z", 1, "Q")], "protein string, accession string, start int, sequence string"), hit_rows(spark, [("p", "K1", 4, 2, 1, 1.0, "1", None)]), "K1", "KO")
    assert sorted((r.accession, r.sequence) for r in bound.collect()) == [("p_to_KO_end|d", "ABCD"), ("u_to_KO_end", "xyABCD"), ("z", "Q")]


def test_loci_and_exons(spark):
    body = "c\ts\tmRNA\t1\t40\t.\t-\t.\tID=t1\nc\ts\tCDS\t4\t9\t.\t-\t0\tParent=t1;protein_id=p\nc\ts\tCDS\t16\t22\t.\t-\t0\tParent=t1;protein_id=p\n#x\nc\ts\tCDS\t3\t5\t.\t+\t0\tprotein_id \"q\""
    places = genomics.loci(text.gff(lines(spark, body)))
    got = {r.protein: (r.start, r.end, [tuple(c) for c in r.cds]) for r in places.collect()}
    assert got == {"p": (40, 1, [(4, 9), (16, 22)]), "q": (3, 5, [(3, 5)])}
    assert sorted((r.protein, r.feature, r.position) for r in genomics.locus_features(places).collect()) == [("p", "ass", 9), ("p", "dss", 16), ("p", "start", 22), ("p", "stop", 4), ("q", "start", 3), ("q", "stop", 5)]
    ex = sorted((r.exon, r.first_aa, r.last_aa, r.head_bases, r.tail_bases) for r in genomics.exon_residues(places).where("protein = 'p'").collect())
    assert ex == [(1, 1, 3, 0, 1), (2, 3, 5, 2, 1)]
    contigs = spark.createDataFrame([("c", "ACGTNNACGTACGTACGTAACCGGTTAACCGGTTACGTACGTAC")], "id string, sequence string")
    w = {r.protein: r for r in genomics.locus_window(places, contigs, 5, 2).collect()}
    assert (w["q"].window_0b, w["q"].window_0b_excl, w["q"].sequence) == (0, 7, "ACGTNNA") and (w["p"].window_0b, w["p"].window_0b_excl) == (0, 44)
    s = contigs.first().sequence
    runs = {(r.first, r.last) for r in genomics.open_starts(contigs, 10).collect()}
    ok = [i for i in range(len(s) - 9) if s[i : i + 10].count("N") <= 1]
    assert {x for a, b in runs for x in range(a, b + 1)} == set(ok)
    spans = spark.createDataFrame([("d", 5, 5), ("c", 0, 3), ("e", 9, 8), ("d", 7, 900)], "id string, first int, last int")
    every = [("c", i) for i in range(4)] + [("d", 5)] + [("d", i) for i in range(7, 901)]
    rng = random.Random(0)
    assert [(r.id, r.start) for r in genomics.sample_starts(spans, 300).orderBy("nth").collect()] == [every[rng.randrange(len(every))] for _ in range(300)]
    with pytest.raises(ValueError):
        genomics.sample_starts(spans.where("id = 'e'"))
    assert genomics.collate_fragments(spark.createDataFrame([("p", 1, 2, "AB"), ("p", 5, 6, "CD")], "protein string, first int, last int, sequence string")).first().sequence == "ABXXCD"


def test_text_sources(spark):
    r = text.fasta(lines(spark, "junk\n>a one two\nAC\nDE\n\n>b\n>a\nXX\n>c\nab"))
    assert [(x.ord, x.id, x.description, x.sequence) for x in r.orderBy("ord").collect()] == [(0, "a", "one two", "ACDE"), (1, "b", "", ""), (2, "a", "", "XX"), (3, "c", "", "ab")]
    assert [x.problem for x in text.strict_proteins(r).orderBy("ord").collect()] == [None, "empty", "duplicate", "letters"]
    assert [x.sequence for x in text.first_of_each_id(r).orderBy("ord").collect()] == ["ACDE", "", "ab"]
    cl = text.clusters(text.fasta(lines(spark, ">r\n>r\nAA\n>m\nAB\n>s\n>t\nC")))
    assert [(x.cluster, x.member, x.is_member) for x in cl.orderBy("ord").collect()] == [("r", "r", True), ("r", "m", True), ("s", "t", False)]
    dom = "#c\ns1 - 100 m1 - 50 1e-5 30.5 0 1 1 1e-4 1e-3 20.5 0 3 40 5 42 4 43 0.9 text here\nshort line"
    d = text.domtblout(lines(spark, dom)).first()
    assert (d.sequence, d.model, d.accession, d.full_score, d.hmm_from, d.seq_to) == ("s1", "m1", "m1", 30.5, 3, 42)
    th = text.score_thresholds(lines(spark, "model threshold score_type\nm1 10 full\nm1 25 domain"))
    assert text.above_threshold(text.domtblout(lines(spark, dom)), th).count() == 0
    assert text.targetp(lines(spark, "# x\np noTP 0.9 0.05 0.05")).first().p_noTP == 0.9
    t = text.topology(lines(spark, ">p | TM\nACD\nIIM\n\n>q\nAC\nI")).orderBy("ord").collect()
    assert [(x.id, x.problem) for x in t] == [("p", None), ("q", "length")]
    s = {x.name: (x.value, x.problem) for x in text.scorefile(lines(spark, "SCORE: dG sasa name\nSCORE: -3.5 100 x")).collect()}
    assert s == {"dG": (-3.5, None), "sasa": (100.0, None), "name": (None, "value")}
    assert text.as_tsv(lines(spark, "a  b c\n# Program: x\nz")).first().line == "a\tb\tc"
    c = source_tables.confidence(spark.createDataFrame([(0, '{"iptm": 0.5, "ptm": null}'), (1, '{"iptm": 2}'), (2, "{")], "model int, json string")).orderBy("model").collect()
    assert [x.problem for x in c] == [None, "range", "json"]
    k = source_tables.records(lines(spark, "a.zip!/f\nl\tid\tm\t0.5\tNA\nl\tid\nl\ti\tm\tx\t1")).orderBy("ord").collect()
    assert [x.problem for x in k] == [None, None, "columns", "ipTM"] and k[1].ptm is None
    old = spark.createDataFrame([("p", "g", "s", "1", "1")], source_tables.ARTIFACT_COLUMNS[:5])
    assert source_tables.artifacts(old).first()[5:] == ("", "")


def test_folds_in_nested_archives(spark, tmp_path):
    cif = "data_x\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in ("label_asym_id", "label_seq_id", "label_comp_id", "label_atom_id", "type_symbol", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv")) + "A 1 ALA CA C 1 2 3 90\nB 1 GLY CA C 1 2 9 50\n#\n"
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("f/fold_model_0.cif", cif)
        z.writestr("f/fold_full_data_0.json", '{"token_chain_ids": ["B", "A"], "token_res_ids": [1, 1], "pae": [[1, 2], [3, 4]]}')
        z.writestr("__MACOSX/x", "")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    found = folds.files(spark, str(tmp_path)).cache()
    assert found.where("problem IS NOT NULL").count() == 1
    f = folds.folds(found.where("problem IS NULL")).first()
    assert f.fold.endswith("outer.zip!/in.zip!/f") and f.models == [0]
    res = folds.residues(folds.atoms(found), folds.tokens(found))
    assert [(r.chain, r.token_index, r.z, r.problem) for r in res.orderBy("chain").collect()] == [("A", 1, 3.0, None), ("B", 0, 9.0, None)]  # by the file's tokens, not by chain name
    assert {(r.i, r.j, r.value) for r in folds.pae(found).collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)}
    pairs = contacts.contacts(res, 6.0)
    assert folds.pae(found).select("model").distinct().first().model == pairs.first().model
    score = contacts.interface_scores(pairs, folds.pae(found)).first()
    x = (1 / (1 + 0.3**2)) * 70  # a is token 1, b token 0: the matrix says 3
    assert score.score_ab == pytest.approx(1.31034849 / (1 + math.exp(-0.0747157696 * (x - 84.7326239))) + 0.00501886443)
    assert contacts.contacts(res, 6.0).count() == 1 and contacts.contacts(res, 5.99).count() == 0


def test_residues_meet_their_tokens(spark):
    atoms = [("m", c, n, r, a, e, 0.0, 0.0, 0.0, 50.0, None) for c, n, r in (("A", 1, "ALA"), ("A", 2, "SEP"), ("A", 3, "GLY"), ("B", 1, "SEP"), ("B", 2, "VAL")) for a, e in (("N", "N"), ("CA", "C"), ("HA", "H"))]
    given = [("A", 1), ("A", 2), ("A", 2), ("A", 3), ("A", 3), ("B", 1), ("B", 1), ("B", 1), ("C", 9)]
    t = spark.createDataFrame([("m", i, c, n, None) for i, (c, n) in enumerate(given)] + [("broken", None, None, None, "matrix")], folds.TOKENS)
    got = {(r.chain, r.number): (r.tokens, r.problem) for r in folds.residues(spark.createDataFrame(atoms, folds.ATOMS), t).collect()}
    assert got == {("A", 1): ([0], None), ("A", 2): ([1, 2], None), ("A", 3): ([3, 4], "tokens"), ("B", 1): ([5, 6, 7], "modified residue"), ("B", 2): (None, "no token"), ("C", 9): ([8], "no atom"), (None, None): (None, "matrix")}


def test_feasibility_of_known_rows(spark):
    nan = float("nan")
    rows = [  # area, contacts, nonpolar, overlaps, nearest, salts, salt distance, charge -> answer
        ((600.0, 2.0, 50.0, 0.0, 4.0, 0.0, 3.0, 0.0), False), ((600.0, 2.0, 50.0, 0.0, 4.0, 1.0, 3.0, 0.0), True), ((0.0, 2.0, 50.0, 0.0, 4.0, 1.0, 3.0, 0.0), None), ((-5.0, 2.0, 50.0, 0.0, 4.0, 1.0, 3.0, 0.0), None),
        ((600.0, 2.0, nan, 0.0, 4.0, 1.0, 3.0, 0.0), None), ((600.0, 2.0, 50.0, None, 4.0, 1.0, 3.0, 0.0), None), ((600.0, 5.0, 50.0, 0.0, 4.0, 0.0, None, 0.0), True), ((600.0, 5.0, 50.0, 2.0, 4.0, 0.0, None, 0.0), False),
        ((1000.0, 3.0, 30.0, 1.0, 4.0, 2.0, 3.0, -3.0), True), ((1000.0, 3.0, 30.0, 1.0, 4.0, 2.0, 3.0, 2.0), False), ((1000.0, 3.0, 40.0, 2.0, 5.0, 0.0, 4.5, 0.0), False), ((1000.0, 3.0, 40.0, 2.0, 4.5, 0.0, 4.5, 0.0), True),
        ((1900.0, 10.0, 45.0, 2.0, 4.0, 1.0, 3.5, 0.0), True), ((1900.0, 10.0, 45.0, 2.0, 4.0, 1.0, 3.6, 0.0), False), ((1900.0, 12.0, 45.0, 2.0, 4.0, 0.0, None, 0.0), True), ((1900.0, 12.0, 45.0, 3.0, 4.0, 0.0, None, 0.0), False), ((1799.0, 1.0, 40.0, 0.0, 4.0, 0.0, None, 0.0), True), ((1000.0, 3.0, 40.0, 0.0, 4.0, 0.0, nan, 0.0), None),
    ]
    names = "area contacts nonpolar overlaps d_min salts salt_distance charge".split()
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = df.select("i", classify.feasible(*map(F.col, names)).alias("f"), classify.confidence_tier(F.lit(nan), F.lit(1.0)).alias("t")).orderBy("i").collect()
    assert [r.f for r in got] == [want for _, want in rows] and {r.t for r in got} == {None}


def test_sinks_and_streaming(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, True), ("b", None, None)], "k string, x double, y boolean")
    sinks.write_tsv(df.select("k", sinks.printed(F.col("x"), "double").alias("x"), sinks.printed(F.col("y"), "boolean").alias("y")), f"{tmp_path}/t.tsv")
    assert sorted((tmp_path / "t.tsv").read_text().split("\n")) == ["", "a\t1.500000\ttrue", "b\tNA\tNA", "k\tx\ty"]
    sinks.append(df, f"{tmp_path}/p")
    sinks.append(df, f"{tmp_path}/p")
    with pytest.raises(ValueError):
        sinks.append(df.drop("x"), f"{tmp_path}/p")
    m = spark.createDataFrame([("p", 6, 3)], "query_accession string, query_start int, query_end int")
    s = spark.createDataFrame([("p", "ABCDEFGH")], "id string, sequence string")
    assert sinks.match_fasta(m, s, "K1", match_only=True).first().value == ">p_K1_6_3\nCDEF"
    schema = "k string, v string"
    for rows in ([("a", "1")], [("a", "1"), ("b", "2")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.incremental_merge(spark, f"{tmp_path}/in", schema, lambda d: d, f"{tmp_path}/out", ["k"], ["v"], f"{tmp_path}/cp").awaitTermination()
    assert sorted(tuple(r) for r in streaming.latest(spark, f"{tmp_path}/out").collect()) == [("a", "1"), ("b", "2")]


def test_channels(spark):
    seq = spark.createDataFrame([("f", "s", "KDSTGGA"), ("f", "t", "G")], "filename string, sequence_id string, sequence string")
    cs = channels.ChannelSet(channels.net_charge("q", 1), channels.Entropy("h", 1), channels.Moment("m", 2), channels.Dipeptide("gg", 1, "GG"), channels.Motif("mo", 0, "G(?=G)|GA"), channels.Scale("kd", 0))
    t = {(r.sequence_id, r.position): r for r in cs.table(seq).collect()}
    assert len(t) == 8 and [t["s", i].q for i in (1, 2, 3)] == [0.0, 0.0, pytest.approx(-1 / 3)]
    assert t["s", 6].h == pytest.approx(-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))) and t["t", 1].h == 0
    assert [t["s", i].mo for i in range(1, 8)] == [0, 0, 0, 0, 1, 1, 1] and t["s", 6].gg == 0.5 and t["t", 1].gg is None
    a = math.radians(100)
    for at, w in ((1, (-1.10, -0.72, -0.26)), (4, (-0.72, -0.26, -0.18, 0.16, 0.16)), (7, (0.16, 0.16, 0.25))):  # K D S T G G A on the normalized consensus scale
        assert t["s", at].m == pytest.approx(math.hypot(sum(h * math.cos(k * a) for k, h in enumerate(w)), sum(h * math.sin(k * a) for k, h in enumerate(w))) / len(w))
    assert t["t", 1].m == pytest.approx(0.16)
    bg = channels.ChannelSet(channels.Scale("kd", 0))
    back = bg.backgrounds(seq)
    v = [channels.HYDROPATHY[c] for c in "KDSTGGAG"]
    assert back["kd"] == (pytest.approx(np.mean(v)), pytest.approx(np.std(v))) and bg.from_json(bg.to_json(back)) == back
    with pytest.raises(ValueError):
        channels.ChannelSet(channels.Scale("kd", 0)).backgrounds(seq.where("sequence = 'G'"))
    with pytest.raises(ValueError):
        channels.ChannelSet(channels.Scale("position"))


def test_distance_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    pts = [("m", "AB"[i % 2], i, i, 50.0, *map(float, rng.uniform(-12, 12, 3))) for i in range(150)]
    df = spark.createDataFrame(pts, "model string, chain string, number int, token_index int, plddt double, x double, y double, z double")
    got = {(r.number_a, r.number_b) for r in contacts.contacts(df, 4.0).collect()}
    want = {(a[2], b[2]) for a in pts for b in pts if a[1] < b[1] and math.dist(a[5:], b[5:]) <= 4.0}
    assert got == want and want


def test_patches_split_at_the_smallest_bridge():
    left = [(("A", i), (i * 3.0, 0, 0)) for i in range(4)] + [(("B", i), (i * 3.0, 4.0, 0)) for i in range(4)]
    right = [(("A", 20 + i), (30 + i * 3.0, 0, 0)) for i in range(4)] + [(("B", 20 + i), (30 + i * 3.0, 4.0, 0)) for i in range(4)]
    bridge = [(("A", 10), (16.0, 2.0, 0)), (("B", 10), (23.0, 2.0, 0))]
    every = left + right + bridge
    got = kernels.split_patches(np.array([x for _, x in every]), [k for k, _ in every], cutoff=8.0, max_bridge=2)
    assert got[0]["status"] == "split" and len(got[0]["bridge"]) == 1 and [p["parent"] for p in got[1:3]] == ["p1", "p1"]
    random.Random(4).shuffle(every)
    again = kernels.split_patches(np.array([x for _, x in every]), [k for k, _ in every], cutoff=8.0, max_bridge=2)
    assert [(p["id"], p["members"], p["bridge"]) for p in again] == [(p["id"], p["members"], p["bridge"]) for p in got]


def test_patches_raise_when_the_separator_budget_runs_out():
    line = [(("A", i), (i * 3.0, 0, 0)) for i in range(6)] + [(("B", i), (i * 3.0, 4.0, 0)) for i in range(6)]
    xyz, labels = np.array([x for _, x in line]), [k for k, _ in line]
    assert [p["status"] for p in kernels.split_patches(xyz, labels, budget=12)] == ["leaf"]  # by default one residue is tried at a time
    with pytest.raises(ValueError, match="separator search limit exceeded"):
        kernels.split_patches(xyz, labels, budget=11)


def test_superposition_recovers_a_rotation():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(12, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    r, t, rmsd = kernels.superposition(p, p @ q.T + [1, 2, 3])
    assert np.allclose(r, q) and np.allclose(t, [1, 2, 3]) and rmsd < 1e-9
    with pytest.raises(ValueError):
        kernels.superposition(np.outer(np.arange(4.0), [1, 1, 1]), np.outer(np.arange(4.0), [1, 1, 1]))


def test_surface_and_helices():
    assert kernels.accessible_area(np.zeros((1, 3)), np.array([1.7]))[0] == pytest.approx(4 * math.pi * 3.1**2)


def helix_rows(bend=0.0, codes=None, missing=(), n=24):
    """Cα atoms of an ideal helix along z whose second half, from residue 13 on, is turned by bend degrees about x."""
    rows = []
    for i in range(1, n + 1):
        x, y, z = 2.3 * math.cos(math.radians(100 * i)), 2.3 * math.sin(math.radians(100 * i)), 1.5 * i
        if i >= 13:
            c, s = math.cos(math.radians(bend)), math.sin(math.radians(bend))
            y, z = y * c - z * s, y * s + z * c
        code = (codes or {}).get(i, "H")
        rows.append(("m", "A", i, code, *((None,) * 3 if i in missing else (x, y, z))))
    return rows


@pytest.mark.parametrize(
    ("rows", "connector", "want"),
    [
        (helix_rows(0, {12: "T"}), 1, [("alpha1", 1, 24)]),
        (helix_rows(60, {12: "-"}), 1, [("alpha1", 1, 24)]),
        (helix_rows(80, {12: "T"}), 1, [("alpha1", 1, 11), ("loop1", 12, 12), ("alpha2", 13, 24)]),
        (helix_rows(0, {12: "G"}), 1, [("alpha1", 1, 11), (None, 12, 12), ("alpha2", 13, 24)]),
        (helix_rows(0, {11: "T", 12: "S"}), 1, [("alpha1", 1, 10), ("loop1", 11, 11), ("loop2", 12, 12), ("alpha2", 13, 24)]),
        (helix_rows(0, {11: "T", 12: "S"}), 2, [("alpha1", 1, 24)]),
        (helix_rows(0, {12: "T"}, missing=(10,)), 1, [("alpha1", 1, 11), ("loop1", 12, 12), ("alpha2", 13, 24)]),
        (helix_rows(0, {4: "T"}), 1, [("alpha1", 1, 3), ("loop1", 4, 4), ("alpha2", 5, 24)]),
        (helix_rows(0, {6: "T", 12: "T"}), 1, [("alpha1", 1, 24)]),
    ],
)
def test_helices_merge_over_short_kinks(spark, rows, connector, want):
    df = spark.createDataFrame(rows, "model string, chain string, number int, code string, x double, y double, z double")
    got = sorted((r.start, r.label, r.end) for r in helices.normalized(df, connector).collect())
    assert [(label, start, end) for start, label, end in got] == want


def test_kink_reports_and_bad_settings(spark):
    schema = "model string, chain string, number int, code string, x double, y double, z double"
    r = helices.judged_kinks(spark.createDataFrame(helix_rows(80, {12: "T"}), schema)).collect()
    assert [(x.left_end, x.right_start, x.merged, x.problem) for x in r] == [(11, 13, False, None)] and r[0].degrees == pytest.approx(80, abs=1e-6)
    line = [("m", "A", i, "T" if i == 5 else "H", 0.0, 0.0, float(i)) for i in range(1, 10)]
    assert [(x.merged, x.problem) for x in helices.judged_kinks(spark.createDataFrame(line, schema)).collect()] == [(False, "degenerate")]
    for bad in ((0, 70), (1, 0), (1, 181)):
        with pytest.raises(ValueError):
            helices.judged_kinks(spark.createDataFrame(line, schema), *bad)


def brute_alignment(a, b):
    best = 0
    n, m = len(a), len(b)
    H = [[0.0] * (m + 1) for _ in range(n + 1)]
    E = [[-1e9] * (m + 1) for _ in range(n + 1)]
    G = [[-1e9] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            E[i][j] = max(H[i - 1][j] - 5, E[i - 1][j] - 1)
            G[i][j] = max(H[i][j - 1] - 5, G[i][j - 1] - 1)
            s = 2 if a[i - 1] == b[j - 1] and a[i - 1] in "ACGT" else -3
            H[i][j] = max(0, H[i - 1][j - 1] + s, E[i][j], G[i][j])
            best = max(best, H[i][j])
    return best


def test_local_alignment_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 25)))
        b = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 30))) + a[3:12] + "GG" + a[12:]
        s, a0, a1, b0, b1 = kernels.local_alignment(a, b)
        assert s == brute_alignment(a, b)
        assert s == 0 or brute_alignment(a[a0:a1], b[b0:b1]) == s


def test_faces_and_classes(spark):
    r = spark.createDataFrame([("DD", "Ia", "alpha1", 2, "mandatory"), ("DD", "Ia", "alpha4", 1, "alternative_or"), ("DD", "Ia", "loop1-2", 1, "alternative_or"), ("DD", "Ib", "alpha2", 4, "mandatory"), ("DD", "IIa", "alpha6", 1, "optional")], "domain string, face string, element string, min_residues int, requirement_type string")
    c = spark.createDataFrame([("A", "DD", "alpha1", 2, 10), ("A", "DD", "loop1-2", 3, 3), ("A", "DD", "alpha2", 1, 8), ("B", "DD", "alpha2", 5, 8), ("B", "DD", "alpha6", 9, 9), ("C", "DD", "alpha6", 1, 9)], "chain string, domain string, element string, n int, size int")
    got = {x.chain: x.faces for x in classify.faces(r, c).collect()}
    assert got == {"A": ["Ia", "Ib (partial)"], "B": ["Ib"], "C": []}
    # The share of an element that is touched decides, not its minimum; equal shares follow the order of faces.
    r = spark.createDataFrame([("DD", f, f"alpha{i}", 1, "mandatory") for i, f in enumerate(("IIIa", "IIa", "Ia", "Ib"), 1)], "domain string, face string, element string, min_residues int, requirement_type string")
    c = spark.createDataFrame([("A", "DD", f"alpha{i}", n, size) for i, (n, size) in enumerate(((3, 6), (2, 4), (4, 8), (3, 4)), 1)], "chain string, domain string, element string, n int, size int")
    assert classify.faces(r, c).first().faces == ["Ib", "Ia", "IIa", "IIIa"]
    cls = lambda a, b: one(spark, c=classify.face_class(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).c
    assert [cls(["Ia"], ["Ib"]), cls(["Ia (partial)"], ["Ib"]), cls(["Ia"], ["Ia"]), cls([], ["Ib"])] == ["Canonical", "Variant", "Atypical", "None"]
    tier = [one(spark, t=classify.confidence_tier(F.lit(s).cast("double"), F.lit(a).cast("double"))).t for s, a in ((0.22, 1), (0.23, 1), (0.4, 999), (0.4, 1000), (0.5, 2000), (0.7, 1), (None, 1))]
    assert tier == ["Reject", "Low", "Medium", "Low", "Medium", "High", None]


def test_interactions(spark):
    rows = [("m", "A", 1, "LYS", "NZ", "N", 0.0, 0.0, 0.0), ("m", "B", 2, "ASP", "OD1", "O", 3.0, 0.0, 0.0), ("m", "A", 3, "CYS", "SG", "S", 20.0, 0.0, 0.0), ("m", "B", 4, "CYS", "SG", "S", 22.0, 0.0, 0.0), ("m", "A", 5, "LEU", "CD1", "C", 40.0, 0.0, 0.0), ("m", "B", 6, "VAL", "CG1", "C", 42.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, chain string, number int, resname string, name string, element string, x double, y double, z double")
    got = sorted((r.number_a, r.kind) for r in contacts.interactions(df).collect())
    assert got == [(1, "hydrogen_bond"), (1, "salt_bridge"), (3, "nonpolar"), (5, "nonpolar"), (5, "steric")]  # two thiols: no bond by hydrogen, no clash at this distance
    rows = [("m", "A", 1, "CYS", "CB", "C", 0.0, 0.0, 0.0), ("m", "B", 2, "LEU", "CB", "C", 4.0, 0.0, 0.0), ("m", "A", 3, "SEP", "O1P", "O", 20.0, 0.0, 0.0), ("m", "B", 4, "SER", "OG", "O", 23.0, 0.0, 0.0), ("m", "A", 5, "CYS", "SG", "S", 40.0, 0.0, 0.0), ("m", "B", 6, "GLY", "O", "O", 43.4, 0.0, 0.0)]
    assert sorted((r.number_a, r.kind) for r in contacts.interactions(spark.createDataFrame(rows, df.schema)).collect()) == [(1, "nonpolar")]
    with pytest.raises(Exception, match="van der Waals"):
        contacts.interactions(spark.createDataFrame([("m", "A", 1, "ALA", "X", "ZN", 0.0, 0.0, 0.0)], df.schema)).collect()


def test_detected_loci(spark):
    # plus strand: TAA ATG GCC | AAA GGG CCC ...: M A come before the first fragment
    plus = "CTAAATGGCCAAAGGGCCCTTTGGG"
    minus = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(plus))
    contigs = spark.createDataFrame([("c", plus), ("r", minus), ("d", "AAAGGG")], "id string, sequence string")
    n = len(plus)
    rows = [("p", "c", 17, 22, 3, 4, 0), ("p", "c", 11, 16, 1, 2, 1), ("q", "r", n + 1 - 11, n + 1 - 16, None, None, 0), ("t", "c", 2, 10, 1, 3, 0), ("x", "c", 1, 3, 1, 1, 0), ("x", "r", 1, 3, 2, 2, 1), ("y", "gone", 1, 3, 1, 1, 0)]
    fragments = spark.createDataFrame(rows, "protein string, contig string, start int, end int, target_start int, target_end int, ord int")
    proteins = spark.createDataFrame([("p", "KGPF"), ("q", "KG"), ("t", "KMA"), ("x", "MA"), ("y", "MA"), ("z", "MA")], "protein string, sequence string")
    got = {r.protein: r for r in genomics.detected_loci(fragments, proteins, contigs).collect()}
    p, q, t = got["p"], got["q"], got["t"]
    assert (p.start, p.end, p.strand, p.prefix, p.sequence, p.dna, p.start_codon) == (5, 22, "+", "MA", "MAKGPF", plus[4:22], True)
    assert [tuple(c) for c in p.cds] == [(7, 12), (13, 18)]
    assert (q.start, q.end, q.strand, q.sequence, q.dna) == (n + 1 - 5, n + 1 - 16, "-", "MAKG", plus[4:16]) and [tuple(c) for c in q.cds] == [(7, 12)]
    assert (t.start, t.trim, t.prefix, t.sequence, t.dna) == (5, 1, "", "MA", "ATGGCC") and [tuple(c) for c in t.cds] == [(1, 6)]
    assert [got[k].problem for k in "pxyz"] == [None, "contigs", "contig missing", "fragments"]
    bare = {r.protein: r for r in genomics.detected_loci(fragments, proteins, contigs, leader=False).collect()}["p"]
    assert (bare.start, bare.sequence, bare.start_codon) == (11, "KGPF", False)


def test_salt_patch_and_shared_chains(spark):
    schema = "model string, chain string, number int, element string, x double, y double, z double"
    atoms = spark.createDataFrame([("m", "A", 1, "C", 0.0, 0.0, 0.0), ("m", "A", 2, "N", 4.0, 0.0, 0.0), ("m", "A", 3, "H", 1.0, 0.0, 0.0), ("m", "B", 4, "C", 1.0, 0.0, 0.0), ("m", "A", 5, "C", 8.0, 0.0, 0.0)], schema)
    chosen = spark.createDataFrame([("m", "A", 1), ("m", "A", 9)], "model string, chain string, number int")
    got = lambda r: sorted(x.number for x in contacts.salt_patch(chosen, atoms, r).collect())
    assert got(4.0) == [1, 2, 9] and got(3.9) == [1, 9]
    side = "pair int, chain string, ord int, sequence string"
    a = spark.createDataFrame([(1, "A", 0, "MK"), (1, "B", 1, "AA"), (2, "A", 0, "MK"), (2, "B", 1, "MK"), (3, "A", 0, "C")], side)
    b = spark.createDataFrame([(1, "X", 0, "GG"), (1, "Y", 1, "MK"), (2, "X", 0, "MK"), (3, "X", 0, "GMK")], side)
    assert sorted(tuple(r) for r in contacts.shared_chains(a, b).collect()) == [(1, "A", "Y", None), (2, None, None, "copies"), (3, None, None, "shared sequences")]
    assert sorted(tuple(r) for r in contacts.shared_chains(a, b, "MK").collect()) == [(1, "A", "Y", None), (2, "A", "X", None), (3, None, "X", "not in a")]
    with pytest.raises(ValueError):
        contacts.shared_chains(a, b, "mk")


def test_threshold_report_and_profiles(spark, tmp_path):
    v = [0.0, 12.0, 100.0, 0.5, 1 / 3, 1234567.0, 999999.5, 0.0001, 0.00001234, -2.5, float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double")
    assert [r.t for r in df.orderBy("i").select(sinks.six_digits(F.col("x")).alias("t")).collect()] == [f"{x:.6g}" if x == x else "" for x in v]
    entries = spark.createDataFrame([("a", True, 30.0, 0), ("b", False, 40.0, 1), ("c", True, 5.5, 2), ("d", False, 0.0, 3)], "id string, positive boolean, score double, ord int")
    sweep = tables.threshold_sweep(entries)
    out = sinks.threshold_report(sweep, tables.best_threshold(sweep), entries, lines(spark, "x y\nz"))
    sinks.write_lines(out, f"{tmp_path}/r.tsv")
    text_ = (tmp_path / "r.tsv").read_text().split("\n")
    assert text_[0].split("\t")[0] == "threshold bitscore" and [x.split("\t")[0] for x in text_[1:5]] == ["40", "30", "5.5", "0"]
    assert text_[3] == "5.5\t2\t1\t1\t0\t1\t0.5\t0.75\ttrue"
    assert text_[5:] == ["# selected threshold bitscore 5.5", "# false positives", "# b 40", "# false negatives", "# hmmsearch domtblout", "# x y", "# z", ""]
    for name in ("b.hmm", "a.hmm", "n.txt"):
        (tmp_path / name).write_text("")
    (tmp_path / "d.hmm").mkdir()
    found = source_tables.profiles(spark, [str(tmp_path)])
    assert found == [f"{tmp_path}/a.hmm", f"{tmp_path}/b.hmm"] and source_tables.profiles_by_name(found + found)["a.hmm"] == found[0]
    with pytest.raises(ValueError):
        source_tables.profiles(spark, [f"{tmp_path}/none"])
    with pytest.raises(ValueError):
        source_tables.profiles_by_name(["/x/a.hmm", "/y/a.hmm"])


def test_library_imports_without_the_training_data_part():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quern"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_open_starts_over_chunk_borders(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("ACGTN" if rng.random() < 0.3 else "ACGT") for _ in range(n))) for i, n in enumerate((0, 5, 9, 10, 37, 200))]
    df = spark.createDataFrame(rows, "id long, sequence string")
    want = set()
    for i, s in rows:
        good = [k for k in range(len(s) - 9) if s[k : k + 10].count("N") <= 1]
        for k in good:
            if k - 1 not in good:
                end = k
                while end + 1 in good:
                    end += 1
                want.add((i, k, end))
    for chunk in (7, 16, 1 << 16):
        assert {tuple(r) for r in genomics.open_starts(df, 10, 0.1, chunk).collect()} == want


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">p{i} x\n{'ACDE' * 10}\n{'K' * (i % 7)}\n" for i in range(400)))
    (tmp_path / "b.fa").write_text(">q\r\nAC\r\nDE")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "7k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.id: r.sequence for r in text.fasta(text.lines(spark, str(tmp_path))).collect()}
            assert got == {f"p{i}": "ACDE" * 10 + "K" * (i % 7) for i in range(400)} | {"q": "ACDE"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_batches_with_conflicting_rows_fail(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string, u string")
    same = streaming.one_per_key(rows(("a", "1", ""), ("a", "1", "x"), ("a", "1", "x"), ("b", None, None), ("b", None, "")), ["k"], ["v", "u"], ["u"])
    assert sorted((r.k, r.v, r.u) for r in same.collect()) == [("a", "1", "x"), ("b", None, "")]
    for bad in (rows(("a", "1", ""), ("a", "2", "")), rows(("a", "1", "x"), ("a", "1", "y")), rows(("a", "1", "x"), ("a", None, "x"))):
        with pytest.raises(Exception, match="conflicting values"):
            streaming.one_per_key(bad, ["k"], ["v", "u"], ["u"]).collect()


def test_alignment_pairs_share_words(spark):
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    whole = dna(300)
    back = whole[100:140].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    t = spark.createDataFrame([("fits", whole[50:90]), ("back", back), ("none", dna(40)), ("short", "ACGT"), ("empty", "")], "id string, sequence string")
    loci = spark.createDataFrame([("l", whole), ("m", dna(200))], "id string, sequence string")
    got = {(r.transcript, r.locus) for r in genomics.alignment_pairs(t, loci).collect()}
    assert got == {("fits", "l"), ("back", "l")}


def test_contigs_from_lines_are_cut_at_every_border(spark):
    rng = random.Random(3)
    seqs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 200))) for i in range(6)}
    rows, at = [("f", 0, "ignored"), ("f", 1, "")], 2
    for name, s in seqs.items():
        rows.append(("f", at, f">{name} text"))
        width, i = rng.randrange(1, 40), 0
        while i < len(s):
            at += rng.randrange(1, 90_000)  # spans of ord end within records
            rows.append(("f", at, s[i : i + width]))
            i += width
        at += 1
    rows.append(("g", 0, ">c0 again"))
    rows.append(("g", 1, "TTTT"))
    lines = spark.createDataFrame(rows, "file string, ord long, line string")
    for size in (1, 7, 64):
        store = Contigs.from_fasta(lines, size)
        assert {r.id: r.n_bases for r in store.lengths.collect()} == {k: len(v) for k, v in seqs.items()}
        assert max(len(r.text) for r in store.chunks.collect()) <= size
        places = [(f"{k}{lo}", k, lo, lo + n) for k in seqs for lo, n in ((0, 500), (3, 1), (5, 64), (-2, 9), (199, 1), (6, 0))]
        got = {r.key: r.dna for r in store.cut_out(spark.createDataFrame(places, "key string, id string, lo long, hi long")).collect()}
        assert got == {key: seqs[k][max(lo, 0) : max(hi, 0)] for key, k, lo, hi in places}
    whole = {r.id: r.sequence for r in text.fasta(lines).where("file = 'f'").collect()}
    assert whole == seqs


def test_running_counts_need_no_window_over_a_file(spark):
    rows = spark.range(1000).select(F.lit("f").alias("file"), (F.col("id") * 37).alias("ord"), F.lit("x").alias("line"))
    got = text.running(rows, F.lit(1).cast("long"), "n", span=100)
    assert [r.n for r in got.orderBy("ord").collect()] == list(range(1, 1001))


def test_tails_read_on_until_a_stop(spark):
    s = "ATGTAA" + "GCC" * 500 + "ATG"
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    store = Contigs.of(spark.createDataFrame([("p", s), ("m", rc)], "id string, sequence string"), 64)
    places = spark.createDataFrame([(1, "p", len(s) - 2, False), (2, "m", 3, True), (3, "p", 1, False), (4, "p", 4, False)], "key int, id string, start int, minus boolean")
    got = {r.key: r.tail for r in store.upstream_tails(places, 30).collect()}
    assert got == {1: "A" * 500, 2: "A" * 500, 3: "", 4: "M"}


def test_bounds_by_model_positions(spark):
    seqs = spark.createDataFrame([(f"s{i}|x y", "ACDEFGHIKL") for i in range(6)], "id string, sequence string")
    hit = lambda rows: spark.createDataFrame(rows, "sequence string, model_length int, hmm_from int, hmm_to int")
    left = hit([("s0|x y", 5, 1, 5), ("s1|x y", 5, 2, 5), ("s2|x y", 5, 1, 5), ("s2|x y", 5, 1, 5), ("s3|x y", 5, 1, 5), ("s4|x y", 5, 1, 5), ("s5|x y", 5, 1, 5)])
    right = hit([(f"s{i}|x y", 4, 1, 4) for i in range(6)])
    maps = lambda pos: spark.createDataFrame([(f"s{i}|x y", {1: p[0], 4: p[1]}) for i, p in enumerate(pos)], "id string, hmm map<int, struct<pos: int, aa: string>>")
    lm = maps([((3, "D"), None)] * 3 + [(None, None), ((9, "K"), None), ((0, "A"), None)])
    rm = maps([(None, (8, "I"))] * 6)
    got = {r.id[:2]: (r.bounded_id, r.sequence, r.problem) for r in genomics.bounded(seqs, left, right, lm, rm).collect()}
    assert got == {"s0": ("s0_bounded_3-8|x y", "DEFGHI", None), "s1": (None, None, "span"), "s2": (None, None, "hits"), "s3": (None, None, "deletion"), "s4": (None, None, "order"), "s5": (None, None, "outside")}
    assert {r.problem for r in genomics.bounded(seqs, left, right, lm, rm, 6).collect()} == {"hits", "position"}


def test_a_batch_rewrites_only_the_buckets_it_changes(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v string, u string")
    put = lambda n, df: streaming.merge_batch(spark, df, n, f"{tmp_path}/t", ["k"], ["v", "u"], ["u"], buckets=16)
    first = put(0, rows(*((f"k{i}", str(i), "") for i in range(200))))
    assert len(first) == 16
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    before = files()
    assert put(1, rows(("k3", "3", ""), ("k4", "4", ""))) == [] and files() == before  # delivered again
    assert len(put(2, rows(("new", "1", "x")))) == 1
    assert len(put(3, rows(("k3", "3", "better")))) == 1
    now = files()
    assert len(now) == len(before) + 2 and all(now[p] == t for p, t in before.items())
    assert put(3, rows(("k3", "3", "better"))) == [] and files() == now  # the batch is published
    got = {r.k: (r.v, r.u) for r in streaming.latest(spark, f"{tmp_path}/t").collect()}
    assert got == {f"k{i}": (str(i), "better" if i == 3 else "") for i in range(200)} | {"new": ("1", "x")}
    with pytest.raises(Exception, match="conflict"):
        put(4, rows(("k9", "other", "")))


def test_rules_by_aggregates_agree_with_rules_over_arrays(spark):
    rng = random.Random(8)
    hits_df = spark.createDataFrame([(f"p{rng.randrange(30)}", f"PF0000{rng.randrange(1, 5)}.{rng.randrange(3)}", a, a + rng.randrange(5, 60)) for a in (rng.randrange(1, 300) for _ in range(120))], "query_accession string, target_accession string, query_start int, query_end int")
    proteins = spark.createDataFrame([(f"p{i}", "MAKL" * (i + 1)) for i in range(34)], "protein string, sequence string")
    one_of = rules.Pfam.matches
    rule = (
        one_of("PF00001") | one_of("PF00002.1").between_aa(1, 150) | one_of("PF00003").between_aa(20, 400, every=True) | one_of("PF00002").times(1, 2) | one_of("PF00004").times(2, overlapping=False)
        | one_of("PF00001").spans_aa(30, 200) | rules.Pfam.matches_only("PF00001", "PF00002") | rules.Pfam.matches_any("PF00004", "PF00009") | rules.Sequence.length_between(1, 40)
    )
    arrays, tables_ = rule.evaluate(rules.facts(proteins, Pfam=hits_df)), rule.judged(proteins, Pfam=hits_df)
    labels = [*rule.atoms(), "pass all"]
    pick = lambda df: {r.protein: [r[c] for c in labels] for r in df.collect()}
    assert pick(arrays) == pick(tables_) and "collect_list" not in (one_of("PF00001") & ~one_of("PF00002").between_aa(1, 9)).judged(proteins, Pfam=hits_df)._jdf.queryExecution().optimizedPlan().toString()
    relative = rules.Sequence.matches_regex("AK").relative_to("PF00001", -400, 400) & one_of("PF00002")
    with_start = proteins.withColumn("protein_start", F.lit(1))
    assert {r.protein: r["pass all"] for r in relative.judged(with_start, Pfam=hits_df).collect()} == {r.protein: r["pass all"] for r in relative.evaluate(rules.facts(with_start, Pfam=hits_df)).collect()}


def test_motif_tables_agree_with_motif_arrays(spark):
    rng = random.Random(9)
    hits_rows, scope_rows, proteins, arrays = [], [], [], []
    for i in range(60):
        p, scopes = f"p{i}", [(s, s + rng.randrange(10, 80)) for s in (rng.randrange(0, 200) for _ in range(rng.randrange(0, 3)))]
        found = [(rng.choice(["A", "A.1", "B", "C"]), s, s + rng.randrange(3, 12), float(rng.randrange(10))) for s in (rng.randrange(0, 260) for _ in range(rng.randrange(0, 12)))]
        genome, failed = rng.random() < 0.9, rng.random() < 0.1
        hits_rows += [(p, *h) for h in found]
        scope_rows += [(p, *s) for s in scopes]
        proteins.append((p, genome, failed))
        arrays.append((p, None if failed else found, scopes if genome else None))
    facts = spark.createDataFrame(arrays, "protein string, motifs array<struct<motif: string, start: int, end: int, score: double>>, scopes array<struct<s: int, e: int>>")
    t = spark.createDataFrame(proteins, "protein string, has_genome boolean, failed boolean")
    h, s = spark.createDataFrame(hits_rows, "protein string, motif string, start int, end int, score double"), spark.createDataFrame(scope_rows, "protein string, s int, e int")
    for args in (("A",), ("A", "B", 10), ("A", "B", 0, 4.0)):
        want = {r.protein: r["pass all"] if False else r[1] for r in facts.select("protein", rules.Motifs(*args).column().alias("r")).collect()}
        got = {r.protein: r.result for r in rules.motif_verdicts(t.select("protein", "has_genome"), s, h, t.where("failed"), *args).collect()}
        assert got == want and len(set(got.values())) > 3


def test_burial_equals_the_areas_of_whole_chains(spark):
    rng = np.random.default_rng(5)
    rows = [("m", c, i // 3, f"X{i}", rng.choice(["C", "N", "O", "S"]).item(), *(rng.normal(0 if c == "A" else 5, 4, 3).tolist())) for c in "AB" for i in range(24)] + [("m", "A", 99, "H", "H", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, chain string, number int, name string, element string, x double, y double, z double")
    got = contacts.burial(df, points=240).collect()
    heavy = [r for r in rows if r[4] != "H"]
    xyz, radius = np.array([r[5:] for r in heavy]), np.array([contacts.RADII[r[4]] for r in heavy])
    one_ = np.array([r[1] == "A" for r in heavy])
    apart = kernels.accessible_area(xyz[one_], radius[one_]).sum() + kernels.accessible_area(xyz[~one_], radius[~one_]).sum()
    assert len(got) == 16 and sum(r.sasa_isolated for r in got) == pytest.approx(apart, rel=0.02)
    assert sum(r.sasa_complex for r in got) == pytest.approx(kernels.accessible_area(xyz, radius).sum(), rel=0.03)
    assert all(0 <= r.buried_nonpolar_area <= r.buried_area + 1e-9 for r in got) and contacts.nonpolar_share(contacts.burial(df, points=40)).first().nonpolar > 0


def test_overlap_moves_partners_by_every_subset(spark):
    rng = np.random.default_rng(6)
    shared, p, u = rng.normal(0, 8, (20, 3)), rng.normal(6, 3, (8, 3)), rng.normal(7, 3, (8, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    place = lambda c: c @ turn + np.array([30.0, -4.0, 7.0])
    noisy = place(shared + rng.normal(0, 0.2, shared.shape))
    schema = "job string, chain string, number int, name string, element string, plddt double, x double, y double, z double"
    rows = lambda chain, name, c, shift=0: [("j", chain, i + 1 + shift, name, "C", 90.0 if i % 2 else 50.0, *map(float, x)) for i, x in enumerate(c)]
    first = spark.createDataFrame(rows("S", "CA", shared) + rows("P", "CB", p), schema)
    second = spark.createDataFrame(rows("T", "CA", noisy, 3) + rows("U", "CB", place(u)), schema)
    jobs = spark.createDataFrame([("j", "S", "T", 1, 4, 20, 20, 20, True)], "job string, shared_a string, shared_b string, start_a int, start_b int, length int, length_a int, length_b int, known boolean")
    o = overlap.Overlap(first, second, jobs)
    got = {r.subset: r for r in o.sensitivity().collect()}
    assert set(got) == {"whole_chain", "exclude_terminal_three", "source_plddt_ge_80", "site_a_P", "site_b_U"}
    for name, keep in (("whole_chain", np.ones(20, bool)), ("exclude_terminal_three", np.arange(20) % 17 >= 3), ("source_plddt_ge_80", np.arange(20) % 2 == 1)):
        if name == "exclude_terminal_three":
            keep = np.array([3 < n <= 17 for n in range(1, 21)])
        r, t, rmsd = kernels.superposition(noisy[keep], shared[keep])
        d = np.linalg.norm(p[:, None] - (place(u) @ r.T + t)[None], axis=2)
        x = got[name]
        assert x.matched_CA == keep.sum() and x.fit_RMSD == pytest.approx(rmsd, abs=1e-6) and x.min_partner_distance == pytest.approx(d.min(), abs=1e-6) and x.clash_atom_pairs == (3.4 - d > 0.4).sum()
    line = spark.createDataFrame(rows("S", "CA", np.outer(np.arange(5), [1, 2, 3])) + rows("P", "CB", p), schema)
    flat = overlap.Overlap(line, spark.createDataFrame(rows("T", "CA", np.outer(np.arange(5), [2, 2, 3]), 3) + rows("U", "CB", u), schema), jobs).sensitivity().collect()
    assert {r.status for r in flat} == {"insufficient or degenerate coordinates"}


def test_bad_folds_become_problems(spark):
    cif = "data_x\nloop_\n_atom_site.label_asym_id\n_atom_site.label_comp_id\n_atom_site.label_atom_id\n_atom_site.label_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nA ALA CA 1 0 0 0\nA ALA CB 1 0 0\nA 'ALA CB 1 0 0 0\n#\n"
    rows = [("f/a_model_0.cif", cif.encode()), ("f/a_full_data_0.json", b"{broken"), ("f/a_full_data_1.json", b'{"token_chain_ids": ["A"], "token_res_ids": [null], "pae": [[0]]}'), ("f/a_full_data_2.json", b"[1]"), ("f/a_full_data_3.json", b'{"token_chain_ids": ["A"], "token_res_ids": [4], "pae": [["x"]]}')]
    found = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "locator string, content binary")
    assert sorted(str(r.problem) for r in folds.atoms(found).collect()) == ["None", "columns", "columns"]
    assert {r.model[-5]: r.problem for r in folds.tokens(found).collect()} == {"0": "token lists", "1": "token ids", "2": "token lists", "3": None}
    assert sorted((r.model[-5], str(r.value)) for r in folds.pae(found).collect()) == [("1", "0.0"), ("3", "nan")] or sorted((r.model[-5], r.value) for r in folds.pae(found).where("value IS NOT NULL AND NOT isnan(value)").collect()) == [("1", 0.0)]


def test_model_inputs_and_the_selected_one(spark):
    names = ["f/a_model_0.cif", "f/a_full_data_0.json", "f/a_model_2.cif", "f/a_full_data_2.json", "f/a_job_request.json", "z.zip!/g/b_model_1.cif", "z.zip!/g/b_full_data_1.json", "z.zip!/g/b_full_data_1.json", "h/model0_complex.cif"]
    found = spark.createDataFrame([(n, bytearray(b'{"modelSeeds": [7]}')) for n in names], "locator string, content binary")
    got = {(r.source, r.model): (r.data, r.seed, r.problem) for r in folds.model_inputs(found).collect()}
    assert got == {("f", 0): ("f/a_full_data_0.json", 7, None), ("f", 2): ("f/a_full_data_2.json", 7, None), ("z.zip!/g", 1): ("z.zip!/g/b_full_data_1.json", None, "data"), ("h", 0): (None, None, None)}
    assert {(r.source, r.model, r.problem) for r in folds.model_inputs(found, 2).collect()} == {("f", 2, None), ("z.zip!/g", 2, "selected"), ("h", 2, "selected")}


def test_appended_tables_keep_their_header(spark, tmp_path):
    path, df = f"{tmp_path}/t", spark.createDataFrame([("a", "1"), ("b", "x y")], "k string, v string")
    sinks.append_tsv(df, path)
    sinks.append_tsv(df.limit(1), path)
    assert sorted((r.k, r.v) for r in spark.read.csv(path, sep="\t", header=True).collect()) == [("a", "1"), ("a", "1"), ("b", "x y")]
    with pytest.raises(ValueError, match="columns"):
        sinks.append_tsv(df.select("v", "k"), path)
