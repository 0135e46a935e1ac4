"""Loci, leader candidates and exons."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accessions import leader_id
from ..functions.sequences import after_last_stop, reverse_complement, starts_with_met, strip_organism, translate_codons
from ..sources.text import values_of
from ..session import settled
from .contigs import Contigs, leader_of


def leader_candidates(proteins: DataFrame, within: int = 10) -> DataFrame:
    """protein, accession, start_label, start, sequence, is_original: the original and every M among the first residues."""
    s = F.col("sequence")
    starts = proteins.select("protein", "sequence", F.explode(F.concat(F.array(F.lit(0)), F.filter(starts_with_met(s, F.lit(within)), lambda i: i > 1))).alias("at"))
    original = F.col("at") == 0
    return starts.select(
        "protein", F.when(original, F.col("protein")).otherwise(leader_id(F.col("protein"), F.col("at").cast("string"))).alias("accession"), F.when(original, "original").otherwise(F.col("at").cast("string")).alias("start_label"),
        F.when(original, 1).otherwise(F.col("at")).alias("start"), F.when(original, s).otherwise(F.substring(s, F.greatest(F.col("at"), F.lit(1)), F.length(s))).alias("sequence"), original.alias("is_original"),
    )


def upstream_tail(contig: Column, first_base: Column, minus: Column) -> Column:
    """Residues upstream of the first coding base in its frame, after the last stop."""
    before = F.when(minus, reverse_complement(F.substring(contig, first_base + 1, F.length(contig)))).otherwise(F.substring(contig, F.lit(1), first_base - 1))
    whole = F.substring(before, F.pmod(F.length(before), F.lit(3)) + 1, F.length(before))
    return F.coalesce(after_last_stop(translate_codons(whole)), F.lit(""))


def curated_candidates(proteins: DataFrame, within: int = 10) -> DataFrame:
    """Candidates at every M of tail + protein up to protein position ``within``; upstream starts count down from 0 (label u1).

    proteins: protein, sequence, tail.  A protein without a candidate keeps its original.
    """
    text, n = F.concat("tail", "sequence"), F.length("tail")
    at = starts_with_met(text, n + within)
    each = proteins.select("protein", "sequence", text.alias("text"), n.alias("n"), F.explode(F.when(F.size(at) > 0, at).otherwise(F.array(F.lit(-1)))).alias("at"))
    none, start = F.col("at") < 0, F.col("at") - F.col("n")
    label = F.when(none, "original").when(start <= 0, F.concat(F.lit("u"), (1 - start).cast("string"))).otherwise(start.cast("string"))
    return each.select("protein", F.when(none, F.col("protein")).otherwise(F.concat_ws("_", "protein", F.lit("with_leader"), label, F.lit("M"))).alias("accession"), label.alias("start_label"), F.when(none, 1).otherwise(start).alias("start"), F.when(none, F.col("sequence")).otherwise(F.substring("text", F.col("at"), F.length("text"))).alias("sequence"))


def anchored_candidates(proteins: DataFrame, first: int, last: int) -> DataFrame:
    """Candidates whose M lies at first..last (no zero) relative to the anchor residue; proteins: protein, sequence, tail, anchor."""
    lo, hi = min(first, last), max(first, last)
    each = proteins.select("protein", F.concat("tail", "sequence").alias("text"), (F.length("tail") + F.col("anchor")).alias("a"))
    begin, end = F.greatest(F.col("a") + (lo if lo <= 0 else lo - 1), F.lit(1)), F.col("a") + (hi if hi < 0 else hi - 1)
    width = (end - begin + 1).cast("int")
    part = F.substring("text", begin.cast("int"), width)  # only the asked places are looked at
    each = each.withColumn("at", F.explode(F.transform(starts_with_met(part, width), lambda i: i + begin.cast("int") - 1)))
    rel = F.when(F.col("at") >= F.col("a"), F.col("at") - F.col("a") + 1).otherwise(F.col("at") - F.col("a"))
    label = F.when(rel < 0, F.concat(F.lit("u"), (-rel).cast("string"))).otherwise(rel.cast("string"))
    return each.where(rel.between(lo, hi)).select("protein", F.concat_ws("_", "protein", F.lit("with_leader"), label, F.lit("M")).alias("accession"), label.alias("start_label"), rel.alias("anchor_start"), F.substring("text", F.col("at"), F.length("text")).alias("sequence"))


def loci(features: DataFrame) -> DataFrame:
    """protein, seqid, strand, start, end, cds of each protein_id: its transcript's span, else that of its CDS.

    features: seqid, type, start, end, strand, attrs.  Children meet parents through exploded Parent lists.
    """
    cds = features.where("type = 'CDS'").withColumn("protein", F.try_element_at("attrs", F.lit("protein_id"))).where("protein IS NOT NULL")
    parts = cds.select("protein", "seqid", "strand", F.struct(F.col("start").alias("s"), F.col("end").alias("e")).alias("x"))
    per = parts.groupBy("protein", "seqid", "strand").agg(F.array_sort(F.collect_set("x")).alias("cds"))
    up = cds.select("protein", F.explode(values_of(F.col("attrs"), "Parent")).alias("pid")).distinct()
    tx = features.where(F.col("type").isin("mRNA", "transcript")).select(F.try_element_at("attrs", F.lit("ID")).alias("pid"), F.col("start").alias("ts"), F.col("end").alias("te"))
    span = up.join(tx, "pid").groupBy("protein").agg(F.min("ts").alias("ts"), F.max("te").alias("te"))
    j = per.join(span, "protein", "left")
    lo, hi = F.coalesce("ts", F.array_min(F.transform("cds", lambda c: c["s"]))), F.coalesce("te", F.array_max(F.transform("cds", lambda c: c["e"])))
    minus = F.col("strand") == "-"
    return j.select("protein", "seqid", "strand", F.when(minus, hi).otherwise(lo).alias("start"), F.when(minus, lo).otherwise(hi).alias("end"), "cds")


def locus_window(places: DataFrame, contigs: DataFrame | Contigs, before: int, after: int) -> DataFrame:
    """0-based half-open windows around loci, clipped to the contig, with the strand's sequence."""
    return _store(contigs).windows(places, before, after)


def _store(contigs: DataFrame | Contigs) -> Contigs:
    return contigs if isinstance(contigs, Contigs) else Contigs.of(contigs)


def locus_features(places: DataFrame) -> DataFrame:
    """Rows start, stop, dss and ass (first and last base of the coding sequence, intron borders) along the strand."""
    minus = F.col("strand") == "-"
    along = F.when(minus, F.reverse("cds")).otherwise(F.col("cds"))
    head, tail = (lambda c: F.when(minus, c["e"]).otherwise(c["s"])), (lambda c: F.when(minus, c["s"]).otherwise(c["e"]))
    t = places.select("protein", "strand", along.alias("c"))
    row = lambda name, at: F.struct(F.lit(name).alias("feature"), at.alias("position"))
    inner = F.size("c")
    rows = F.concat(
        F.array(row("start", head(F.element_at("c", 1)))), F.transform(F.slice("c", 1, inner - 1), lambda c: row("dss", tail(c))),
        F.transform(F.slice("c", 2, F.greatest(inner - 1, F.lit(0))), lambda c: row("ass", head(c))), F.array(row("stop", tail(F.element_at("c", -1)))),
    )
    return t.select("protein", "strand", F.explode(rows).alias("r")).select("protein", "strand", "r.*")


def exon_residues(places: DataFrame) -> DataFrame:
    """protein, exon (along the strand), first and last residue, bases of split codons at either end."""
    minus = F.col("strand") == "-"
    each = places.select("protein", F.posexplode(F.when(minus, F.reverse("cds")).otherwise(F.col("cds"))).alias("i", "c"))
    w = Window.partitionBy("protein").orderBy("i")
    n = F.col("c.e") - F.col("c.s") + 1
    t = each.withColumn("n", n).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return t.select("protein", (F.col("i") + 1).alias("exon"), (F.floor(F.col("before") / 3) + 1).alias("first_aa"), F.ceil((F.col("before") + F.col("n")) / 3).alias("last_aa"), F.pmod(F.lit(3) - F.pmod("before", F.lit(3)), F.lit(3)).alias("head_bases"), F.pmod(F.col("before") + F.col("n"), F.lit(3)).alias("tail_bases"))


def collate_fragments(fragments: DataFrame) -> DataFrame:
    """protein -> sequence of fragments (protein, first, last, sequence) in order, gaps filled with X."""
    w = Window.partitionBy("protein").orderBy("first")
    gap = F.greatest(F.col("first") - F.coalesce(F.lag("last").over(w), F.col("first") - 1) - 1, F.lit(0))
    t = fragments.withColumn("piece", F.concat(F.repeat(F.lit("X"), gap.cast("int")), F.col("sequence")))
    return t.groupBy("protein").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "piece"))), lambda x: x["piece"]), "").alias("sequence"))


def protein_names(records: DataFrame) -> DataFrame:
    """accession, name without a trailing [organism]; names that differ between genomes are a problem."""
    t = records.select(F.col("id").alias("accession"), strip_organism(F.col("description")).alias("name"))
    return t.groupBy("accession").agg(F.min("name").alias("name"), F.when(F.countDistinct("name") > 1, "conflict").alias("problem"))


def bounded(sequences: DataFrame, left_hits: DataFrame, right_hits: DataFrame, left_map: DataFrame, right_map: DataFrame, left_position: int = 1, right_position: int | None = None, describe: str | None = None) -> DataFrame:
    """id, bounded_id, sequence, problem: sequences cut from a position of one model to a position of another, by their alignments.

    hits: sequence, model_length, hmm_from, hmm_to; each sequence needs one hit of either model, which spans the position (right: the
    model's last by default).  maps: id, hmm (``sources.text.alignment_map``: model position -> place in the sequence).  The id gets
    ``_bounded_first-last`` before its first ``|``, and ``|describe`` at the end.  Problems: hits, position (beyond the model), span (the
    hit ends before it), deletion (the position aligns to a gap), order, outside.
    """
    if min(left_position, right_position or 1) < 1:
        raise ValueError("model positions start at 1")
    if describe is not None and (not describe or any(c.isspace() for c in describe)):
        raise ValueError("a description has no white space")

    def one(hits, side):
        return hits.groupBy(F.col("sequence").alias("id")).agg(F.count(F.lit(1)).alias(f"{side}n"), *(F.min(c).alias(f"{side}_{c}") for c in ("model_length", "hmm_from", "hmm_to")))

    j = sequences.join(one(left_hits, "l"), "id", "left").join(one(right_hits, "r"), "id", "left")
    wanted = {"l": F.lit(left_position), "r": F.col("r_model_length") if right_position is None else F.lit(right_position)}
    j = j.withColumns({f"{s}_at": w for s, w in wanted.items()})
    for side, places in (("l", left_map), ("r", right_map)):
        at = places.select("id", F.explode("hmm").alias("k__", "cell__")).select("id", F.col("k__").alias(f"{side}_at"), F.col("cell__.pos").alias(f"{side}_pos"))
        j = j.join(at, ["id", f"{side}_at"], "left")
    beyond = lambda s: F.col(f"{s}_at") > F.col(f"{s}_model_length")
    spans = lambda s: F.col(f"{s}_at").between(F.col(f"{s}_hmm_from"), F.col(f"{s}_hmm_to"))
    first, last = F.col("l_pos"), F.col("r_pos")
    problem = (
        F.when((F.coalesce("ln", F.lit(0)) != 1) | (F.coalesce("rn", F.lit(0)) != 1), "hits").when(beyond("l") | beyond("r"), "position").when(~spans("l") | ~spans("r"), "span")
        .when(first.isNull() | last.isNull(), "deletion").when(first > last, "order").when((first < 1) | (last > F.length("sequence")), "outside")
    )
    t = j.withColumn("problem", problem)
    head, rest = F.split_part("id", F.lit("|"), F.lit(1)), F.regexp_extract("id", r"^[^|]*(\|.*)?$", 1)
    name = F.concat(head, F.lit("_bounded_"), first.cast("string"), F.lit("-"), last.cast("string"), rest, F.lit("" if describe is None else f"|{describe}"))
    ok = F.col("problem").isNull()
    return t.select("id", F.when(ok, name).alias("bounded_id"), F.when(ok, F.substring("sequence", first, last - first + 1)).alias("sequence"), "problem")


def _open_runs(text: Column, window: int, most: float, chunk: int) -> Column:
    """first and last place (0-based) of the runs of window starts among the first ``chunk`` places of a text, from running counts of N."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def runs(texts: pd.Series) -> pd.Series:
        def one(s):
            base = np.frombuffer(s.encode("utf-32-le"), "<u4")
            count = np.concatenate(([0], np.cumsum((base == ord("N")) | (base == ord("n")))))
            good = np.zeros(min(max(len(base) - window + 1, 0), chunk) + 2, dtype=np.int8)
            good[1:-1] = ((count[window:] - count[:-window]) / window <= most)[:chunk]
            edge = np.diff(good)
            return [{"first": int(i), "last": int(j) - 1} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]

        return texts.map(one)

    return runs(text)


def open_starts(contigs: DataFrame, window: int, most: float = 0.1, chunk: int = 1 << 14) -> DataFrame:
    """id, first, last (0-based) runs of window starts with at most this share of N, from running counts.

    A contig is cut into chunks that overlap by a window, so that a chromosome is many tasks' work; a chunk's runs are found where it lies
    and only runs travel.  Runs that meet at a border are put together again.
    """
    n = F.length("sequence")
    cut = lambda c: F.substring(F.col("sequence"), c * chunk + 1, F.lit(chunk + window - 1))
    pieces = contigs.where(n > 0).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), cut)).alias("c", "s"))
    kept = pieces.select("id", "c", F.explode(_open_runs(F.col("s"), window, most, chunk)).alias("r")).select("id", *((F.col("c") * chunk + F.col(f"r.{x}")).alias(x) for x in ("first", "last")))
    by = Window.partitionBy("id").orderBy("first")
    new = F.coalesce(F.col("first") > F.lag("last").over(by) + 1, F.lit(True)).cast("int")
    parts = kept.withColumn("new", new)  # few rows a contig
    return parts.withColumn("g", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")


#: Bins that draws and intervals meet in.
_BINS = 1024


def numbered_intervals(intervals: DataFrame) -> DataFrame:
    """id, first, last, before: intervals with the number of starts before them, in the order of id and first.

    The intervals are range-partitioned; places in a part are summed there, and the parts' sums are as many rows as there are parts.
    """
    order = ["id", "first"]
    parts = settled(intervals.where("last >= first").select("id", "first", "last").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    n = F.col("last").cast("long") - F.col("first") + 1
    sums = parts.groupBy("part").agg(F.sum(n).alias("n"))
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = F.sum(n).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - n
    return parts.withColumn("inner", inner).join(F.broadcast(bases), "part").select("id", "first", "last", (F.col("base") + F.col("inner")).alias("before"))


def starts_at(numbered: DataFrame, draws: DataFrame, total: int) -> DataFrame:
    """draws (k, ...) with id and start of the k-th of all starts, from 0: in equal bins of k, the last interval that begins up to a draw holds it.

    A sweep: intervals and draws of a bin lie along one order, so a bin's work is sorting its rows, however many there are.
    """
    size = max(1, -(-total // _BINS))
    end = F.col("before") + F.col("last") - F.col("first")
    held = numbered.withColumn("bin", F.explode(F.sequence(F.floor(F.col("before") / size), F.floor(end / size))))
    held = held.select("bin", F.col("before").alias("at"), F.lit(0).alias("side"), F.struct("id", "first", "before", end.alias("end")).alias("interval"))
    rows = draws.select(F.floor(F.col("k") / size).alias("bin"), F.col("k").cast("long").alias("at"), F.lit(1).alias("side"), F.struct(*draws.columns).alias("draw"))
    along = Window.partitionBy("bin").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    swept = held.unionByName(rows, allowMissingColumns=True).withColumn("interval", F.last("interval", ignorenulls=True).over(along)).where("side = 1")
    met = swept.where(F.col("at") <= F.col("interval.end"))
    return met.select(*(F.col(f"draw.{c}").alias(c) for c in draws.columns), "interval.id", (F.col("interval.first") + F.col("at") - F.col("interval.before")).alias("start"))


def sample_starts(intervals: DataFrame, n: int = 10_000, seed: int = 0) -> DataFrame:
    """nth, id, start: n starts (a parameter) drawn with replacement, uniformly over all starts of the intervals (id, first, last); the same for the same seed."""
    numbered = settled(numbered_intervals(intervals))
    total = numbered.agg(F.sum(F.col("last").cast("long") - F.col("first") + 1)).first()[0]
    if not total:
        raise ValueError("no window fits")
    rng = random.Random(seed)
    draws = intervals.sparkSession.createDataFrame([(i, rng.randrange(total)) for i in range(n)], "nth long, k long")
    return starts_at(numbered, draws, total).select("nth", "id", "start")


def first_genome(rows: DataFrame) -> DataFrame:
    """The first genome's row (by ord) of proteins in several; different sequences are a problem."""
    w = Window.partitionBy("protein")
    n = F.row_number().over(w.orderBy("ord"))
    differ = F.min("sequence").over(w) != F.max("sequence").over(w)
    return rows.withColumn("problem", F.when(differ, "sequences differ")).withColumn("nth__", n).where("nth__ = 1").drop("nth__")


def match_columns(records: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Alignment columns where the first record has a residue; right is cut before left, 0 cuts nothing."""
    first = records.orderBy("ord").limit(1).select(F.col("sequence").alias("lead"))
    j = records.crossJoin(F.broadcast(first))  # one row
    kept = F.array_join(F.filter(F.transform(F.split("lead", ""), lambda c, i: F.when(~c.isin("-", ".", ""), F.substring(F.col("sequence"), i + 1, F.lit(1)))), lambda x: x.isNotNull()), "")
    out = j.withColumn("sequence", kept)
    if right:
        out = out.withColumn("sequence", F.substring("sequence", F.lit(1), F.lit(right)))
    if left:
        out = out.withColumn("sequence", F.expr(f"substring(sequence, {left})"))
    return out.drop("lead")


def start_trim(sequence: Column) -> Column:
    """Residues to cut so that a sequence starts with M: 1 or 2, and 0 where it starts with M already or none is that near."""
    at = lambda i: F.substring(sequence, i, 1) == "M"
    return F.when(at(1), 0).when(at(2), 1).when(at(3), 2).otherwise(0)


def leader_prefix(contig: Column, first_base: Column, minus: Column) -> Column:
    """Upstream residues from the last M after the last stop, or all after that stop where there is no M."""
    return F.regexp_replace(upstream_tail(contig, first_base, minus), "^.*M", "M")


def detected_loci(fragments: DataFrame, proteins: DataFrame, contigs: DataFrame | Contigs, *, leader: bool = True) -> DataFrame:
    """Loci of proteins that were found as fragments on a contig, with their leader or start trim unless ``leader`` is off.

    fragments: protein, contig, start, end (on the contig, reversed on the minus strand), target_start, target_end (place in
    the protein, null: by contig place), ord.  proteins: protein, sequence.  contigs: a store, or rows (id, sequence).  Returns protein,
    contig, start, end, strand, prefix, trim, sequence (of the protein), dna, cds (1-based spans along the strand within the locus),
    start_codon, problem (fragments, contigs, contig missing, before the contig; then the rest is null).
    """
    store = _store(contigs)
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    place = F.when(F.col("target_start").isNull(), lo).otherwise(F.least("target_start", "target_end"))
    part = F.struct(place.alias("place"), "ord", "contig", "start", "end", lo.alias("lo"), hi.alias("hi"))
    per = fragments.groupBy("protein").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a protein has few fragments
    t = proteins.select("protein", "sequence").join(per, "protein", "left")
    t = t.withColumn("contig", F.col("parts")[0]["contig"]).withColumn("first", F.col("parts")[0]["start"]).withColumn("end", F.element_at("parts", -1)["end"])
    t = settled(t.join(store.lengths.select(F.col("id").alias("contig"), "n_bases"), "contig", "left"))
    one = ~F.exists("parts", lambda p: ~p["contig"].eqNullSafe(F.col("contig")))
    minus = F.col("first") > F.col("end")
    trim = start_trim(F.col("sequence")) if leader else F.lit(0)
    t = t.withColumn("trim", trim)
    if leader:  # only proteins without a start read upstream
        bare = F.col("n_bases").isNotNull() & (F.col("trim") == 0) & ~F.startswith("sequence", F.lit("M"))
        tails = store.upstream_tails(t.where(bare).select(F.col("protein").alias("key"), F.col("contig").alias("id"), F.col("first").alias("start"), minus.alias("minus")))
        t = t.join(tails.select(F.col("key").alias("protein"), leader_of(F.col("tail")).alias("prefix")), "protein", "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))
    else:
        t = t.withColumn("prefix", F.lit(""))
    along = F.when(minus, -1).otherwise(1)
    t = t.withColumn("start", F.col("first") + along * 3 * (F.col("trim") - F.length("prefix")))
    problem = F.when(F.col("parts").isNull(), "fragments").when(~one, "contigs").when(F.col("n_bases").isNull(), "contig missing").when(F.least("start", "end") < 1, "before the contig")
    back = F.col("start") > F.col("end")
    a, b = F.least("start", "end"), F.greatest("start", "end")
    t = t.withColumn("problem", problem).withColumn("back", back).withColumn("lo", (a - 1).cast("long")).withColumn("hi", b.cast("long"))
    asked = t.where("problem IS NULL").select(F.col("protein").alias("key"), F.col("contig").alias("id"), "lo", "hi")
    t = t.join(store.cut_out(asked, "dna").select(F.col("key").alias("protein"), "dna"), "protein", "left")
    clipped = F.filter(F.transform("parts", lambda p: F.struct(F.greatest(p["lo"], a).alias("lo"), F.least(p["hi"], b).alias("hi"))), lambda p: p["lo"] <= p["hi"])
    span = lambda p: F.when(back, F.struct((F.col("start") - p["hi"] + 1).alias("s"), (F.col("start") - p["lo"] + 1).alias("e"))).otherwise(F.struct((p["lo"] - F.col("start") + 1).alias("s"), (p["hi"] - F.col("start") + 1).alias("e")))
    kept = F.substring("sequence", F.col("trim") + 1, F.length("sequence"))
    ok = lambda c: F.when(F.col("problem").isNull(), c)
    return t.select(
        "protein", ok(F.col("contig")).alias("contig"), ok(F.col("start")).alias("start"), ok(F.col("end")).alias("end"), ok(F.when(back, "-").otherwise("+")).alias("strand"),
        ok(F.col("prefix")).alias("prefix"), ok(F.col("trim")).alias("trim"), ok(F.concat("prefix", kept)).alias("sequence"), ok(F.when(back, reverse_complement(F.col("dna"))).otherwise(F.col("dna"))).alias("dna"),
        ok(F.array_sort(F.transform(clipped, span))).alias("cds"), ok(F.startswith(kept, F.lit("M")) | (F.length("prefix") > 0)).alias("start_codon"), "problem",
    )


def alignment_pairs(transcripts: DataFrame, loci: DataFrame, k: int = 11, shared: int = 2) -> DataFrame:
    """transcript, locus, a, b, n: pairs worth an alignment (``kernels.align``), which share at least this many distinct words
    of k bases on either strand of the locus; an equi-join on the words, not all pairs.  Pairs below that are not aligned."""
    def words(s):
        n = F.length(s) - (k - 1)
        return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))

    t = transcripts.select(F.col("id").alias("transcript"), F.explode(words(F.col("sequence"))).alias("word"))
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("sequence").alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("sequence")).alias("s")))).alias("x")
    at = loci.select(F.col("id").alias("locus"), both).select("locus", "x.strand", F.explode(words(F.col("x.s"))).alias("word"))
    near = t.join(at, "word").groupBy("transcript", "locus", "strand").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared).groupBy("transcript", "locus").agg(F.max("n").alias("n"))
    a, b = transcripts.select(F.col("id").alias("transcript"), F.col("sequence").alias("a")), loci.select(F.col("id").alias("locus"), F.col("sequence").alias("b"))
    return near.join(a, "transcript").join(b, "locus").select("transcript", "locus", "a", "b", "n")
