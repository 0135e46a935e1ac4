"""Contigs as indexed chunks, and what is cut out of them: no row ever holds a contig.

A store has chunks (id, chunk, text), text being the bases from chunk * size on, and lengths (id, n_bases).  Places on a contig meet
the chunks they touch by an equi-join on (id, chunk), one to three rows for a gene, and the pieces are put together in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import after_last_stop, reverse_complement, translate_codons
from ..session import settled
from ..sources.text import record_lines

CHUNK = 1 << 16


@dataclass(frozen=True)
class Contigs:
    chunks: DataFrame
    lengths: DataFrame
    size: int = CHUNK

    @staticmethod
    def of(contigs: DataFrame, size: int = CHUNK) -> Contigs:
        """From rows (id, sequence) that are there already."""
        n = F.length("sequence")
        pieces = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one pass, and a row holds its chunk only
        chunks = contigs.select("id", F.posexplode(pieces).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))
        return Contigs(chunks, contigs.select("id", n.cast("long").alias("n_bases")), size)

    @staticmethod
    def from_fasta(lines: DataFrame, size: int = CHUNK) -> Contigs:
        """From lines (file, ord, line) of FASTA files: lines find their place in their record by running counts, and are cut where a chunk ends.

        The first record of an id over all files, by file name, counts.  The store is settled once: several cuts read it.
        """
        placed = settled(record_lines(lines))
        heads = placed.where("opens").select("file", "record", F.regexp_extract("text", r"^>\s*(\S*)", 1).alias("id"), F.col("run").alias("base"))
        first = heads.groupBy("id").agg(F.min(F.struct("file", "record", "base")).alias("h")).select("id", F.col("h.file").alias("f"), F.col("h.record").alias("r"), F.col("h.base").alias("base"))
        body = placed.where("NOT opens AND record > 0").join(first, (F.col("file") == F.col("f")) & (F.col("record") == F.col("r")))
        at = F.col("run") - F.length("text") - F.col("base")  # bases of the record before the line
        body = body.select("id", at.alias("at"), "text").where(F.length("text") > 0)
        cuts = body.select("id", "at", "text", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.length("text") - 1) / size))).alias("chunk"))
        lo = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0))
        hi = F.least((F.col("chunk") + 1) * size - F.col("at"), F.length("text"))
        pieces = cuts.select("id", "chunk", F.struct((F.col("at") + lo).alias("at"), F.substring("text", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("s")).alias("p"))
        chunks = pieces.groupBy("id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("text"))  # size bases at most
        sizes = body.groupBy("id").agg(F.max(F.col("at") + F.length("text")).alias("n"))
        return Contigs(settled(chunks), first.select("id").join(sizes, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_bases")), size)

    def cut_out(self, places: DataFrame, name: str = "dna") -> DataFrame:
        """places (key, id, lo, hi, ...) with the bases lo to hi (0-based, hi excluded, clipped to the contig), empty where there are none.

        key must tell places apart; a null hi gives an empty text.
        """
        touched = F.sequence(F.floor(F.greatest(F.col("lo"), F.lit(0)) / self.size), F.floor((F.col("hi") - 1) / self.size))
        inside = (F.col("hi") > F.col("lo")) & (F.col("hi") > 0)
        each = places.where(inside).select("key", "id", F.col("lo").alias("a"), F.col("hi").alias("b"), F.explode(touched).alias("chunk"))
        j = each.join(self.chunks, ["id", "chunk"])
        lo = F.greatest(F.col("a") - F.col("chunk") * self.size, F.lit(0))
        hi = F.least(F.col("b") - F.col("chunk") * self.size, F.lit(self.size))
        piece = F.substring("text", (lo + 1).cast("int"), (hi - lo).cast("int"))
        got = j.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("s")))), lambda p: p["s"]), "").alias(name))
        return places.join(got, "key", "left").withColumn(name, F.coalesce(name, F.lit("")))

    def upstream_tails(self, places: DataFrame, first: int = 3 * 1024) -> DataFrame:
        """places (key, id, start, minus, ...) with tail: the residues upstream of the base ``start`` (1-based, the first coding one) in its
        frame, after the last stop.

        ``first`` bases are read; only places whose window holds no stop and ends inside the contig read on, eight times as far each time, so what
        is read is in proportion to the open frame, and rounds are few.
        """
        rest, done, width = places, [], first // 3 * 3
        while True:
            room = rest.join(self.lengths.select("id", F.col("n_bases").alias("room__")), "id")
            lo = F.when(F.col("minus"), F.col("start")).otherwise(F.greatest(F.col("start") - 1 - width, F.lit(0)))
            hi = F.when(F.col("minus"), F.least(F.col("start") + width, F.col("room__"))).otherwise(F.col("start") - 1)
            open_ = F.when(F.col("minus"), F.col("start") + width < F.col("room__")).otherwise(F.col("start") - 1 > width)
            got = self.cut_out(room.withColumn("lo", lo.cast("long")).withColumn("hi", hi.cast("long")).withColumn("open__", open_), "dna__")
            before = F.when(F.col("minus"), reverse_complement(F.col("dna__"))).otherwise(F.col("dna__"))
            got = got.withColumn("before__", before)
            frame = F.substring("before__", F.pmod(F.length("before__"), F.lit(3)) + 1, F.length("before__"))
            got = got.withColumn("protein__", translate_codons(frame))
            more = F.col("open__") & ~F.contains("protein__", F.lit("*"))
            got = settled(got.select(*places.columns, F.when(~more, F.coalesce(after_last_stop(F.col("protein__")), F.lit(""))).alias("tail")))
            done.append(got.where("tail IS NOT NULL"))
            rest = got.where("tail IS NULL").select(*places.columns)
            if rest.isEmpty():
                return reduce(DataFrame.unionByName, done)
            width *= 8

    def windows(self, places: DataFrame, before: int, after: int) -> DataFrame:
        """protein, seqid, strand, window_0b, window_0b_excl, sequence: 0-based half-open windows around loci, clipped to the contig, in the strand's direction."""
        minus, lo, hi = F.col("strand") == "-", F.least("start", "end"), F.greatest("start", "end")
        t = places.join(self.lengths.withColumnRenamed("id", "seqid"), "seqid").withColumn("key", F.struct("protein", "seqid", "strand", "start", "end"))
        a = F.greatest(lo - 1 - F.when(minus, after).otherwise(before), F.lit(0))
        b = F.least(hi + F.when(minus, before).otherwise(after), F.col("n_bases"))
        asked = t.select("key", "protein", F.col("seqid").alias("id"), "strand", a.alias("window_0b"), b.alias("window_0b_excl"), a.cast("long").alias("lo"), b.cast("long").alias("hi")).dropDuplicates(["key"])
        got = self.cut_out(asked, "dna")
        return got.select("protein", F.col("id").alias("seqid"), "strand", "window_0b", "window_0b_excl", F.when(F.col("strand") == "-", reverse_complement(F.col("dna"))).otherwise(F.col("dna")).alias("sequence"))


def leader_of(tail: Column) -> Column:
    """Upstream residues from the last M on, or all where there is no M."""
    return F.regexp_replace(tail, "^.*M", "M")
