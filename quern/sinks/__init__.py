"""Writers: FASTA, single-file TSV by rename, appends with a checked header."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_lines(df: DataFrame, header: Column, sequence: Column, width: int = 60) -> DataFrame:
    """value: header and sequence lines of each record."""
    wrapped = F.regexp_replace(sequence, f"(.{{{width}}})(?!$)", "$1\n")
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), wrapped).alias("value"))


def match_fasta(matches: DataFrame, sequences: DataFrame, target: str, *, match_only: bool) -> DataFrame:
    """Whole sequences or the matched parts of matches (query_accession, query_start, query_end); absent proteins are left out."""
    j = matches.join(sequences.select(F.col("id").alias("query_accession"), "sequence"), "query_accession")
    if not match_only:
        return fasta_lines(j.select("query_accession", "sequence").distinct(), F.col("query_accession"), F.col("sequence"))
    a, b = F.least("query_start", "query_end"), F.greatest("query_start", "query_end")
    name = F.concat_ws("_", "query_accession", F.lit(target), "query_start", "query_end")
    return fasta_lines(j, name, F.substring("sequence", a, b - a + 1))


def write_tsv(df: DataFrame, path: str, null: str = "") -> None:
    """One file that appears whole: written to a neighbouring folder first, then renamed."""
    _one_file(df, path, lambda w, part: w.csv(part, sep="\t", header=True, nullValue=null, emptyValue="", quote=""))


def write_lines(df: DataFrame, path: str) -> None:
    """The column value of a sorted table as one text file."""
    _one_file(df, path, lambda w, part: w.text(part))


def _one_file(df: DataFrame, path: str, write) -> None:
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    write(df.coalesce(1).write, part.toString())
    written = next(s.getPath() for s in fs.listStatus(part) if s.getPath().getName().startswith("part-"))
    # One rename that replaces: a reader sees the old table or the new one, and a failed rename raises.
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = fs.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(written), qualified, options)
    fs.delete(part, True)


def append(df: DataFrame, path: str) -> None:
    """Append Parquet rows; the columns must be the table's."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        there = spark.read.parquet(path).columns
        if there != df.columns:
            raise ValueError(f"the table has columns {there}")
    df.write.mode("append").parquet(path)


def append_tsv(df: DataFrame, path: str) -> None:
    """Append rows to a folder of tab-separated files that all begin with the header; the columns must be the table's, in its order."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        there = spark.read.csv(path, sep="\t", header=True).columns
        if there != df.columns:
            raise ValueError(f"the table has columns {there}")
    df.write.mode("append").csv(path, sep="\t", header=True)


def tall(df: DataFrame, sides: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """A row per side (1, 2) of two-sided rows: sides maps an output column to its columns on either side."""
    rows = F.array(*(F.struct(F.lit(i + 1).alias("side"), *(F.col(c[i]).alias(n) for n, c in sides.items())) for i in range(2)))
    return df.select(*keep, F.explode(rows).alias("s")).select(*keep, "s.*")


def printed(x: Column, kind: str) -> Column:
    """Cells as text: floats with six places, booleans in lower case, null as NA."""
    text = F.format_string("%.6f", x) if kind == "double" else F.lower(x.cast("string")) if kind == "boolean" else x.cast("string")
    return F.coalesce(F.when(x.isNotNull(), text), F.lit("NA"))


def six_digits(x: Column) -> Column:
    """Six significant digits without trailing zeros, exponents outside 1e-4 .. 1e6; null and NaN are blank."""
    e = F.format_string("%.5e", x)
    power = F.element_at(F.split(e, "e"), 2).cast("int")
    bare = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    fixed = bare(e.cast("decimal(38,12)").cast("string"))
    other = F.concat_ws("e", bare(F.element_at(F.split(e, "e"), 1)), F.element_at(F.split(e, "e"), 2))
    return F.when(x.isNull() | F.isnan(x), "").when(power.between(-4, 5), fixed).otherwise(other)


def threshold_report(sweep: DataFrame, best: DataFrame, entries: DataFrame, searched: DataFrame) -> DataFrame:
    """Lines (value, in order) of a threshold table, its best row's errors and the search output it rests on.

    sweep and best are those of threshold_sweep and best_threshold; entries: id, positive, score, ord; searched: ord, line.
    """
    names = ("threshold", "tp", "fp", "tn", "fn", "sensitivity", "specificity", "balanced")
    head = "\t".join(("threshold bitscore", *names[1:-1], "balanced accuracy", "selected"))
    spark = sweep.sparkSession
    chosen = F.broadcast(best.select(F.col("threshold").alias("cut")))  # one row or none
    title = lambda block, text: spark.range(1).select(F.lit(block).alias("block"), F.lit(0.0).alias("at"), F.lit(text).alias("value"))
    rows = sweep.join(chosen, F.col("threshold") == F.col("cut"), "left")
    cells = [six_digits(F.col(c)) if t == "double" else F.col(c).cast("string") for c, t in ((c, dict(sweep.dtypes)[c]) for c in names)]
    table = rows.select(F.lit(1).alias("block"), (-F.col("threshold")).alias("at"), F.concat_ws("\t", *cells, F.when(F.col("cut").isNotNull(), "true").otherwise("")).alias("value"))
    e = entries.crossJoin(chosen)
    line = F.concat(F.lit("# "), F.col("id"), F.lit(" "), six_digits(F.col("score")))
    wrong = lambda block, test: e.where(test).select(F.lit(block).alias("block"), F.col("ord").cast("double").alias("at"), line.alias("value"))
    named = lambda block, text: chosen.select(F.lit(block).alias("block"), F.lit(0.0).alias("at"), text.alias("value"))
    parts = [
        title(0, head), table, named(2, F.concat(F.lit("# selected threshold bitscore "), six_digits(F.col("cut")))), named(3, F.lit("# false positives")), wrong(4, "NOT positive AND score >= cut"),
        named(5, F.lit("# false negatives")), wrong(6, "positive AND score < cut"), title(7, "# hmmsearch domtblout"),
        searched.select(F.lit(8).alias("block"), F.col("ord").cast("double").alias("at"), F.concat(F.lit("# "), F.col("line")).alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("block", "at").select("value")
