"""Delimited tables with checked headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import last_wins

ARTIFACT_COLUMNS = ["protein accession", "genome accession", "sequence accession", "start label", "start aa 1b", "protein start aa 1b", "end aa 1b"]
#: Columns that older tables lack; they read as blank.
LATER_COLUMNS = ("protein start aa 1b", "end aa 1b")
HITS = (
    "detection_type string, detection_method string, batch string, query_accession string, query_database string, query_type string, target_accession string, target_database string, "
    "target_type string, query_start int, query_end int, target_start int, target_end int, evalue double, bitscore string, bitscore_threshold string"
)


def tsv(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """All columns as text; a missing required column or a repeated one is an error."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", nullValue=None, emptyValue="")
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def hits(spark: SparkSession, path: str, *where) -> DataFrame:
    """Hit table; every condition is applied at the scan.  A missing path gives no hits."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], HITS)
    df = spark.read.schema(HITS).csv(path, sep="\t", header=True, enforceSchema=False) if not path.endswith(".parquet") else spark.read.parquet(path)
    for w in where:
        df = df.where(w)
    return df


def taxonomy(df: DataFrame, order: str) -> DataFrame:
    """Genome and rank columns in snake case; the last row of a genome wins, rows without one go."""
    named = df.toDF(*(c if c == order else c.strip().lower().replace(" ", "_") for c in df.columns))
    key = next((c for c in ("genome_accession", "accession") if c in named.columns), None)
    if key is None:
        raise ValueError("no genome accession column")
    return last_wins(named.withColumnRenamed(key, "genome").where("genome IS NOT NULL AND genome <> ''"), ["genome"], order)


def artifacts(df: DataFrame) -> DataFrame:
    """Any of the three generations of the sequence table in today's columns."""
    base = [c for c in ARTIFACT_COLUMNS if c not in LATER_COLUMNS]
    if df.columns not in (base, [*base, "end aa 1b"], ARTIFACT_COLUMNS):
        raise ValueError(f"unknown columns: {df.columns}")
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in ARTIFACT_COLUMNS))


def deeploc(df: DataFrame) -> DataFrame:
    """id, localizations, signals (array), scores (map of the numeric columns), problem (duplicate)."""
    from pyspark.sql import Window

    names = [c.lstrip("﻿") for c in df.columns]
    df = df.toDF(*names)
    fixed = ["Protein_ID", "Localizations", "Signals"]
    if any(c not in names for c in fixed):
        raise ValueError("not a localization table")
    others = [c for c in names if c not in fixed]
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").try_cast("double").alias("v")) for c in others)), lambda x: x["v"].isNotNull()) if others else F.array().cast("array<struct<k:string,v:double>>")
    n = F.count(F.lit(1)).over(Window.partitionBy("Protein_ID"))
    signals = F.filter(F.split(F.coalesce("Signals", F.lit("")), r"\|"), lambda x: x != "")
    return df.select(F.col("Protein_ID").alias("id"), F.col("Localizations").alias("localizations"), signals.alias("signals"), F.map_from_entries(pairs).alias("scores"), F.when(n > 1, "duplicate").alias("problem"))


def resolve_ids(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the call whose id is theirs, theirs up to the pipe, or theirs with ``_`` for the pipe; two calls are a problem."""
    alias = F.array_distinct(F.array(F.col("accession"), F.split_part(F.col("accession"), F.lit("|"), F.lit(1)), F.replace(F.col("accession"), F.lit("|"), F.lit("_"))))
    j = candidates.select("accession", F.explode(alias).alias("id")).join(calls, "id")
    one = j.groupBy("accession").agg(F.countDistinct("id").alias("n"), F.min("id").alias("call_id"))
    return candidates.join(one, "accession", "left").withColumn("problem", F.when(F.col("n") > 1, "ambiguous"))


def records(rows: DataFrame) -> DataFrame:
    """Result lines: a bare locator, or locator, id, model, ipTM, pTM and maybe a seed; NA is null."""
    p = F.split("line", "\t", -1)
    cell = lambda i: F.nullif(F.get(p, i), F.lit("NA"))
    n = F.size(p)
    problem = F.when(~n.isin(1, 5, 6), "columns").when((n > 1) & cell(3).isNotNull() & cell(3).try_cast("double").isNull(), "ipTM")
    return rows.where(F.trim("line") != "").select("ord", F.get(p, 0).alias("fold_locator"), cell(1).alias("fold_id"), cell(2).alias("model_id"), cell(3).try_cast("double").alias("iptm"), cell(4).try_cast("double").alias("ptm"), cell(5).alias("seed"), problem.alias("problem"))


def confidence(rows: DataFrame) -> DataFrame:
    """iptm, ptm of JSON texts (columns model, json): finite in [0, 1] or null, else a problem of that model alone."""
    j = F.from_json("json", "iptm double, ptm double, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    ok = lambda c: c.isNull() | c.between(0.0, 1.0)
    got = rows.select("model", j.alias("j"))
    return got.select("model", "j.iptm", "j.ptm", F.when(F.col("j").isNull() | F.col("j._bad").isNotNull(), "json").when(~(ok(F.col("j.iptm")) & ok(F.col("j.ptm"))), "range").alias("problem"))


def names(rows: DataFrame) -> DataFrame:
    """A set of exact names; only line ends are removed."""
    return rows.where("line <> ''").select(F.col("line").alias("name")).distinct()


def protein_keys(rows: DataFrame) -> DataFrame:
    """(protein, genome) pairs in first-seen order, without repeats."""
    p = F.split("line", "\t", -1)
    return rows.where(F.size(p) == 2).groupBy(F.get(p, 0).alias("protein"), F.get(p, 1).alias("genome")).agg(F.min("ord").alias("ord"))


def profiles(spark: SparkSession, folders: list[str]) -> list[str]:
    """Paths of the ``.hmm`` files right inside each folder, by name; a folder that isn't there is an error."""
    out = []
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            raise ValueError(f"no such folder of profiles: {folder}")
        here = [s.getPath() for s in fs.listStatus(path) if s.isFile() and s.getPath().getName().endswith(".hmm")]
        out += [p.toUri().getPath() if p.toUri().getScheme() == "file" else p.toString() for p in sorted(here, key=lambda p: p.getName())]
    return out


def profiles_by_name(paths: list[str]) -> dict[str, str]:
    """File name -> path; one name for two paths is an error."""
    out: dict[str, str] = {}
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if out.setdefault(name, path) != path:
            raise ValueError(f"two profiles are named {name}: {out[name]} and {path}")
    return out
