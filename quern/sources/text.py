"""Line-based formats: FASTA in its variants, HMMER tables, GFF3, tool outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import duplicates, first_wins

CANONICAL = "ACDEFGHIKLMNPQRSTVWY"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, line.  Files are split like any other; ord grows along a file: the split's first byte plus the row's place in it.

    A split with another one behind it fills its task's input, so its rows are counted from 0 and stay below the next
    split's first byte.
    """
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("ord"), F.col("value").alias("line"))


def lines_or_none(spark: SparkSession, path: str) -> DataFrame:
    """As lines; a missing path has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return lines(spark, path)
    return spark.createDataFrame([], "file string, ord long, line string")


#: Consecutive values of ord that are counted together.
SPAN = 1 << 16


def running(rows: DataFrame, value: Column, name: str, by: tuple[str, ...] = ("file",), span: int = SPAN) -> DataFrame:
    """rows with the sum of value over all rows of their file up to their own, by ord.

    Rows are summed up in spans of ord first; what is ordered over a whole file are the spans' sums, and a span's rows among themselves.
    """
    t = rows.withColumn("span__", F.floor(F.col("ord") / span)).withColumn("value__", value)
    sums = t.groupBy(*by, "span__").agg(F.sum("value__").alias("all__"))
    spans = Window.partitionBy(*by).orderBy("span__").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    before = sums.select(*(F.col(c).alias(f"{c}__") for c in by), F.col("span__").alias("of__"), F.coalesce(F.sum("all__").over(spans), F.lit(0)).alias("before__"))
    inner = Window.partitionBy(*by, "span__").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = t.withColumn("own__", F.sum("value__").over(inner))
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by]
    met = own.join(before, reduce(lambda x, y: x & y, [*same, F.col("span__") == F.col("of__")]))
    return met.select(*rows.columns, (F.col("before__") + F.col("own__")).alias(name))


def record_lines(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """file, ord, text (trimmed, blank lines gone), opens (a FASTA header), record (from 1; 0 before the first header) and run, the
    letters of the file's sequences up to and including the line."""
    t = rows.select("file", "ord", F.trim("line").alias("text"), F.col("line").startswith(">").alias("opens")).where("text <> ''")
    counted = running(t, F.col("opens").cast("long"), "record", span=span)
    return running(counted, F.when(F.col("opens") | (F.col("record") == 0), 0).otherwise(F.length("text")).cast("long"), "run", span=span)


def fasta(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """file, ord, header, id (first token), description, sequence; lines before the first header are ignored.

    A record is one row in the end: for contigs see ``operators.contigs``, whose rows are chunks.
    """
    opens = F.col("line").startswith(">")
    numbered = running(rows.select("file", "ord", "line").where(F.trim("line") != ""), opens.cast("long"), "record", span=span).where("record > 0")
    head = F.max(F.when(opens, F.expr("substring(line, 2)")))
    body = F.array_sort(F.collect_list(F.when(~opens, F.struct("ord", F.trim("line").alias("s")))))
    rec = numbered.groupBy("file", "record").agg(head.alias("header"), F.array_join(F.transform(body, lambda x: x["s"]), "").alias("sequence"))
    parts = F.split(F.trim("header"), r"\s+", 2)
    return rec.select("file", (F.col("record") - 1).alias("ord"), F.trim("header").alias("header"), F.coalesce(F.get(parts, 0), F.lit("")).alias("id"), F.coalesce(F.get(parts, 1), F.lit("")).alias("description"), "sequence")


def strict_proteins(records: DataFrame) -> DataFrame:
    """id, sequence (upper case) and problem: empty, letters or duplicate; an invalid record still takes its id."""
    up = records.withColumn("sequence", F.upper("sequence"))
    nth = F.row_number().over(Window.partitionBy("file", "id").orderBy("ord"))
    problem = F.when(nth > 1, "duplicate").when(F.col("sequence") == "", "empty").when(F.translate("sequence", CANONICAL, "") != "", "letters")
    return up.withColumn("problem", problem)


def first_of_each_id(records: DataFrame) -> DataFrame:
    return first_wins(records, ["id"], "ord")


def nucleotides(records: DataFrame) -> DataFrame:
    """First of each id, U read as T, with problem = letters outside the IUPAC alphabet."""
    up = first_of_each_id(records).withColumn("sequence", F.translate(F.upper("sequence"), "U", "T"))
    return up.withColumn("problem", F.when(F.translate("sequence", "ACGTRYSWKMBDHVN", "") != "", "letters"))


def described(records: DataFrame) -> DataFrame:
    """Ids must be ``accession|description`` with one pipe and no white space, unique over all files."""
    bad = ~F.col("header").rlike(r"^[^|\s]+\|[^|\s]+$")
    n = F.count(F.lit(1)).over(Window.partitionBy("header"))
    return records.withColumn("problem", F.when(bad, "id").when(n > 1, "duplicate"))


def candidate_problems(records: DataFrame) -> DataFrame:
    """Headers or sequences that occur more than once, all of them."""
    up = records.select("header", F.upper("sequence").alias("sequence"))
    return duplicates(up, ["header"], "header").select(F.col("header").alias("value"), "n", "problem").unionByName(duplicates(up, ["sequence"], "sequence").select(F.col("sequence").alias("value"), "n", "problem"))


def clusters(records: DataFrame) -> DataFrame:
    """cluster (representative), member, sequence of an all-sequences cluster file: a record without sequence opens a
    cluster named by it; ``is_member`` tells whether the representative is among its members."""
    opened = records.withColumn("opens", F.col("sequence") == "")
    numbered = running(opened, F.col("opens").cast("long"), "c")
    heads = numbered.where("opens").select("file", "c", F.col("id").alias("cluster"))
    members = numbered.where("NOT opens").select("file", "c", "ord", F.col("id").alias("member"), "sequence").join(heads, ["file", "c"])
    there = F.max((F.col("member") == F.col("cluster")).cast("int")).over(Window.partitionBy("file", "c"))
    return members.withColumn("is_member", there == 1).select("file", "ord", "cluster", "member", "sequence", "is_member")


def domtblout(rows: DataFrame) -> DataFrame:
    """HMMER domain table: the accession falls back to the model's name; short and comment lines go."""
    p = F.split(F.trim("line"), r"\s+", 23)
    good = rows.where(~F.col("line").startswith("#") & (F.size(p) >= 22)).select("file", "ord", p.alias("p"))
    text = lambda i, name: F.get("p", i).alias(name)
    number = lambda i, kind, name: F.get("p", i).try_cast(kind).alias(name)
    return good.select(
        "file", "ord", text(0, "sequence"), text(3, "model"), F.when(F.get("p", 4) == "-", F.get("p", 3)).otherwise(F.get("p", 4)).alias("accession"), number(5, "int", "model_length"),
        number(6, "double", "full_evalue"), number(7, "double", "full_score"), number(12, "double", "domain_evalue"), number(13, "double", "domain_score"),
        number(15, "int", "hmm_from"), number(16, "int", "hmm_to"), number(17, "int", "seq_from"), number(18, "int", "seq_to"),
    )


def as_tsv(rows: DataFrame) -> DataFrame:
    """White space to tabs, up to the line that begins the program's footer."""
    footer = rows.where(F.col("line").rlike(r"^#?\s*Program")).groupBy("file").agg(F.min("ord").alias("end"))
    kept = rows.join(footer, "file", "left").where(F.col("end").isNull() | (F.col("ord") < F.col("end"))).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    return kept.select("file", "ord", F.regexp_replace(F.trim("line"), r"\s+", "\t").alias("line"))


def score_thresholds(rows: DataFrame) -> DataFrame:
    """model, threshold, score_type (domain or full); the header goes, the last line of a model wins."""
    p = F.split(F.trim("line"), r"\s+")
    got = rows.where((F.size(p) >= 3) & (F.get(p, 0) != "model")).select("ord", F.get(p, 0).alias("model"), F.get(p, 1).try_cast("double").alias("threshold"), F.get(p, 2).alias("score_type"))
    return got.groupBy("model").agg(F.max(F.struct("ord", "threshold", "score_type")).alias("r")).select("model", "r.threshold", "r.score_type")


def above_threshold(hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Domain hits that reach their model's threshold by its score type; a model without one is a problem, not a hit."""
    score = F.when(F.col("score_type") == "domain", F.col("domain_score")).otherwise(F.col("full_score"))
    j = hits.join(F.broadcast(thresholds) if thresholds.isLocal() else thresholds, "model", "left")
    return j.withColumn("problem", F.when(F.col("threshold").isNull(), "no threshold")).where(F.col("threshold").isNull() | (score >= F.col("threshold")))


def gff(rows: DataFrame) -> DataFrame:
    """seqid, type, start, end, strand, attrs (map; ``k=v`` or ``k "v"``, the last of a key wins)."""
    p = F.split("line", "\t")
    good = rows.where(~F.col("line").startswith("#") & (F.size(p) == 9)).select("file", "ord", p.alias("p"))
    fields = F.filter(F.transform(F.split(F.get("p", 8), ";"), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.when(x.contains("="), F.split_part(x, F.lit("="), F.lit(1))).otherwise(F.regexp_extract(x, r"^(\S+)", 1))
    value = lambda x: F.when(x.contains("="), F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).otherwise(F.regexp_extract(x, r'^\S+\s+"?([^"]*)"?', 1))
    pairs = F.transform(fields, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    last = F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda b: b["k"] == a["k"]))
    return good.select("file", "ord", F.get("p", 0).alias("seqid"), F.get("p", 2).alias("type"), F.get("p", 3).try_cast("int").alias("start"), F.get("p", 4).try_cast("int").alias("end"), F.get("p", 6).alias("strand"), F.map_from_entries(last).alias("attrs"))


def values_of(attrs: Column, key: str) -> Column:
    """A multi-valued attribute."""
    return F.split(F.coalesce(F.try_element_at(attrs, F.lit(key)), F.lit("")), ",")


def targetp(rows: DataFrame) -> DataFrame:
    """id, call, p_noTP, p_SP, p_mTP of the short output."""
    p = F.split(F.trim("line"), r"\s+")
    good = rows.where(~F.col("line").startswith("#") & (F.size(p) >= 5))
    return good.select(F.get(p, 0).alias("id"), F.get(p, 1).alias("call"), *(F.get(p, i).try_cast("double").alias(n) for i, n in ((2, "p_noTP"), (3, "p_SP"), (4, "p_mTP"))))


def motif_scan(rows: DataFrame) -> DataFrame:
    """sequence, start, end, motif, score, strand of a scan's output; comments and the header go."""
    p = F.split(F.trim("line"), r"\s+")
    good = rows.where(~F.col("line").startswith("#") & (F.size(p) >= 6) & (F.get(p, 0) != "sequence"))
    return good.select(F.get(p, 0).alias("sequence"), F.get(p, 1).try_cast("int").alias("start"), F.get(p, 2).try_cast("int").alias("end"), F.get(p, 3).alias("motif"), F.get(p, 4).try_cast("double").alias("score"), F.get(p, 5).alias("strand")).where("start IS NOT NULL")


def topology(rows: DataFrame) -> DataFrame:
    """Three-line records: id, sequence, labels, problem (lengths differ or a label outside I, M, O, P, S, B)."""
    kept = rows.where(F.trim("line") != "")
    t = running(kept, F.lit(1).cast("long"), "nth").withColumn("n", F.col("nth") - 1).withColumn("rec", F.floor(F.col("n") / 3)).withColumn("k", F.col("n") % 3)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.trim("line")))
    rec = t.groupBy("file", "rec").agg(pick(0).alias("header"), pick(1).alias("sequence"), pick(2).alias("labels"))
    problem = F.when(F.coalesce(F.length("sequence") != F.length("labels"), F.lit(True)), "length").when(~F.col("labels").rlike("^[IMOPSB]*$"), "labels")
    return rec.select("file", F.col("rec").alias("ord"), F.regexp_extract("header", r"^>?\s*(\S+)", 1).alias("id"), "sequence", "labels", problem.alias("problem"))


def scorefile(rows: DataFrame) -> DataFrame:
    """name, value of an energy score file: a header and one data line, both beginning with SCORE:."""
    p = F.split(F.trim("line"), r"\s+")
    w = Window.partitionBy("file").orderBy("ord")
    s = rows.where(F.col("line").startswith("SCORE:")).select("file", p.alias("p"), F.row_number().over(w).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("file")).alias("n"))
    head, data = s.where("nth = 1").select("file", F.col("p").alias("h")), s.where("nth = 2").select("file", F.col("p").alias("d"), "n")
    each = head.join(data, "file").select("file", "n", F.explode(F.arrays_zip("h", "d")).alias("x"))
    v = F.col("x.d").try_cast("double")
    return each.where(F.col("x.h") != "SCORE:").select("file", F.col("x.h").alias("name"), v.alias("value"), F.when(F.col("n") != 2, "rows").when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "value").alias("problem"))


def alignment_map(rows: DataFrame) -> DataFrame:
    """Stockholm lines to sequence -> map(profile position -> struct<pos, aa>, null for a gap).

    RF dots and dashes are inserts; without RF every column is a match.  Residues keep their case.
    """
    clean = rows.where(~F.col("line").rlike(r"^(#(?!=GC RF)|//|\s*$)"))
    rf = clean.where(F.col("line").startswith("#=GC RF")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.regexp_extract("line", r"^#=GC RF\s+(\S+)", 1).alias("s")))), lambda x: x["s"]), "").alias("rf"))
    p = F.split(F.trim("line"), r"\s+", 2)
    seqs = clean.where(~F.col("line").startswith("#")).groupBy("file", F.get(p, 0).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.get(p, 1).alias("s")))), lambda x: x["s"]), "").alias("text"))
    cols = seqs.join(rf, "file", "left").select("file", "id", F.posexplode(F.split("text", "")).alias("i", "c"), "rf").where("c <> ''")
    match = F.when(F.col("rf").isNull(), True).otherwise(~F.expr("substring(rf, i + 1, 1)").isin(".", "-"))
    gap = F.col("c").isin(".", "-")
    w = Window.partitionBy("file", "id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = cols.withColumn("m", match).withColumn("hmm", F.sum(F.col("m").cast("int")).over(w)).withColumn("pos", F.sum((~gap).cast("int")).over(w)).where("m")
    cell = F.when(gap, F.lit(None)).otherwise(F.struct(F.col("pos").cast("int").alias("pos"), F.col("c").alias("aa")))
    return placed.groupBy("file", "id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("hmm").cast("int").alias("k"), cell.alias("v")))).alias("hmm"))
