"""Operator 10, document fingerprints: bottom-k sketches of word-shingle hashes (DataFrame and SQL functions only).

A sketch is the sorted array of the K smallest distinct 64-bit hashes of a text's shingles of five words (a shorter text
is one shingle, a text without words none).  Sketches of parts merge by union, sort and cut.  Of two sketches the K
smallest of the union that are in both estimate resemblance; the K-th smallest hash gives the distinct shingle count.

``neighbours`` lays each document beside the next one by descending doc_id without a global window over texts: ids are
range-partitioned as narrow rows, looked at within a part, and the parts' first ids bridge the gaps.

Edge cases: a null text is empty; two empty sketches are alike (1), an empty and a filled one aren't (0); repeated rows
of a doc_id share the next document, which is the repeated row with the smallest length and text hash; a null doc_id
comes last in descending order; a single document is its own next; equal texts have equal sketches,
whatever their ids; very long texts are sketched whole; an empty table gives no rows; columns besides doc_id and text don't matter, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

K, WIDTH = 128, 5
_SPACES = r"[\x20\x09-\x0D]+"


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """array<long>: the k smallest distinct shingle hashes, ascending."""
    hashes = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    one = F.array(hashes)  # bound once: the lambda's variable keeps the words' hashes from being computed for each shingle

    def shingles(h):
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(h[i + j] for j in range(width))))
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= width, each).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(F.transform(one, shingles)[0])), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets, exact while the union has at most k hashes."""
    both = merge(a, b, k)
    alike = F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both)
    return F.when(F.size(both) == 0, 1.0).otherwise(alike).cast("double")


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / F.greatest(reach, F.lit(1e-300)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def hexed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merged_sketches(docs: DataFrame, *by: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """A sketch for each group of documents from its documents' sketches: hashes are distinct before they are ranked."""
    each = docs.select(*by, F.explode(sketch(F.col("text"), k, width)).alias("h")).distinct()
    # A group's k smallest by partial top-k in salted parts, so that a hot group is cut before it meets in one place.
    parts = each.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(64)))
    near = parts.withColumn("r", F.row_number().over(Window.partitionBy(*by, "part").orderBy("h"))).where(F.col("r") <= k)
    return near.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("sketch"))


def neighbours(ids: DataFrame) -> DataFrame:
    """prev, doc_id, need: the document doc_id follows prev by descending id, the largest follows the smallest.

    ids has a distinct, non-null doc_id and need; need is prev's.
    """
    parts = cut(ids.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    near = parts.withColumn("next", F.lead("doc_id").over(inside))
    # One row for each part: the window over it is as large as the number of partitions.
    ends = parts.groupBy("part").agg(F.max("doc_id").alias("first"))
    order = Window.orderBy("part")
    ends = ends.withColumn("after", F.lead("first").over(order)).withColumn("head", F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    joined = near.join(F.broadcast(ends.select("part", "after", "head")), "part")
    return joined.select(F.col("doc_id").alias("prev"), F.coalesce("next", "after", "head").alias("doc_id"), "need")


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, next_contains.

    The edited text replaces the last third (rounded down) by as many first code points of the next document.
    """
    # A null id comes last in descending order: it takes the place below the smallest long for ordering only.
    lowest = F.lit("-9223372036854775809").cast("decimal(20,0)")
    key = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), lowest)
    # Only key, text and sketch travel, on both sides of the join below, so that one exchange serves both.
    base = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), sketch(F.col("text"), k, width).alias("sk"))
    ids = docs.select(key.alias("doc_id"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 3).cast("int").alias("need")).groupBy("doc_id").agg(F.max("need").alias("need"))
    ring = neighbours(ids).select("prev", F.col("doc_id").alias("n_key"), "need")
    heads = base.join(ring, F.col("key") == F.col("n_key")).select("prev", F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"), F.substring("text", F.lit(1), F.col("need")).alias("head"), "sk").alias("x"))
    nexts = heads.groupBy("prev").agg(F.min("x").alias("x")).select("prev", "x.head", F.col("x.sk").alias("next_sk"))
    met = base.join(nexts, F.col("key") == F.col("prev"))
    n = F.length("text")
    cut_ = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut_), F.substring("head", F.lit(1), cut_))
    doc_id = F.when(F.col("key") != lowest, F.col("key").cast(dict(docs.dtypes)["doc_id"])).alias("doc_id")
    out = met.select(doc_id, n.cast("long").alias("n_chars"), "sk", "next_sk", edited.alias("edited"))
    out = out.select("*", sketch(F.col("edited"), k, width).alias("ed_sk"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), hexed(F.col("sk")).alias("fingerprint"), hexed(F.col("ed_sk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("ed_sk"), k).alias("near_edited"), resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
        distinct_count(F.col("sk"), k).alias("n_shingles"), containment(F.col("sk"), F.col("next_sk"), k).alias("next_contains"),
    )
