"""Operator 3, mixing sources to target weights by pivotal dependent rounding (DataFrame and SQL functions only).

Every source gets a target number of words.  Each document of it is due ``target / source size`` copies: the whole part
is taken at once, the rest is a fractional copy whose mass is ``rest * size`` words.  Two documents meet, mass moves
between them at random (with the odds that keep both expectations) until one of them is whole or empty; that one is
settled and the other goes on.  Documents meet in chunks of about ``FAN_IN`` that are dealt by a hash of their ids, the
chunks' residuals meet ``FAN_IN`` at a time on the next level, and so on: a reduction tree per source whose every task
reads bounded groups, however large a source is.

The last residual of a source is often one of its largest documents, which small ones can't fill.  It is rounded to the
whole that serves better, and documents of the source's first ``POOL`` chunks (some 512, dealt by hash), largest first, change
between their two neighbouring whole numbers of copies wherever that brings the source nearer to its target.  So a
source misses its target by about half of a small document; the price is that these documents' expectations shift by
their share of one residual, which the rounding itself would have shifted as well.

Edge cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated doc_ids
are told apart by source, text and an ordinal, equal rows being interchangeable; all sizes zero gives targets of 0; an empty table gives
an empty result; very long texts are counted whole, and travel in ``mixed_documents`` only; columns of documents that have names of the
result's (size, source_size, target, taken) don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut

FAN_IN = 64
#: Chunks of the first level whose documents level out what the last residual leaves.
POOL = 8
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
_ITEM = "struct<order:bigint,rnd:bigint,doc_id:{id},th:bigint,ord:int,size:bigint,m:double>"
_ROW = ["doc_id", "source", "th"]


def _sizes(docs: DataFrame) -> DataFrame:
    """Narrow rows (doc_id, source, size, text hash, ordinal among equal rows)."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("th"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*_ROW).orderBy("size")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, n, source_size, target.  The windows run over one row per source, not per document."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = ranked.select("source", "n", "source_size", w.alias("w"), (cap * F.col("source_size")).alias("cap"))
    # Filling by weight until none is above its cap: everyone gets least(cap, level * w); the level is the first one,
    # by cap / w ascending, that its own source can hold.
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.asc_nulls_last("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    lev = caps.withColumn("at", F.row_number().over(by)).withColumn("total", share * F.sum("source_size").over(whole)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    )
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("at", "level"))).over(whole)["level"]
    return lev.withColumn("fill", first).select("source", "n", "source_size", F.least("cap", F.coalesce(F.col("fill") * F.col("w"), F.col("cap"))).alias("target"))


def _meet(items: str, seed: int) -> str:
    """SQL: fold the array of items pairwise; a struct of the settled items and of the residual."""
    step = f"""
      element_at(transform(array(named_struct('up', least(acc.c.size - acc.c.m, b.m), 'dn', least(b.size - b.m, acc.c.m),
          'u', pmod(xxhash64(acc.c.doc_id, acc.c.th, acc.c.ord, b.doc_id, b.th, b.ord, {seed}), 4503599627370496L) / 4503599627370496D)),
        t -> element_at(transform(array(IF(t.u * (t.up + t.dn) < t.dn,
            IF(acc.c.size - acc.c.m <= b.m, named_struct('a', cast(acc.c.size as double), 'b', b.m - (acc.c.size - acc.c.m)), named_struct('a', acc.c.m + b.m, 'b', 0D)),
            IF(b.size - b.m <= acc.c.m, named_struct('a', acc.c.m - (b.size - b.m), 'b', cast(b.size as double)), named_struct('a', 0D, 'b', acc.c.m + b.m)))),
          v -> element_at(transform(array(named_struct(
              'a', named_struct('order', acc.c.order, 'rnd', acc.c.rnd, 'doc_id', acc.c.doc_id, 'th', acc.c.th, 'ord', acc.c.ord, 'size', acc.c.size, 'm', v.a),
              'b', named_struct('order', b.order, 'rnd', b.rnd, 'doc_id', b.doc_id, 'th', b.th, 'ord', b.ord, 'size', b.size, 'm', v.b))),
            p -> IF(v.a = 0D OR v.a = acc.c.size, named_struct('c', p.b, 'out', concat(acc.out, array(p.a))), named_struct('c', p.a, 'out', concat(acc.out, array(p.b))))), 1)), 1)), 1)"""
    return f"aggregate(slice({items}, 2, greatest(size({items}) - 1, 0)), named_struct('c', {items}[0], 'out', slice({items}, 1, 0)), (acc, b) -> {step})"


def _levelled(items: str) -> str:
    """SQL: array of structs (item, up) of the items, largest first, changed wherever that brings the taken words nearer to the items' masses.

    Tried from several starts, the best of which counts, the earlier of equals: as they are, with the residual (the one
    item that is neither whole nor empty) taken or not, and with an eighth of the others turned over beforehand.
    """
    starts = ["IF(x.m >= x.size, 1, 0)", "IF(x.m > 0, 1, 0)", *(f"IF(x.m >= x.size, 1, 0) ^ IF(pmod(x.rnd, 8) = {k}, 1, 0)" for k in range(8))]
    ways = []
    for k, up in enumerate(starts):
        step = f"""element_at(transform(array(named_struct('up', {up}, 'by', IF(({up}) = 1, -x.size, x.size))),
              t -> IF(abs(acc.d + t.by) < abs(acc.d), named_struct('d', acc.d + t.by, 'out', concat(acc.out, array(1 - t.up))), named_struct('d', acc.d, 'out', concat(acc.out, array(t.up))))), 1)"""
        zero = f"named_struct('d', aggregate({items}, 0D, (d, x) -> d + ({up}) * x.size - x.m), 'out', cast(array() as array<int>))"
        ways.append(f"aggregate({items}, {zero}, (acc, x) -> {step}, acc -> named_struct('d', abs(acc.d), 'k', {k}, 'out', acc.out))")
    return f"zip_with({items}, array_min(array({', '.join(ways)})).out, (x, u) -> named_struct('item', x, 'up', u))"


def take_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, fan_in: int = FAN_IN, seed: int = 3) -> DataFrame:
    """doc_id, th, ord, source, size, source_size, target, copies: a row for every row of docs."""
    sizes = cut(_sizes(docs))  # texts are read once; everything below works on narrow rows
    targets = cut(source_targets(sizes, weights, share, cap))
    most = targets.agg(F.max("n")).first()[0] or 0
    # One row per source meets the documents; the optimizer broadcasts it where it is small and splits hot sources else.
    t = targets.withColumnRenamed("source", "source__t")
    due = sizes.join(t, F.col("source").eqNullSafe(F.col("source__t")), "inner").drop("source__t")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = due.withColumn("base", F.floor(ratio)).withColumn("m", (ratio - F.floor(ratio)) * F.col("size"))
    fractional = (F.col("m") > 0) & (F.col("m") < F.col("size"))
    whole = due.where(~fractional).withColumn("up", F.lit(0))
    kind = dict(sizes.dtypes)["doc_id"]
    item = F.struct(
        (-F.col("size")).alias("order"), F.xxhash64("doc_id", "th", "ord", F.lit(seed)).alias("rnd"), "doc_id", "th", F.col("ord").cast("int").alias("ord"), F.col("size").cast("long").alias("size"), F.col("m").cast("double").alias("m")
    ).cast(_ITEM.format(id=kind))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in)).cast("long")
    part = due.where(fractional).select("source", "source_size", "target", "base", F.pmod(F.xxhash64("doc_id", "th", "ord", F.lit(seed + 1)), chunks).alias("chunk"), item.alias("item"))
    keys = ["source", "source_size", "target", "base"]
    settled, count = [], max(1, -(-most // fan_in))
    while True:
        met = part.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("item")).alias("items")).select(*keys, "chunk", F.expr(_meet("items", seed)).alias("r"))
        met = cut(met)
        pooled = F.col("chunk") < (POOL if len(settled) == 0 else 0)
        settled.append(met.select(*keys, pooled.alias("pooled"), F.explode("r.out").alias("item")))
        if count == 1:
            settled.append(met.select(*keys, F.lit(True).alias("pooled"), F.col("r.c").alias("item")))
            break
        part = met.select(*keys, F.floor(F.col("chunk") / fan_in).alias("chunk"), F.col("r.c").alias("item"))
        count = -(-count // fan_in)
    tree = settled[0]
    for s in settled[1:]:
        tree = tree.unionByName(s)
    alone = tree.where("NOT pooled").select(*keys, "item", (F.col("item.m") > 0).cast("int").alias("up"))  # whole or empty
    pool = tree.where("pooled").groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items"))  # POOL chunks and a residual
    level = pool.select(*keys, F.explode(F.expr(_levelled("items"))).alias("l")).select(*keys, "l.item", "l.up")
    tree = alone.unionByName(level).select(*keys, *(F.col(f"item.{c}").alias(c) for c in ("doc_id", "th", "ord", "size")), "up")
    names = ["doc_id", "th", "ord", "source", "size", "source_size", "target", "base", "up"]
    both = whole.select(*names).unionByName(tree.select(*names))
    return both.select("doc_id", "th", "ord", "source", "size", "source_size", "target", (F.col("base") + F.col("up")).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    return take_copies(docs, **options).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it, with the columns of docs and copy_no from 1."""
    copies = take_copies(docs, **options).where("copies > 0").select(*(F.col(c).alias(f"{c}__m") for c in (*_ROW, "ord")), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("copies__m"))
    rows = docs.withColumn("th__d", F.xxhash64("text")).withColumn("ord__d", F.row_number().over(Window.partitionBy("doc_id", "source", "th__d").orderBy("doc_id")))
    same = [F.col("doc_id").eqNullSafe(F.col("doc_id__m")), F.col("th__d") == F.col("th__m"), F.col("source").eqNullSafe(F.col("source__m")), F.col("ord__d") == F.col("ord__m")]
    return rows.join(copies, same, "inner").select(*docs.columns, F.explode("copies__m").alias("copy_no"))
