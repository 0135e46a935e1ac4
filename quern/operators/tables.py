"""Table operators: first-wins dedupe, checked lookups, sweeps, islands, sessions, prefix joins and idempotent merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accessions import parse_region


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("nth__", n).where("nth__ = 1").drop("nth__")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("nth__", n).where("nth__ = 1").drop("nth__")


def duplicates(df: DataFrame, keys: list[str], problem: str) -> DataFrame:
    """Keys that occur more than once, with a problem name; errors are collected, not raised."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, "n", F.lit(problem).alias("problem"))


def shortest_wins(candidates: DataFrame) -> DataFrame:
    """One candidate per sequence: shortest accession, then order; equal-accession copies of the winner all survive."""
    by = Window.partitionBy("sequence").orderBy(F.length("accession"), "ord")
    best = F.first("accession").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return candidates.withColumn("best__", best).where("accession = best__").drop("best__")


def union_last_value_first_place(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Union by key: the last value wins and takes the first one's place."""
    rows = a.withColumn("part__", F.lit(0)).unionByName(b.withColumn("part__", F.lit(1)))
    others = [c for c in rows.columns if c not in (key, order, "part__")]
    at, value = F.min(F.struct("part__", order)).alias("at__"), F.max(F.struct("part__", order, *others)).alias("v__")
    return rows.groupBy(key).agg(at, value).select(key, F.col("at__.part__").alias("part"), F.col(f"at__.{order}").alias(order), *(F.col(f"v__.{c}").alias(c) for c in others))


def exactly_one(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Each key with its row count in the table and a status: ok, missing or ambiguous."""
    n = table.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    out = keys.join(n, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "ok").otherwise("ambiguous"))


def agreement(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer check of two tables: left_only, right_only, or the first column that differs."""
    x = a.select(F.col(key).alias("ka"), *(F.col(c).alias(f"a_{c}") for c in columns))
    y = b.select(F.col(key).alias("kb"), *(F.col(c).alias(f"b_{c}") for c in columns))
    status = F.when(F.col("kb").isNull(), "left_only").when(F.col("ka").isNull(), "right_only")
    for c in columns:
        status = status.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"differs: {c}")
    return x.join(y, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias(key), status.otherwise("ok").alias("status"))


def constant_groups(df: DataFrame, group: str, base: list[str], unique: str) -> DataFrame:
    """Per group: rows, and whether base columns are constant and ``unique`` doesn't repeat."""
    constant = reduce(lambda p, c: p & F.min(c).eqNullSafe(F.max(c)), base, F.lit(True))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), constant.alias("constant"), (F.count(unique) == F.countDistinct(unique)).alias("unique"))


def scored(entries: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """Entries with the score of their best hit, 0.0 where there is none."""
    return entries.join(best, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def attached(rows: DataFrame, values: DataFrame, key: str, column: str, blank: str = "") -> DataFrame:
    """Rows with the largest value of their key as text, blank where there is none."""
    best = values.groupBy(key).agg(F.max(column).cast("string").alias(column))
    return rows.join(best, key, "left").withColumn(column, F.coalesce(column, F.lit(blank)))


def concatenated(*parts: DataFrame, order: str) -> DataFrame:
    """The parts one behind the other: column part (from 0) and each part's own order tell a row's place."""
    return reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts))).orderBy("part", order)


def first_offenders(problems: DataFrame, group: list[str], key: str, most: int = 5) -> DataFrame:
    """Of each group the first ids that have a problem, for a message, and how many there are."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(key))
    few = problems.withColumn("nth__", nth).groupBy(*group).agg(F.array_sort(F.collect_list(F.when(F.col("nth__") <= most, F.col(key)))).alias("first_ids"), F.count(F.lit(1)).alias("n_ids"))
    return few  # collect_list leaves the nulls of the others out


def threshold_sweep(entries: DataFrame) -> DataFrame:
    """threshold, tp, fp, fn, tn, sensitivity, specificity, balanced for each distinct score (predicted positive: >= it).

    Grouping by score comes first; the running sums go over the distinct scores of a part, and the sums of the parts
    above are added, so that no window spans the table.  A zero denominator gives null.
    """
    g = entries.groupBy(F.col("score").alias("threshold")).agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    # A stated number of parts is kept as it is, so both readers of the exchange see the same ones.
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = g.repartitionByRange(parts, "threshold").withColumn("part__", F.spark_partition_id())
    per = g.groupBy("part__").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))  # a row for each part
    above, whole = Window.orderBy(F.desc("part__")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = per.select("part__", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in "pn"), *(F.sum(c).over(whole).alias(f"{c}s") for c in "pn"))
    down = Window.partitionBy("part__").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    t = g.join(F.broadcast(sums), "part__").select("threshold", (F.col("p0") + F.sum("p").over(down)).alias("tp"), (F.col("n0") + F.sum("n").over(down)).alias("fp"), "ps", "ns")
    t = t.select("threshold", "tp", "fp", (F.col("ps") - F.col("tp")).alias("fn"), (F.col("ns") - F.col("fp")).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    t = t.withColumn("sensitivity", share("tp", "fn")).withColumn("specificity", share("tn", "fp"))
    return t.withColumn("balanced", (F.col("sensitivity") + F.col("specificity")) / 2)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row that is largest by balanced accuracy, specificity, sensitivity, threshold; rows without a value don't compete."""
    key = F.struct("balanced", "specificity", "sensitivity", "threshold")
    best = sweep.where("balanced IS NOT NULL").agg(F.max_by(F.struct(*sweep.columns), key).alias("r"))
    return best.where("r IS NOT NULL").select("r.*")


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Maximal runs of consecutive positions: keys, first, last, n."""
    d = df.select(*keys, position).distinct()
    group = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return d.withColumn("g__", group).groupBy(*keys, "g__").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("g__")


def runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Maximal runs of equal labels in order: keys, run (from 1), label, n, first and last place (1-based)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    d = df.select(*keys, *order, label).withColumn("i__", F.row_number().over(w)).withColumn("new__", F.when(F.col("i__") == 1, 1).otherwise(new))
    d = d.withColumn("run", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run").agg(F.first(label).alias(label), F.count(F.lit(1)).alias("n"), F.min("i__").alias("first"), F.max("i__").alias("last"))


def sessions(df: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """Number the groups that rows satisfying ``opens`` begin; rows before the first are in group 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session", F.sum(opens.cast("int")).over(w))


def prefix_semi_join(ids: DataFrame, wanted: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key is a prefix of any wanted id: all prefixes are spelled out, so the join stays an equi-join."""
    n = F.length(other)
    every = wanted.where(n > 0).select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(other), F.lit(1), i))).alias("prefix__")).distinct()
    return ids.join(every, F.col(key) == F.col("prefix__"), "left_semi")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop the old rows of every key that the new rows have, then append those."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], upgradable: list[str] = ()) -> DataFrame:
    """Idempotent merge: keys, values and status (kept, same, added, upgraded, conflict).

    Equal values are a no-op; a blank old value of an upgradable column may be filled; anything else is a conflict, which
    keeps the old value, for the caller to refuse.
    """
    k = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
    j = old.select(*keys, *values, F.lit(True).alias("is_old")).alias("o").join(new.select(*keys, *values, F.lit(True).alias("is_new")).alias("n"), reduce(lambda a, b: a & b, k), "full_outer")
    same, allowed, blank = F.lit(True), F.lit(True), lambda c: F.coalesce(F.col(f"o.{c}"), F.lit("")) == ""
    for c in values:
        equal = F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        same &= equal
        allowed &= equal | blank(c) if c in upgradable else equal
    status = F.when(F.col("n.is_new").isNull(), "kept").when(F.col("o.is_old").isNull(), "added").when(same, "same").when(allowed, "upgraded").otherwise("conflict")
    value = lambda c: F.when(F.col("o.is_old").isNull() | (status == "upgraded"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keys), *(value(c).alias(c) for c in values), status.alias("status"))


def cluster_flags(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cluster rows (representative, member) with the member's protein and whether the pair's sequences are the same or one holds the other.

    pairs: representative, member, representative_sequence, member_sequence, one row a pair.  A pair without sequences and a
    member that isn't a region accession are problems.
    """
    a, b = F.col("representative_sequence"), F.col("member_sequence")
    protein = parse_region(F.col("member"))["protein"]
    problem = F.when(protein.isNull(), "member").when(a.isNull() | b.isNull(), "sequences")
    j = rows.join(pairs, ["representative", "member"], "left")
    return j.select("representative", "member", protein.alias("protein"), (a == b).alias("same"), (F.contains(a, b) | F.contains(b, a)).alias("contained"), problem.alias("problem"))


def same_multisets(a: DataFrame, b: DataFrame, group: str, item: str, copies: str | None = None) -> DataFrame:
    """Per group, whether both tables hold the same items equally often; ``copies`` names a's column of counts, else a row counts once."""
    n = F.sum(copies) if copies else F.count(F.lit(1))
    x = a.groupBy(group, item).agg(n.cast("long").alias("na"))
    y = b.groupBy(group, item).agg(F.count(F.lit(1)).alias("nb"))
    equal = F.coalesce("na", F.lit(0)) == F.coalesce("nb", F.lit(0))
    return x.join(y, [group, item], "full_outer").groupBy(group).agg(F.bool_and(equal).alias("same"))


def refuse_conflicts(merged: DataFrame) -> DataFrame:
    """Fail the job on the first conflict, else pass rows on without the status."""
    status = F.when(F.col("status") == "conflict", F.raise_error(F.lit("conflicting values for a key")).cast("string")).otherwise(F.col("status"))
    return merged.withColumn("status", status).where(F.col("status").isNotNull()).drop("status")


def top_one(df: DataFrame, group: list[str], score: Column, order: list[str]) -> DataFrame:
    """Best row of each group by an exact decimal score; null scores never win, ties keep the first by order."""
    s = score.cast("decimal(38,18)")
    w = Window.partitionBy(*group).orderBy(F.desc("score__"), *order)
    return df.withColumn("score__", s).where("score__ IS NOT NULL").withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__", "score__")


def greedy_distinct(df: DataFrame, group: list[str], members: str, order: list[str], most: int = 5) -> DataFrame:
    """Up to ``most`` rows of each group, best first, that share at most a tenth of the smaller set with any chosen one."""
    rows = F.sort_array(F.collect_list(F.struct(*order, members)))
    kind = dict(df.dtypes)[members]

    def step(chosen, row):
        m = row[members]
        clash = F.exists(chosen, lambda c: 10 * F.size(F.array_intersect(c, m)) > F.least(F.size(c), F.size(m)))
        return F.when((F.size(chosen) >= most) | (F.size(m) == 0) | clash, chosen).otherwise(F.concat(chosen, F.array(m)))

    return df.groupBy(*group).agg(rows.alias("r")).select(*group, F.posexplode(F.aggregate("r", F.array().cast(f"array<{kind}>"), step)).alias("place", members))


def distance_pairs(points: DataFrame, keys: list[str], cutoff: float, other: Column) -> DataFrame:
    """Pairs of points of one key within the cutoff that satisfy ``other`` (over a.* and b.*): grid cells, then exact distance.

    Every point of side b is sent to the 27 cells around its own; side a stays in its cell, so each pair meets once.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff).cast("long")
    a = points.withColumns({f"c{c}": cell(c) for c in "xyz"})
    step = F.array(*map(F.lit, (-1, 0, 1)))
    b = a
    for c in "xyz":
        b = b.withColumn("d__", F.explode(step)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d__")).drop("d__")
    on = reduce(lambda p, q: p & q, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "cx", "cy", "cz"]])
    d2 = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return a.alias("a").join(b.alias("b"), on & other & (d2 <= cutoff * cutoff)).withColumn("distance", F.sqrt(d2))  # compared squared, so a pair exactly at the cutoff is in


def furthest(left: DataFrame, right: DataFrame, keys: list[str], upto: Column, at: Column, value: Column) -> DataFrame:
    """left with furthest: the largest value over rows of the right, of the same keys, whose place ``at`` is at most ``upto`` of the row; null
    where there is none.  A sweep: both sides lie along one order, and a running maximum stands for the pairs."""
    a = left.select(*keys, upto.alias("at__"), F.lit(1).alias("side__"), F.lit(None).cast(dict(right.select(value.alias("v")).dtypes)["v"]).alias("v__"), F.struct(*left.columns).alias("row__"))
    b = right.select(*keys, at.alias("at__"), F.lit(0).alias("side__"), value.alias("v__"), F.lit(None).cast(a.schema["row__"].dataType).alias("row__"))
    along = Window.partitionBy(*keys).orderBy("at__", "side__").rowsBetween(Window.unboundedPreceding, 0)
    swept = b.unionByName(a).withColumn("furthest", F.max("v__").over(along)).where("side__ = 1")
    return swept.select("row__.*", "furthest")


def _near(left: DataFrame, right: DataFrame, keys: list[str], reach: float | Column) -> tuple[DataFrame, DataFrame, Column, Column]:
    """a, b, the condition of being near, and the square of the distance: points of the right go to the 27 cells around them."""
    size = F.lit(float(reach)) if not isinstance(reach, Column) else reach
    cells = {f"c{c}": F.floor(F.col(c) / size).cast("long") for c in "xyz"}
    a, b = left.withColumns(cells).withColumn("reach__", size), right.withColumns(cells)
    step = F.array(*map(F.lit, (-1, 0, 1)))
    for c in "xyz":
        b = b.withColumn("d__", F.explode(step)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d__")).drop("d__")
    on = reduce(lambda p, q: p & q, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("cx", "cy", "cz")])
    way = {c: F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"}
    d2 = sum((way[c] * way[c] for c in "xyz"), F.lit(0.0))  # a power takes many times as long
    return a.alias("a"), b.alias("b"), on & (d2 <= F.col("a.reach__") ** 2), d2


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], reach: float | Column) -> DataFrame:
    """Points a of the left with points b of the right, of the same keys and within reach (a number, or a column that both sides have
    and that depends on the keys alone): columns a.*, b.* and distance."""
    a, b, on, d2 = _near(left, right, keys, reach)
    return a.join(b, on).withColumn("distance", F.sqrt(d2))


def near_any(left: DataFrame, right: DataFrame, keys: list[str], reach: float | Column) -> DataFrame:
    """Points of the left with a point of the right, of the same keys, within reach; the search for a point ends with the first."""
    a, b, on, _ = _near(left, right, keys, reach)
    return a.join(b, on, "left_semi").select(*left.columns)


def competition_rank(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """1, 1, 3 ranks."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(*order)))


def rebuilt_only(found: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What a checkpointed run still has to do: found rows whose keys aren't cached."""
    return found.join(cached.select(*keys).distinct(), keys, "left_anti")
