"""Operator 6, benchmark decontamination by spaced-seed hashing (DataFrame and SQL functions only).

Texts become lower-case words (letters and digits).  A seed is a mask over a window of words; words under a 0 are left
out of its hash, so a replaced word under a 0 keeps the hash.  Benchmark windows and document windows join on (seed,
hash); every hit lays a benchmark item beside the document on one diagonal, and the words of the diagonal are compared:
a run is a stretch at least 4 / 5 equal (+1 for an equal and -4 for an unequal word sum to 0 or more), the best run the
one with the most equal words.  A document is contaminated by an item if a run has 13 equal words, or 4 / 5 of a shorter
item's.

One plan at every size: the benchmark's hashes make two bitmaps (``_filters``; bounded by ``MOST_BITS``, whatever the
benchmark's size).  The scan looks at positions whose first two words pass the first bitmap and keeps those with a seed's
hash in the second; what passes travels as narrow rows and meets the benchmark's hashes in an equi-join, so a bitmap's
false alarms cost a row and change nothing.  Hot hashes are split by the adaptive skew join; only documents with hits
leave the scan, and of their words only the stretch that an item is laid beside meets the item.

A row is known by its doc_id and its text's hash.  Edge cases: null and empty texts match nothing; items shorter than
the masks are matched with at most one word replaced, which is all that 4 / 5 of them allows, and those under five words
whole; items under ``min_item`` words (5 unless set; 2 at least) match nothing, as one or two common words would make
every document contaminated; rows with a null doc_id are judged like all others, and find_leaks reports them under the
null id; repeated rows of a doc_id give one result row; null item_ids and null item texts are ignored; of equal runs the
first is reported; texts are never cut, however long; other columns of docs are not touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Masks of weight 5, each beginning with two words that count; every run that contaminates, with all its replaced words, keeps a window for one of them (enumerated for items of 8 to 16 words, and runs of up to 25).
SEEDS = ("110111", "11010011", "11111")
MIN_WORDS, MIN_ITEM = 13, 5
#: Bits of a bitmap for each hash of the benchmark, and the most and fewest bits of a bitmap (2 MB as a literal).
COARSE = 1 << 16
BITS_EACH, MOST_BITS, FEWEST_BITS = 32, 1 << 24, 1 << 16


_WORDS = r"filter(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), w -> w <> '')"


def words() -> Column:
    """The words of column text."""
    return F.expr(_WORDS)


def _seed_hash(tokens: str, pos: str, mask: str) -> str:
    """SQL: hash of the words under the mask's ones, null where the window leaves the text."""
    at = ", ".join(f"{tokens}[{pos} + {i}]" for i, c in enumerate(mask) if c == "1")
    return f"IF({pos} + {len(mask)} <= size({tokens}), xxhash64({at}), NULL)"


def _short_masks(n: int) -> list[str]:
    """Masks for items of n words, the first at word 2 and the others at word 0: with any one word replaced, one of them is left whole."""
    if n < 5:  # no word may be replaced
        return ["1" * n]
    return ["1" * (n - 2), "1" * (n - 1), *("1" * j + "0" + "1" * (n - 1 - j) for j in range(2, n - 1))]


def _short_start(n: int, j: int) -> int:
    return 2 if n >= 5 and j == 0 else 0


def _item_seeds(bench: DataFrame, seeds, min_item: int) -> DataFrame:
    """item_id, item words, seed number, position, hash."""
    span = max(map(len, seeds))
    items = bench.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", words().alias("item"))
    at = items.select("item_id", "item", F.posexplode("item").alias("ipos", "w__"))
    # A short item gets seeds that leave out a word each, numbered by a hundred times its length.
    hashes = [F.struct(F.lit(k).alias("seed"), F.expr(_seed_hash("item", "ipos", m)).alias("hash")) for k, m in enumerate(seeds)]
    long_ = at.where(F.size("item") >= span).select("item_id", "item", "ipos", F.explode(F.array(*hashes)).alias("s")).select("item_id", "item", "ipos", "s.seed", "s.hash").where("hash IS NOT NULL")
    for n in range(min_item, span):
        own = [F.struct(F.lit(_short_start(n, j)).alias("ipos"), F.lit(100 * n + j).alias("seed"), F.expr(_seed_hash("item", str(_short_start(n, j)), m)).alias("hash")) for j, m in enumerate(_short_masks(n))]
        short = items.where(F.size("item") == n).select("item_id", "item", F.explode(F.array(*own)).alias("s")).select("item_id", "item", "s.ipos", "s.seed", "s.hash")
        long_ = long_.unionByName(short)
    return long_


def _doc_seeds(short_lengths: list[int], seeds) -> str:
    """SQL: array of (pos, seed, hash) of the words t at position i."""
    out = [f"named_struct('pos', i, 'seed', {k}, 'hash', {_seed_hash('t', 'i', m)})" for k, m in enumerate(seeds)]
    out += [f"named_struct('pos', i, 'seed', {100 * n + j}, 'hash', {_seed_hash('t', 'i', m)})" for n in short_lengths for j, m in enumerate(_short_masks(n))]
    return f"array({', '.join(out)})"


def _places(h: str, bits: int) -> tuple[str, ...]:
    """SQL: the four bits of hash h; a power of two of bits."""
    return f"({h} & {bits - 1}L)", *(f"(shiftrightunsigned({h}, {k}) & {bits - 1}L)" for k in (16, 32, 44))


def _filters(keys: DataFrame, columns: list[str], n: int) -> list[tuple[str, int]]:
    """For each column a bitmap with the bits of its hashes, as decimal longs, and its number of bits; n: about how many hashes."""
    bits = FEWEST_BITS
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    size = bits // 64
    # Bitmap k's longs are numbered from k * size, so that one job makes them all.
    at = [f"named_struct('id', {k * size} + shiftright({p}, 6), 'v', shiftleft(1L, cast({p} & 63L as int)))" for k, c in enumerate(columns) for p in _places(c, bits)]
    hit = keys.select(F.explode(F.expr(f"array({', '.join(at)})")).alias("x")).groupBy("x.id").agg(F.bit_or("x.v").alias("v"))
    longs = keys.sparkSession.range(size * len(columns)).join(hit, "id", "left").select("id", F.coalesce("v", F.lit(0)).alias("v"))
    got = longs.groupBy(F.floor(F.col("id") / size).alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"].cast("string")), " ").alias("s"))
    return [(r["s"], bits) for r in got.orderBy("k").collect()]  # at most MOST_BITS each


def _test(h: str, name: str, bits: int) -> str:
    """SQL: may hash h be among those of the bitmap called name?"""
    return " AND ".join(f"getbit(get({name}, cast(shiftright({p}, 6) as int)), cast({p} & 63L as int)) = 1" for p in _places(h, bits))


def _coarse(keys: DataFrame, column: str) -> str:
    """SQL: array of ``COARSE`` booleans, true where a hash of the column has that remainder; folded to a literal."""
    hit = keys.select(F.expr(f"{column} & {COARSE - 1}L").alias("id")).distinct().withColumn("t", F.lit("1"))
    every = keys.sparkSession.range(COARSE).join(hit, "id", "left").select(F.struct("id", F.coalesce("t", F.lit("0")).alias("t")).alias("x"))
    digits = every.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), " ")).first()[0]
    return f"cast(split('{digits}', ' ') as array<boolean>)"


def _hits(coarse: str, pairs: tuple[str, int], hashes: tuple[str, int], short_lengths: list[int], seeds) -> Column:
    """Array of (pos, seed, hash) over the positions whose two words pass ``pairs`` where the seed's hash passes ``hashes``; the words are bound once."""
    # A look into a small array of booleans first: it is by far the cheapest test and refuses nearly all words.
    first = f"get(cb, cast(xxhash64(t[i], t[i + 1]) & {COARSE - 1}L as int)) AND {_test('xxhash64(t[i], t[i + 1])', 'pb', pairs[1])}"
    places = f"IF(size(t) > 1, filter(sequence(0, size(t) - 2), i -> {first}), array())"
    body = f"filter(flatten(transform({places}, i -> {_doc_seeds(short_lengths, seeds)})), s -> s.hash IS NOT NULL AND {_test('s.hash', 'hb', hashes[1])})"
    # Every array is spelled out once (and folded to a literal) and bound to a name.
    for name, value in (("hb", f"cast(split('{hashes[0]}', ' ') as array<bigint>)"), ("pb", f"cast(split('{pairs[0]}', ' ') as array<bigint>)"), ("cb", coarse), ("t", _WORDS)):
        body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return F.expr(body)


def _best_run() -> Column:
    """The diagonal's stretch with the most equal words of those at least 4 / 5 equal, the first of such: (equal words, first and last item position).

    With p the item position of the k-th equal word, the stretch from the i-th to the k-th scores
    (5k - 4p[k]) - (5i - 4p[i]) + 1 by +1 / -4.  Sorted by these values, an end has met just the starts that fit it, and
    the earliest of them gives the most equal words.
    """
    return F.expr(
        """element_at(transform(array(filter(sequence(lead, lead + least(size(item) - lead, size(part)) - 1), j -> item[j] = part[j - lead])),
             e -> element_at(transform(array(aggregate(
                 array_sort(concat(transform(e, (p, k) -> named_struct('v', 5 * k - 4 * p - 1, 'end', 0, 'at', k)), transform(e, (p, k) -> named_struct('v', 5 * k - 4 * p, 'end', 1, 'at', k)))),
                 named_struct('start', 2147483647, 'equal', 0, 'from', 0),
                 (a, x) -> IF(x.end = 0, named_struct('start', least(a.start, x.at), 'equal', a.equal, 'from', a.from),
                   IF(x.at - a.start + 1 > a.equal OR x.at - a.start + 1 = a.equal AND a.start < a.from,
                     named_struct('start', a.start, 'equal', x.at - a.start + 1, 'from', a.start), a)))),
               r -> named_struct('equal', r.equal, 'first', get(e, r.from), 'last', get(e, r.from + r.equal - 1))), 1)), 1)"""
    )


def _leaking_rows(docs: DataFrame, bench: DataFrame, seeds=SEEDS, min_words: int = MIN_WORDS, min_item: int = MIN_ITEM) -> DataFrame:
    """doc_id, th (hash of the text), item_id, item_words and r (the best run) of every row and item that share one."""
    if any(not m.startswith("11") for m in seeds):
        raise ValueError("seeds begin with two words that count")
    if min_item < 2:
        raise ValueError("an item of one word can't be told from a word of any text")
    keys = cut(_item_seeds(bench, seeds, min_item).withColumn("pair", F.expr("xxhash64(item[ipos], item[ipos + 1])")))
    # One small row: how many hashes there are, and which short lengths.
    stats = keys.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("seed") > 100, F.floor(F.col("seed") / 100).cast("int"))).alias("short")).first()
    hits = _hits(_coarse(keys, "pair"), *_filters(keys, ["pair", "hash"], stats["n"]), sorted(stats["short"]), seeds)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), hits.alias("hits")).where(F.size("hits") > 0)
    held = cut(rows.select("doc_id", "th", words().alias("tokens"), "hits"))  # documents with hits only
    places = keys.select("item_id", F.size("item").alias("item_words"), "ipos", "seed", "hash")
    probes = held.select("doc_id", "th", F.explode("hits").alias("s")).select("doc_id", "th", "s.pos", "s.seed", "s.hash").distinct()
    diagonals = probes.join(places, ["seed", "hash"]).select(F.col("doc_id").alias("d__"), F.col("th").alias("th__"), "item_id", "item_words", (F.col("pos") - F.col("ipos")).alias("diag")).distinct()
    texts = held.groupBy("doc_id", "th").agg(F.first("tokens").alias("tokens"))
    met = diagonals.join(texts, F.col("d__").eqNullSafe(F.col("doc_id")) & (F.col("th__") == F.col("th")))
    part = F.expr("slice(tokens, greatest(diag, 0) + 1, item_words - greatest(-diag, 0))")
    laid = met.select("doc_id", "th", "item_id", "item_words", "diag", F.greatest(F.lit(0), -F.col("diag")).alias("lead"), part.alias("part")).where("size(part) > 0")
    items = bench.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("i__"), words().alias("item"))
    runs = laid.join(items, (F.col("item_id") == F.col("i__")) & (F.col("item_words") == F.size("item"))).select("doc_id", "th", "item_id", "diag", "item_words", _best_run().alias("run"))
    enough = F.least(F.lit(min_words), F.ceil(F.col("item_words") * 0.8).cast("int"))
    run = F.struct(F.col("run.equal").alias("equal"), (-(F.col("run.first") + F.col("diag"))).alias("order"), (F.col("run.last") - F.col("run.first") + 1).alias("span"))
    return runs.where(F.col("run.equal") >= enough).select("doc_id", "th", "item_id", "item_words", run.alias("r"))


def find_leaks(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, equal_words, run_words, item_words, doc_start (word), similarity: a row for each contaminated pair."""
    best = _leaking_rows(docs, bench, **options).groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("r").alias("r"))
    return best.select(
        "doc_id", "item_id", F.col("r.equal").cast("long").alias("equal_words"), F.col("r.span").cast("long").alias("run_words"), F.col("item_words").cast("long").alias("item_words"),
        (-F.col("r.order")).cast("long").alias("doc_start"), (F.col("r.equal") / F.col("r.span")).alias("similarity"),
    )


def keep_uncontaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without those that hold a benchmark passage; rows are judged one by one, those without a doc_id too."""
    leaks = _leaking_rows(docs, bench, **options).select(F.col("doc_id").alias("doc_id__leak"), F.col("th").alias("th__leak")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("doc_id__leak")) & (F.xxhash64("text") == F.col("th__leak"))
    return docs.join(leaks, same, "left_anti")
