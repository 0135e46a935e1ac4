"""Near copies by similarity: texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

Candidates come from two sides: SimHash fingerprints of the shingles within 3 bits (``simhash.links``), and MinHash
signatures of ``BANDS`` bands of ``ROWS`` values, which two texts at 0.8 share none of in 3 cases of a million (SimHash
lays most such pairs 4 to 12 bits apart).  Candidates whose signatures agree in less than ``ESTIMATE`` of their values
(1 pair in 100 million at 0.8) go; all others are checked by the exact likeness of their shingle sets, and the pairs that pass
are closed to components.

Texts with equal words are one node before any of this.  Of a bucket of at most ``SMALL`` nodes all pairs are candidates.
In a larger one each node meets the bucket's first ``PIVOTS`` nodes, which joins most of it; a bucket is dealt
over ``SALTS`` parts by its nodes' hashes, and only the parts' first nodes meet in one place.  What that leaves open is settled in full
by a second round: nodes that share large buckets, directly or over others, are a family, and within a family every node is
compared with every node of another component, exactly and without a limit.  Families are cut into blocks of about
``BLOCK_BYTES`` of shingle sets or ``BLOCK_NODES`` nodes; pairs of blocks are tasks of their own, and blocks of a family's main component don't meet one
another, so a large family that the first round joined costs its outer nodes times its size.

Edge cases: a null text counts as empty; texts without words are copies of each other and of no other text; texts of
fewer than five words are one shingle; of equal rows one is kept; rows without a doc_id stay; an empty table has no components; very
long texts make larger sets and smaller blocks; other columns of documents, whatever their names, are kept and not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import bounded_batches, cut, freed, shuffle_partitions
from .components import components

WIDTH, LIKENESS = 5, 0.8
BANDS, ROWS = 24, 4
SMALL, PIVOTS, SALTS = 8, 2, 16
ESTIMATE = 0.5
#: Bytes of shingle sets and nodes in a block (about), and distinct shingles that two blocks are compared by at once.
BLOCK_BYTES, BLOCK_NODES, _WIDE = 2 << 20, 512, 4096
#: Shingles taken at once into a signature.
_CHUNK = 4096
_RNG = np.random.default_rng(42)
_MUL, _ADD = (_RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_MUL |= np.uint64(1)


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of the shingle hashes' MinHash signature (none without shingles), and the signature, a byte a value in longs."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(BANDS * ROWS // 8, dtype=np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (hashes[None, i : i + _CHUNK] * _MUL + _ADD).min(axis=1))
    raw, step = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)], dtype=np.uint64).view(np.int64), least.astype(np.uint8).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th, nh (hash of the words), fp, bands and sig of rows (doc_id, text, th)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "th")

    def run(batches):
        for b in batches:
            nhs, fps, bands, sigs = [], [], [], []
            for t in b.column(1):
                joined, hashes = simhash.shingles(t.as_py(), WIDTH)
                nhs.append(xxhash.xxh64_intdigest(joined, 42))
                fps.append(simhash.majority(hashes))
                keys, sig = band_keys(hashes)
                bands.append(keys)
                sigs.append(sig)
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nhs, fps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *longs, pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "th", "nh", "fp", "bands", "sig"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, th long, nh long, fp long, bands array<long>, sig array<long>")


def _bucket_pairs(key: np.ndarray, nh: np.ndarray) -> np.ndarray:
    """Candidate pairs of a sorted run of whole buckets, as rows (u, v)."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    begin, size = np.repeat(first, count), np.repeat(count, count)
    at, out = np.arange(len(key)), []
    for d in range(1, SMALL):
        i = at[(at - begin >= d) & (size <= SMALL)]
        out.append(np.stack([nh[i - d], nh[i]], axis=1))
    for k in range(PIVOTS):
        i = at[(size > SMALL) & (at - begin > k)]
        out.append(np.stack([nh[begin[i] + k], nh[i]], axis=1))
    return np.concatenate(out)


def _meet(batches):
    """Pairs (u, v) of rows (key, nh) sorted by both, and, as u null, the first ``SMALL`` + 1 nodes (v) of each bucket (key).

    Of a bucket that spans batches only its first nodes are held.
    """

    def pairs(p):
        for i in range(0, len(p), 100_000):
            q = p[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(q), pa.int64()), pa.array(q[:, 0].copy()), pa.array(q[:, 1].copy())], names=["key", "u", "v"])

    def heads(key, nh):
        if len(key):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
            keep = place <= SMALL
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.nulls(int(keep.sum()), pa.int64()), pa.array(nh[keep])], names=["key", "u", "v"])

    rest, large = (np.zeros(0, dtype=np.int64),) * 2, None  # the bucket that may go on, whole or as (key, pivots, last)
    for b in batches:
        key, nh = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if large is not None and len(key):
            n = int(np.searchsorted(key, large[0], "right"))
            more = nh[:n]
            if n:
                yield from pairs(np.concatenate([np.stack([np.full(n, p), more], axis=1) for p in large[1]]))
            key, nh = key[n:], nh[n:]
            large = large if not len(key) else None
        if not len(key):
            continue
        key, nh = np.concatenate([rest[0], key]), np.concatenate([rest[1], nh])
        cut_at = int(np.searchsorted(key, key[-1]))
        if len(key) - cut_at > SMALL:
            large, done, rest = (key[-1], nh[cut_at : cut_at + PIVOTS]), len(key), (key[:0], nh[:0])
        else:
            done, rest = cut_at, (key[cut_at:], nh[cut_at:])
        if done:
            yield from heads(key[:done], nh[:done])
            yield from pairs(_bucket_pairs(key[:done], nh[:done]))
    if len(rest[0]):
        yield from heads(*rest)
        yield from pairs(_bucket_pairs(*rest))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def shared_bands(nodes: DataFrame) -> DataFrame:
    """key, nh, n, least of the bands that n > 1 nodes have; least is the smallest of these."""
    keyed = nodes.select(F.explode("bands").alias("key"), "nh")
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nh").alias("least")).where("n > 1")
    return cut(keyed.join(several, "key"))


def banded(shared: DataFrame) -> DataFrame:
    """u, v: candidate pairs by bands."""
    p = shuffle_partitions(shared.sparkSession)
    met = lambda rows: rows.repartition(p, "key").sortWithinPartitions("key", "nh").mapInArrow(_meet, "key long, u long, v long")
    small = met(shared.where(F.col("n") <= SMALL).select("key", "nh")).where("u IS NOT NULL").select("u", "v")
    # A large bucket's parts differ in the low bits of its key, which make room for the salt: keys that agree above them are one bucket.
    whole = F.col("key").bitwiseAND(F.lit(-SALTS).cast("long"))
    parts = cut(met(shared.where(F.col("n") > SMALL).select(whole.bitwiseOR(F.pmod("nh", F.lit(SALTS))).alias("key"), "nh").distinct()))
    heads = met(parts.where("u IS NULL").select(whole.alias("key"), F.col("v").alias("nh")))
    return small.unionByName(parts.where("u IS NOT NULL").select("u", "v")).unionByName(heads.where("u IS NOT NULL").select("u", "v"))


def candidates(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """Distinct pairs u < v of nodes (nh, fp) and their shared bands that may be near copies."""
    least = cut(nodes.groupBy("fp").agg(F.min("nh").alias("least")))
    alike = nodes.join(least, "fp").select(F.col("least").alias("u"), F.col("nh").alias("v"))
    a, b = (least.select(F.col("fp").alias(e), F.col("least").alias(f"nh_{e}")) for e in "uv")
    near = simhash.links(least).join(a, "u").join(b, "v").select(F.col("nh_u").alias("u"), F.col("nh_v").alias("v"))
    return _ordered(banded(shared).unionByName(alike).unionByName(near))


def families(shared: DataFrame) -> DataFrame:
    """node, family: nodes that meet in buckets of more than SMALL nodes, directly or over others."""
    return components(shared.where(F.col("n") > SMALL).select(F.col("least").alias("u"), F.col("nh").alias("v"))).withColumnRenamed("root", "family")


def _shingle_sets(batches):
    """nh and the sorted distinct shingle hashes of rows (nh, text)."""
    for b in batches:
        sets = [np.unique(simhash.shingles(t.as_py(), WIDTH)[1]).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["nh", "set"])


def _hashes(s) -> np.ndarray:
    return np.frombuffer(s.as_buffer(), dtype=np.uint64)


def alike(a: list[np.ndarray], b: list[np.ndarray], likeness: float) -> np.ndarray:
    """For each set of a and each of b: is their likeness at least that?  Whole numbers throughout."""
    every = np.concatenate([*a, *b])
    known, place, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1  # only shingles that occur twice can be shared
    size_a, size_b = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (a, b))
    row = np.repeat(np.arange(len(a) + len(b)), np.r_[size_a, size_b])
    shared = count[place] > 1
    row, column = row[shared], rank[place[shared]]
    both = np.zeros((len(a), len(b)), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _WIDE):
        i, j = np.searchsorted(column, (lo, lo + _WIDE))
        m = np.zeros((len(a) + len(b), _WIDE), dtype=np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        both += np.rint(m[: len(a)] @ m[len(a) :].T).astype(np.int64)
    union = size_a[:, None] + size_b[None] - both
    return (both > 0) & (both >= likeness * union)


def _compare(likeness: float):
    def run(table: pa.Table) -> pa.Table:
        """Links (u, v) between components of the sets on either side of a pair of blocks: rows side, root, set."""
        rows = list(zip(table["side"].to_pylist(), table["root"].to_pylist(), map(_hashes, table["set"]), strict=True))
        left, right = ([(r, x) for s, r, x in rows if s is side] for side in (False, True))
        links = set()
        if left and right:
            hit = alike([x for _, x in left], [x for _, x in right], likeness)
            links = {(left[i][0], right[j][0]) for i, j in zip(*np.nonzero(hit), strict=True) if left[i][0] != right[j][0]}
        u, v = zip(*sorted(links), strict=True) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def family_links(held: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Links (u, v) between the components of each family, of rows (family, root, nh): all pairs of different components are compared."""
    sized = held.join(sets.select("nh", F.octet_length("set").alias("octets")), "nh")
    roots = sized.groupBy("family", "root").agg(F.sum("octets").alias("octets"), F.count(F.lit(1)).alias("n"))
    first = F.struct("n", "octets", "root")
    main = roots.groupBy("family").agg(F.max(first).alias("m"), F.sum("octets").alias("octets"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_roots")).where("n_roots > 1")  # others are settled
    blocks = lambda octets, n: F.greatest(F.ceil(octets / BLOCK_BYTES), F.ceil(n / BLOCK_NODES), F.lit(1)).cast("long")
    open_ = main.select("family", F.col("m.root").alias("main"), blocks(F.col("octets") - F.col("m.octets"), F.col("n") - F.col("m.n")).alias("outers"), blocks(F.col("m.octets"), F.col("m.n")).alias("mains"))
    met = held.join(open_, "family").withColumn("is_main", F.col("root") == F.col("main"))
    met = met.withColumn("block", F.pmod(F.xxhash64("nh"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("outers"))))
    # Tasks are pairs of blocks: an outer block meets the outer blocks from its own on, and all main blocks.
    at, upto = F.col("block"), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    task = lambda i, j, side, to_main: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"), F.lit(to_main).alias("to_main"))
    outer = F.concat(
        F.transform(F.filter(upto("outers"), lambda k: k >= at), lambda k: task(at, k, False, False)), F.transform(F.filter(upto("outers"), lambda k: k <= at), lambda k: task(k, at, True, False)),
        F.transform(upto("mains"), lambda k: task(at, k, False, True)),
    )
    inner = F.transform(upto("outers"), lambda k: task(k, at, True, True))
    dealt = met.select("family", "root", "nh", F.explode(F.when(F.col("is_main"), inner).otherwise(outer)).alias("t")).select("family", "t.*", "root", "nh")
    return _ordered(dealt.join(sets, "nh").drop("nh").groupBy("family", "i", "j", "to_main").applyInArrow(_compare(likeness), "u long, v long"))


def _check(likeness: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = _hashes(x), _hashes(y)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= likeness * max(len(x), len(y)) else 0
                keep.append(both > 0 and both >= likeness * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nh and shingle set of the nodes (nh, at) that a pair names; the texts travel once for both rounds."""
    ends = pairs.select(F.col("u").alias("nh")).unionByName(pairs.select(F.col("v").alias("nh"))).distinct()
    wanted = nodes.join(ends, "nh").select("nh", F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th"))
    texts = rows.join(wanted, ["doc_id", "th"]).select("nh", "text")
    return cut(texts.mapInArrow(_shingle_sets, "nh long, set binary").dropDuplicates(["nh"]))


def _both_ends(pairs: DataFrame, ends: DataFrame, what: str) -> DataFrame:
    a, b = (ends.select(F.col("nh").alias(e), F.col(what).alias(f"{what}_{e}")) for e in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", f"{what}_u", f"{what}_v")


def _likely(batches):
    """The pairs (u, v, sig_u, sig_v) whose signatures agree in a share ESTIMATE of their values."""
    for b in batches:
        x, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in (b.column(2), b.column(3)))
        same = (np.ascontiguousarray(x).view(np.uint8) == np.ascontiguousarray(y).view(np.uint8)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(same >= ESTIMATE * BANDS * ROWS, pa.bool_()))


def classified(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """doc_id, th (hash of the text), component_id (its smallest doc_id) for every row of docs; no doc_id is null."""
    if not LIKENESS <= likeness <= 1:
        raise ValueError("the bands are laid out for a likeness of 0.8 or more")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    signed = cut(signatures(rows))
    nodes = cut(signed.groupBy("nh").agg(F.min(F.struct("doc_id", "th")).alias("at"), *(F.first(c).alias(c) for c in ("fp", "bands", "sig"))))
    shared = shared_bands(nodes)
    met = cut(candidates(nodes, shared))
    sets = _sets(rows, nodes, met)
    freed(docs.sparkSession)
    likely = cut(_both_ends(met, nodes, "sig").mapInArrow(_likely, "u long, v long"))

    def linked_of(pairs: DataFrame) -> DataFrame:
        return cut(_both_ends(pairs, sets, "set").mapInArrow(_check(likeness), "u long, v long"))

    linked = linked_of(likely)
    comp = components(linked)
    # Every node of a large bucket has met its pivots, so its set is there.
    freed(docs.sparkSession)
    held = cut(families(shared).join(comp, "node", "left").select("family", F.col("node").alias("nh"), F.coalesce("root", "node").alias("root")))
    more = cut(family_links(held, sets, likeness))
    if not more.isEmpty():
        comp = components(linked.unionByName(more))
    rooted = nodes.join(comp, nodes.nh == comp.node, "left").select("nh", F.col("at.doc_id").alias("least"), F.coalesce("root", "nh").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.select("doc_id", "th", "nh").join(rooted.join(smallest, "root").select("nh", "component_id"), "nh").drop("nh")


def keep_representatives(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component; of equal rows one; rows without a doc_id stay."""
    return simhash.drop_others(docs, classified(docs.where("doc_id IS NOT NULL"), likeness))
