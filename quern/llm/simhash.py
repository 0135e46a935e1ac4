"""Operator 7, SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is two halves of 32 bits; two fingerprints with at most 3 differing bits agree up to one bit in a
half.  In each half the anchors are the words of the Hamming(31, 26) code, joined with the half's last bit: covering
radius 1.  A half within distance 1 of another lies within 1 + 1 = 2 of the other's nearest anchor, so every fingerprint
is sent home to its nearest anchor and as a visitor to every anchor within distance 2 (at most 17), and only
home-visitor pairs of an anchor are compared.  A fingerprint meets about 17 / 2**27 of the others per half.

Equal fingerprints are one row before any of this, so a group of exact copies costs nothing.  An anchor's comparison
holds its homes (8 bytes each), streams its visitors past them and keeps a forest of the links of a block, never all
pairs.  An anchor with more than ``HOT`` homes is split: its visitors are dealt over several tasks by a hash of their
fingerprints, its homes go to each of these.

Edge cases: a null text counts as empty; texts without words have fingerprint zero; a null doc_id gets a fingerprint and
the smallest non-null doc_id of its component (null if there is none); repeated rows are kept; texts are read whole, one
at a time, however long; an empty table gives no rows; columns of docs other than doc_id and text are not read by the
query, and returned unchanged by keep_representatives, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, shuffle_partitions
from .components import components

MAX_DISTANCE = 3
#: Homes of an anchor beyond which its visitors are dealt over several tasks.
HOT = 2048
#: Side of the blocks in which a hot anchor's fingerprints are compared.
_SQUARE = 1024
#: Rows of an anchor that are held before its visitors are streamed.
_HELD = 1 << 16
#: Roles at an anchor: a visitor, a home that is compared with others only, a home that visits too.
_VISITOR, _HOME, _BOTH = range(3)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None, width: int) -> tuple[bytes, np.ndarray]:
    """The lower-case words joined by spaces, and the XXH64 (seed 42) values of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return b"", np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    stop = ends[width - 1 :] if len(words) >= width else [len(joined)]
    return joined, np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stop, strict=False)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """Majority bits of the hashes; zero without any."""
    n = len(hashes)
    octets = hashes.view(np.uint8).reshape(n, 8)
    out = 0
    for k in range(8):  # bits by a histogram of each of the eight bytes
        set_bits = np.bincount(octets[:, k], minlength=256) @ _BITS
        out |= int(((2 * set_bits > n) << np.arange(8)).sum()) << (8 * k)
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) values of the word shingles."""
    return majority(shingles(text, width)[1])


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th and fp (the fingerprint's bits as a signed long) of rows (doc_id, text, th)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "th")

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], names=["doc_id", "th", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, th long, fp long")


def _syndromes() -> np.ndarray:
    """For each of the four bytes of a half (bits 0..30 stand at positions 1..31): XOR of the positions of its set bits."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for j in range(8):
            if 8 * k + j < 31:
                out[k] ^= np.where(np.arange(256) >> j & 1, 8 * k + j + 1, 0).astype(np.uint32)
    return out


def _pairs_of() -> np.ndarray:
    """Row s: the 15 masks of two bits whose positions XOR to s."""
    out = np.zeros((32, 15), dtype=np.uint32)
    for s in range(1, 32):
        out[s] = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
    return out


_SYN, _PAIR = _syndromes(), _pairs_of()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys (half and anchor), index into fp, home flag."""
    keys, index, home = [], [], []
    every = np.arange(len(fp))
    for half in range(2):
        x = (fp >> np.uint64(32 * half)).astype(np.uint32)
        s = _SYN[0][x & 255] ^ _SYN[1][x >> 8 & 255] ^ _SYN[2][x >> 16 & 255] ^ _SYN[3][x >> 24]
        near = x ^ np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - 1).astype(np.uint32), np.uint32(0))
        tag = np.int64(half) << np.int64(32)
        off = np.nonzero(s > 0)[0]
        for a, i, h in ((near, every, True), (near ^ np.uint32(1 << 31), every, False)):
            keys.append(a.astype(np.int64) | tag)
            index.append(i)
            home.append(np.full(len(i), h))
        keys.append((x[off, None] ^ _PAIR[s[off]]).ravel().astype(np.int64) | tag)
        index.append(np.repeat(off, 15))
        home.append(np.zeros(15 * len(off), dtype=bool))
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def _to_anchors(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        key, at, home = anchors(fp.view(np.uint64))
        for i in range(0, len(key), 100_000):
            c = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[c]), pa.array(fp[at[c]]), pa.array(np.where(home[c], _BOTH, _VISITOR).astype(np.int32))], names=["anchor", "fp", "role"])


def _to_homes(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        key, _, home = anchors(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key[home])], names=["anchor"])


def _meet(homes: np.ndarray, visitors: np.ndarray, distance: int):
    """Forests of the links between an anchor's homes and visitors, in blocks that bound the memory."""
    for lo in range(0, len(visitors), _SQUARE):
        block = visitors[lo : lo + _SQUARE]
        for ho in range(0, len(homes), _SQUARE):
            own = homes[ho : ho + _SQUARE]
            u, v = np.nonzero(np.bitwise_count(block[:, None] ^ own[None]) <= distance)
            if len(u) and len(ids := _spanning(u, v, block, own)):
                yield ids


def _link(anchor: np.ndarray, fp: np.ndarray, role: np.ndarray, distance: int):
    """Links of a sorted run of whole anchors, homes first in each."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    homes = np.add.reduceat((role > _VISITOR).astype(np.int64), first)
    bits = fp.view(np.uint64)
    for g in np.flatnonzero((homes > 0) & (count > 1)):
        a, n, h = first[g], count[g], homes[g]
        visits = bits[a : a + n][role[a : a + n] != _HOME]
        yield from _meet(bits[a : a + h], visits, distance)


def _spanning(u, v, left, right) -> np.ndarray:
    """Enough of the links (left[u], right[v]) to keep what they connect: a forest, by union-find over the distinct ends."""
    ends, at = np.unique(np.concatenate([left[u], right[v]]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ends))
    while True:  # vectorised label propagation with pointer jumping
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = np.flatnonzero(label != np.arange(len(ends)))
    return np.stack([ends[keep], ends[label[keep]]], axis=1).view(np.int64)


class _Meeting:
    """Links of rows (key, fp, role) that come sorted by key, homes first; the last key may go on in the next rows."""

    def __init__(self, distance: int):
        self.distance, self.last = distance, None
        self.held: list[tuple] = []  # rows of the last key
        self.homes: np.ndarray | None = None  # its homes, once its visitors are streamed

    def close(self):
        if self.homes is None and self.held:
            yield from _link(*(np.concatenate(c) for c in zip(*self.held, strict=True)), self.distance)
        self.held, self.homes = [], None

    def _more(self, key, fp, role):
        if self.homes is not None:
            yield from _meet(self.homes, fp.view(np.uint64), self.distance)
            return
        self.held.append((key, fp, role))
        if role[-1] == _VISITOR and sum(len(h[0]) for h in self.held) > _HELD:  # all homes have come
            _, fp, role = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.homes, self.held = fp[role > _VISITOR].view(np.uint64), []
            yield from _meet(self.homes, fp[role != _HOME].view(np.uint64), self.distance)

    def feed(self, key, fp, role):
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        begin = 0
        if key[0] == self.last:
            begin = int(edges[1]) if len(edges) > 1 else len(key)
            yield from self._more(key[:begin], fp[:begin], role[:begin])
        if begin < len(key):
            yield from self.close()
            z = int(edges[-1])
            if z > begin:
                yield from _link(key[begin:z], fp[begin:z], role[begin:z], self.distance)
            self.last = int(key[-1])
            yield from self._more(key[z:], fp[z:], role[z:])


def _compare(distance: int):
    """Links (u, v) of sorted rows (anchor, salt, fp, role)."""

    def run(batches):
        def record(out):
            e = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["u", "v"])

        meeting, out = _Meeting(distance), []
        for b in batches:
            if not b.num_rows:
                continue
            anchor, salt, fp, role = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for ids in meeting.feed(anchor * 65_536 + salt, fp, role):  # an anchor has 33 bits
                out.append(ids)
                if sum(map(len, out)) > 50_000:
                    yield record(out)
                    out = []
        out.extend(meeting.close())
        if out:
            yield record(out)

    return run


def links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints in column fp exactly as all pairs within the distance would."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves cover distances from 0 to 3")
    p = shuffle_partitions(fps.sparkSession)
    narrow = fps.select("fp")
    sent = narrow.mapInArrow(_to_anchors, "anchor long, fp long, role int").withColumn("salt", F.lit(0))
    homes = narrow.mapInArrow(_to_homes, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = cut(homes.select(F.col("anchor").alias("hot"), F.least(F.ceil(F.col("n") / HOT), F.lit(65_535)).cast("int").alias("parts")))
    if not hot.isEmpty():
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        # a visitor goes to its part of the anchor, a home to all parts, in one of which it visits too
        salts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("role") == _VISITOR, F.array(mine)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = sent.drop("salt").join(hot, F.col("anchor") == F.col("hot"), "left").select("anchor", "fp", "role", mine.alias("mine"), F.explode(salts).alias("salt"))
        only = (F.col("role") == _BOTH) & (F.col("mine") != F.col("salt"))
        sent = dealt.select("anchor", "fp", F.when(only, F.lit(_HOME)).otherwise(F.col("role")).alias("role"), "salt")
    rows = sent.select("anchor", "salt", "fp", "role").repartition(p, "anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("role"))
    return rows.mapInArrow(_compare(distance), "u long, v long")


def _classified(docs: DataFrame, width: int, distance: int) -> DataFrame:
    """doc_id, th (hash of the text), fp, component_id for every row of docs."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    fps = cut(fingerprints(rows, width))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(distinct, distance))
    rooted = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _classified(docs, width, distance).select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_others(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs but those whose doc_id in ids (doc_id, th, component_id) isn't its component's; of equal rows one; rows without a doc_id stay."""
    gone = ids.where("doc_id <> component_id").select(F.col("doc_id").alias("doc_id__gone"), F.col("th").alias("th__gone")).distinct()
    rows = docs.withColumn("th__row", F.xxhash64("text"))
    kept = rows.join(gone, (F.col("doc_id") == F.col("doc_id__gone")) & (F.col("th__row") == F.col("th__gone")), "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "th__row").orderBy("doc_id"))
    return kept.withColumn("n__row", nth).where("doc_id IS NULL OR n__row = 1").select(*docs.columns)


def keep_representatives(docs: DataFrame, width: int = 3, distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component; of equal rows one; rows without a doc_id stay."""
    return drop_others(docs, _classified(docs.where("doc_id IS NOT NULL"), width, distance))
