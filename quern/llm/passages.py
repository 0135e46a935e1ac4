"""Operator 4, removal of repeated passages by prefix-free parsing.

A rolling hash of 16 bytes runs over every text.  In each 50-byte string the smallest hash is a trigger (ties: all of
them), so whether a position triggers depends on bytes nearby only, and every 50-byte string holds a trigger.  A phrase
is the 84 bytes around a trigger that all 50-byte strings with this trigger lie in; the distinct phrases are the
dictionary, a text's phrases in order its parse.  What a suffix array of the corpus would be asked, namely which
suffixes agree in their first 50 bytes and which document comes first among them, is answered from the sorted dictionary
and the sorted parse alone; the corpus' own suffixes are never sorted:

1. the parse entries (trigger, phrase, doc_id) are dealt by trigger and sorted.  Where a phrase occurs in a smaller
   doc_id, each 50-byte string of it does, so the whole phrase is marked.
2. phrases that share a trigger but aren't equal can still share 50-byte strings at an edge of a passage.  If their 33
   bytes to the left or right of the trigger agree, the first owner of each phrase gives its 50-byte strings to a second
   sort by string, and the strings that a smaller doc_id has are marked.
3. marked phrases and strings go back to their documents, which are read again, covered and cut.

Equality is taken from hashes: of a phrase 48 bits beside the trigger's 32 and its bucket, of a string 64 bits and 16 of
its first half (of 1e12 asked strings, as in some 100 TB, 0.4 pairs would be expected to be confused).  Entries travel as packed binary blobs, one for each batch of texts and bucket; a batch sends equal entries once and
resolves the others itself, so a phrase that a third of all documents share arrives once per batch.  Partitions are the
session's (spark.sql.shuffle.partitions), with ``BUCKETS`` buckets each; a task holds one bucket at a time.

Edge cases: a null text is empty; texts under 50 bytes lose nothing; a null doc_id is neither smaller nor larger than
any other, so its row is returned whole; rows of one doc_id, repeated
ones too, never remove from one another; very long texts are parsed whole, in slices; an empty table gives no rows; columns besides doc_id and text don't
matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, shuffle_partitions, tidy

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # grams in a string
SIDE = (LENGTH - GRAM) // 2  # bytes to one side that two phrases must share to share a string
BLOCK = 1 << 18
#: Buckets of a partition; a bucket is what a task holds at once.
BUCKETS = 1

_M1, _M2, _M3 = (np.uint64(c) for c in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_ROOM = BLOCK + 4 * LENGTH + 8
_POW, _IPOW = _powers(_BASE, _ROOM), _powers(_INV, _ROOM)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """out[i] = op over a[i : i + width], cut off at the end."""
    out, s = a, 1
    while s < width:
        step = min(s, width - s)
        nxt = out.copy()
        op(out[:-step], out[step:], out=nxt[:-step])
        out, s = nxt, s + step
    return out


class Parse:
    """Triggers of one block of concatenated texts; positions are relative to ``data``.

    start, end: bounds of the text that each byte belongs to.  Only triggers in [lo, hi) are kept, the bytes beyond
    are there so that each phrase is whole.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lo: int, hi: int):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * _POW[:n], out=self.prefix[1:])
        self.n = n
        every = np.arange(n)
        h = np.zeros(n, dtype=np.uint64)
        m = max(0, n - GRAM + 1)
        h[:m] = _mix((self.prefix[GRAM:] - self.prefix[:m]) * _IPOW[:m]) | np.uint64(1)
        low = _slide(h, SPAN, np.minimum)
        low[every + LENGTH > end] = 0  # no such string in this text
        high = _slide(low[::-1], SPAN, np.maximum)[::-1]
        at = np.flatnonzero((high == h) & (high > 0))
        at = at[(at >= lo) & (at < hi)]
        self.at, self.low, self.gram = at, low, h[at]
        self.left = np.maximum(at - (SPAN - 1), start[at])
        self.right = np.minimum(at + LENGTH, end[at])
        cl, cr = np.maximum(at - SIDE, start[at]), np.minimum(at + GRAM + SIDE, end[at])
        self.phrase = _mix(self.sub(self.left, self.right) + (at - self.left).astype(np.uint64) * _M2 + (self.right - at).astype(np.uint64) * _M3) & np.uint64((1 << 48) - 1)
        self.lside = _mix(self.sub(cl, at + GRAM) + (at - cl).astype(np.uint64) * _M3).astype(np.uint8)
        self.rside = _mix(self.sub(at, cr) + (cr - at).astype(np.uint64) * _M1).astype(np.uint8)

    def sub(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.prefix[b] - self.prefix[a]) * _IPOW[a]

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the 50-byte strings whose trigger is one of at[which], and their hashes, 64 and 16 bits."""
        starts = (self.at[which][:, None] + np.arange(-(SPAN - 1), 1)).ravel()
        owner = np.repeat(self.gram[which], SPAN)
        ok = starts >= 0
        starts, owner = starts[ok], owner[ok]
        starts = np.unique(starts[self.low[starts] == owner])  # low is 0 where no string starts
        return starts, _mix(self.sub(starts, starts + LENGTH) + _M3), (_mix(self.sub(starts, starts + LENGTH // 2) + _M2) >> np.uint64(48)).astype(np.uint16)


def _member(key: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Is each key in the sorted pool?"""
    if not len(pool):
        return np.zeros(len(key), dtype=bool)
    return pool[np.minimum(np.searchsorted(pool, key), len(pool) - 1)] == key


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """Cut a batch of texts (bytes and their offsets) into blocks of whole phrases: (Parse, text number of each trigger, base)."""
    total = int(offsets[-1])
    for a in range(int(offsets[0]), total, BLOCK):
        b = min(total, a + BLOCK)
        lo, hi = max(int(offsets[0]), a - 2 * LENGTH), min(total, b + 2 * LENGTH)
        first, last = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left")
        edge = np.clip(offsets[first : last + 1], lo, hi) - lo
        lengths = np.diff(edge)
        start, end = np.repeat(edge[:-1], lengths), np.repeat(edge[1:], lengths)
        # a text cut by the margin goes on beyond it; the margin is wider than any phrase, so nothing kept is touched
        p = Parse(data[lo:hi], start, end, a - lo, b - lo)
        if len(p.at):
            yield p, np.searchsorted(offsets, p.at + lo, side="right") - 1, lo


def _pack(batches):
    """Compress the texts that travel."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze.compress(t.as_py()) for t in b.column(1)], pa.binary())], names=["doc_id", "text"])


def _slices(batch, packed: bool, most: int = 1 << 23):
    """Runs of a batch's rows of at most 65536 texts and about 8 MB: first and last row, bytes, offsets."""
    open_ = zstandard.ZstdDecompressor().decompress if packed else bytes
    a, held, size = 0, [], 0
    for k, t in enumerate(batch.column(1)):
        if held and (size >= most or len(held) == 65536):
            yield a, k, *_laid(held)
            a, held, size = k, [], 0
        held.append(open_(t.as_py()))
        size += len(held[-1])
    if held:
        yield a, batch.num_rows, *_laid(held)


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted parallel keys: does a row begin a new group?"""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


#: Columns of a blob, one behind the other (an exchange compresses a column of near-equal text numbers well).
_ENTRY = {"t": "<u4", "p0": "<u4", "p1": "<u2", "l": "u1", "r": "u1", "d": "<u2"}
_STRING = {"s": "<u8", "h": "<u2", "d": "<u2"}
#: Rows between the steps: bucket k, and either entries with their doc_ids or (ids null) marks that are settled already.
_OUT = pa.schema([("k", pa.int64()), ("ids", pa.binary()), ("blob", pa.binary())])
_OUT_SQL = "k long, ids binary, blob binary"
#: Kinds of marks: a whole phrase, a phrase whose strings are asked for, a string.
_FULL, _PARTIAL, _SHARED = range(3)


_MARK = np.dtype([("d", "<i8"), ("v", "<u8"), ("kind", "u1")])


def _marks(doc: np.ndarray, value: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty(len(doc), dtype=_MARK)
    out["d"], out["v"], out["kind"] = doc, value, kind
    return out


def _addressed(marks: list[np.ndarray], n_buckets: int):
    """Marks dealt by document: (bucket, blob) rows, as many as there are buckets, however many documents they name."""
    rows = np.concatenate(marks) if marks else np.empty(0, dtype=_MARK)
    if not len(rows):
        return
    bucket = _mix(rows["d"].astype(np.uint64)) % np.uint64(n_buckets)
    order = np.lexsort((rows["v"], rows["d"], bucket))
    bucket, rows = bucket[order], rows[order]
    at = np.flatnonzero(_firsts(bucket))
    for a, b in zip(at, np.r_[at[1:], len(rows)], strict=True):
        yield int(bucket[a]), b"".join(np.ascontiguousarray(rows[k][a:b]).tobytes() for k in ("d", "v", "kind"))


def _marks_of(blob: bytes) -> np.ndarray:
    n = len(blob) // _MARK.itemsize
    out = np.empty(n, dtype=_MARK)
    out["d"], out["v"], out["kind"] = np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<u8", n, 8 * n), np.frombuffer(blob, "u1", n, 16 * n)
    return out


def _deal(bucket: np.ndarray, ids: np.ndarray, columns: dict[str, np.ndarray], kinds: dict[str, str]):
    """A (bucket, doc_ids, blob) for each bucket; column d numbers texts on input, places in the doc_ids on output."""
    if not len(bucket):
        return
    order = np.lexsort((columns["d"], bucket))
    bucket, columns = bucket[order], {k: v[order] for k, v in columns.items()}
    at = np.flatnonzero(_firsts(bucket))
    for a, b in zip(at, np.r_[at[1:], len(bucket)], strict=True):
        used, place = np.unique(columns["d"][a:b], return_inverse=True)
        yield int(bucket[a]), ids[used].tobytes(), b"".join((place if k == "d" else columns[k][a:b]).astype(t).tobytes() for k, t in kinds.items())


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def _parser(n_buckets: int):
    """Texts to parse entries dealt by trigger, and to marks that the batch itself could settle."""

    def run(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for r0, r1, data, offs in _slices(batch, False):
                ids = every[r0:r1]
                got = [(p.gram, p.phrase, p.lside, p.rside, ids[t], t) for p, t, _ in _blocks(data, offs)]
                if not got:
                    continue
                gram, phrase, ls, rs, doc, text = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.lexsort((doc, phrase, gram))
                gram, phrase, ls, rs, doc, text = (x[order] for x in (gram, phrase, ls, rs, doc, text))
                new = _firsts(gram, phrase)
                least = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
                later = (doc > least) & _firsts(gram, phrase, doc)
                out = [(k, None, b) for k, b in _addressed([_marks(doc[later], phrase[later], _FULL)], n_buckets)]
                g, p, low = _mix(gram[new]), phrase[new], np.uint64(0xFFFFFFFF)
                entries = {"t": g & low, "p0": p & low, "p1": p >> np.uint64(32), "l": ls[new], "r": rs[new], "d": text[new]}
                out += _deal((g >> np.uint64(32)) % np.uint64(n_buckets), ids, entries, _ENTRY)
                yield _batch(out)

    return run


def _bucket_groups(batches):
    """(k, rows) for each whole bucket of a partition sorted by k."""

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    for k, group in groupby(rows(), key=lambda r: r[0]):
        yield k, [r[1:] for r in group]


def _unpack(held, kinds: dict[str, str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of a bucket's blobs and the doc_id of each row."""
    width = sum(np.dtype(t).itemsize for t in kinds.values())
    columns, docs = {k: [] for k in kinds}, []
    for ids, blob in held:
        n, at = len(blob) // width, 0
        for k, t in kinds.items():
            columns[k].append(np.frombuffer(blob, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
        docs.append(np.frombuffer(ids, dtype=np.int64)[columns["d"][-1]])
    return {k: np.concatenate(v) for k, v in columns.items() if k != "d"}, np.concatenate(docs)


def _resolver(settle, n_buckets: int, most: int = 1 << 21):
    """Run ``settle`` over the entries of each bucket and address all marks to their documents."""

    def run(batches):
        held: list[np.ndarray] = []

        def ship():
            rows = [(k, None, b) for k, b in _addressed(held, n_buckets)]
            held.clear()
            return _batch(rows)

        for _, rows in _bucket_groups(batches):
            held.extend(_marks_of(b) for i, b in rows if i is None)
            entries = [r for r in rows if r[0] is not None]
            if entries:
                held.extend(settle(entries))
            if sum(map(len, held)) > most:
                yield ship()
        if sum(map(len, held)):
            yield ship()

    return run


def _delivered(batches):
    """Marks dealt by document to a row for each document: doc_id and a blob of values for each kind."""
    for _, rows in _bucket_groups(batches):
        marks = np.unique(np.concatenate([_marks_of(b) for _, b in rows]))  # sorted by document, value and kind
        at = np.flatnonzero(_firsts(marks["d"]))
        blobs: list[list] = [[], [], []]
        for a, b in zip(at, np.r_[at[1:], len(marks)], strict=True):
            for kind, out in enumerate(blobs):
                v = marks["v"][a:b][marks["kind"][a:b] == kind]
                out.append(v.tobytes() if len(v) else None)
        yield pa.RecordBatch.from_arrays([pa.array(marks["d"][at].copy(), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["m_id", "whole", "asked", "strings"])


def _settle_phrases(held):
    rows, doc = _unpack(held, _ENTRY)
    phrase = rows["p0"].astype(np.uint64) | rows["p1"].astype(np.uint64) << np.uint64(32)
    order = np.lexsort((doc, phrase, rows["t"]))
    t, phrase, doc, ls, rs = rows["t"][order], phrase[order], doc[order], rows["l"][order], rows["r"][order]
    new = _firsts(t, phrase)
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    later = doc > least
    yield _marks(doc[later], phrase[later], _FULL)
    # first owners of unequal phrases with this trigger that agree to one side
    t, phrase, doc = t[new], phrase[new], doc[new]
    ask = np.zeros(len(t), dtype=bool)
    for side in (ls[new], rs[new]):
        key = t.astype(np.uint64) << np.uint64(16) | side
        o = np.argsort(key, kind="stable")
        same = key[o][1:] == key[o][:-1]
        ask[o[1:][same]] = True
        ask[o[:-1][same]] = True
    yield _marks(doc[ask], phrase[ask], _PARTIAL)


def _settle_strings(held):
    rows, doc = _unpack(held, _STRING)
    s, half = rows["s"], rows["h"]
    order = np.lexsort((doc, half, s))
    s, half, doc = s[order], half[order], doc[order]
    new = _firsts(s, half)
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    later = (doc > least) & _firsts(s, half, doc)
    yield _marks(doc[later], s[later], _SHARED)


def _values(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", dtype="<u8")


def _asked_strings(n_buckets: int):
    """Documents with partly shared phrases to their strings, dealt by string."""

    def run(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for r0, r1, data, offs in _slices(batch, True):
                ids = every[r0:r1]
                wanted = [_values(m) for m in batch.column(2).slice(r0, r1 - r0).to_pylist()]
                text_of = np.repeat(np.arange(r1 - r0), [len(w) for w in wanted])
                want = np.unique(np.concatenate(wanted) * _M1 + text_of.astype(np.uint64) * _M2) if len(text_of) else np.array([], dtype=np.uint64)
                got = []
                for p, t, lo in _blocks(data, offs):
                    which = np.flatnonzero(_member(p.phrase * _M1 + t.astype(np.uint64) * _M2, want))
                    if len(which):
                        starts, h, half = p.strings(which)
                        got.append((h, half, np.searchsorted(offs, starts + lo, side="right") - 1))
                if not got:
                    continue
                h, half, text = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.lexsort((ids[text], half, h))
                h, half, text = h[order], half[order], text[order]
                doc = ids[text]
                new = _firsts(h, half)
                least = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
                later = (doc > least) & _firsts(h, half, doc)
                out = [(k, None, b) for k, b in _addressed([_marks(doc[later], h[later], _SHARED)], n_buckets)]
                out += _deal(_mix(h[new]) % np.uint64(n_buckets), ids, {"s": h[new], "h": half[new], "d": text[new]}, _STRING)
                yield _batch(out)

    return run


def _cover(data: np.ndarray, offsets: np.ndarray, marks: list[list[bytes | None]]) -> list[list[tuple[int, int]]]:
    """Removed runs [a, b) of each text; marks: for each kind a blob of each text."""
    n = len(offsets) - 1
    tag = lambda v, t: v * _M1 + t * _M2
    pools = []
    for blobs in marks:
        values = [_values(b) for b in blobs]
        pools.append(np.unique(tag(np.concatenate(values), np.repeat(np.arange(n), [len(v) for v in values]).astype(np.uint64))))
    begins, ends, owner = [], [], []
    for p, t, lo in _blocks(data, offsets):
        key = tag(p.phrase, t.astype(np.uint64))
        full = np.flatnonzero(_member(key, pools[_FULL]))
        begins.append(p.left[full] + lo)
        ends.append(p.right[full] + lo)
        owner.append(t[full])
        part = np.flatnonzero(_member(key, pools[_PARTIAL]))
        if len(part):
            starts, h, _ = p.strings(part)  # among a document's own strings 64 bits tell them apart
            text = np.searchsorted(offsets, starts + lo, side="right") - 1
            hit = _member(tag(h, text.astype(np.uint64)), pools[_SHARED])
            begins.append(starts[hit] + lo)
            ends.append(starts[hit] + lo + LENGTH)
            owner.append(text[hit])
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if not begins:
        return runs
    a, b, t = (np.concatenate(x) for x in (begins, ends, owner))
    order = np.lexsort((a, t))
    for x, y, k in zip((a - offsets[t])[order].tolist(), (b - offsets[t])[order].tolist(), t[order].tolist(), strict=True):
        r = runs[k]
        if r and x <= r[-1][1]:
            r[-1] = (r[-1][0], max(r[-1][1], y))
        else:
            r.append((x, y))
    return runs


def _cutter(packed: bool):
    def run(batches):
        for batch in batches:
            for r0, r1, data, offs in _slices(batch, packed):
                runs = _cover(data, offs, [batch.column(j).slice(r0, r1 - r0).to_pylist() for j in (2, 3, 4)])
                size, gone, spans, sha = [], [], [], []
                for k, r in enumerate(runs):
                    text, at, digest = data[offs[k] : offs[k + 1]], 0, hashlib.sha256()
                    for a, b in r:
                        digest.update(text[at:a])
                        at = b
                    digest.update(text[at:])
                    size.append(len(text))
                    gone.append(sum(b - a for a, b in r))
                    spans.append([{"start": a, "end": b} for a, b in r])
                    sha.append(digest.hexdigest())
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, r1 - r0), *(pa.array(c, t) for c, t in zip((size, gone, spans, sha), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte runs), kept_sha256 for every row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark, 16 << 20)  # equal phrases of a batch travel once
    # An alias of an unchanged id would keep the two joins below from sharing one exchange of the texts.
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    parts = shuffle_partitions(spark)  # the session's, whatever the input's size
    n_buckets = BUCKETS * parts
    known = rows.where("doc_id IS NOT NULL")
    # The inner join below would add this filter on one side only, and the two exchanges would differ.
    packed = known.mapInArrow(tidy(_pack), "doc_id long, text binary").where("doc_id IS NOT NULL")
    cut_sql = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "k").sortWithinPartitions("k")

    def settled(entries: DataFrame, settle) -> DataFrame:
        marks = by_bucket(entries).mapInArrow(tidy(_resolver(settle, n_buckets)), _OUT_SQL)
        rows = by_bucket(marks).mapInArrow(tidy(_delivered), "m_id long, whole binary, asked binary, strings binary")
        return rows.where("m_id IS NOT NULL")  # on both uses alike, so that one exchange serves both

    phrases = settled(known.where(F.octet_length("text") >= LENGTH).mapInArrow(tidy(_parser(n_buckets)), _OUT_SQL), _settle_phrases).select("m_id", "whole", "asked")
    met = packed.join(phrases, F.col("doc_id") == F.col("m_id"), "left").select("doc_id", "text", "whole", "asked")
    asked = met.where("asked IS NOT NULL").select("doc_id", "text", "asked")
    strings = settled(asked.mapInArrow(tidy(_asked_strings(n_buckets)), _OUT_SQL), _settle_strings).select(F.col("m_id").alias("s_id"), "strings")
    joined = met.join(strings, F.col("doc_id") == F.col("s_id"), "left").select("doc_id", "text", "whole", "asked", "strings").mapInArrow(tidy(_cutter(True)), cut_sql)
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("whole", "asked", "strings")]
    unnamed = rows.where("doc_id IS NULL").select("doc_id", "text", *nothing).mapInArrow(tidy(_cutter(False)), cut_sql)
    return joined.unionByName(unnamed)
