"""Operator 13, token ids in files: Re-Pair grammars over the ids of consecutive documents, read back whole or by range.

``write`` range-partitions documents by doc_id, encodes each whole text in its task and packs the ids of consecutive
documents into frames, one row of a Parquet table each: the documents of the frame, their numbers of ids, the ids before
the frame in its part, and the grammars.  A frame is closed once it has SECTION ids, so it holds less than that and one
document; its ids are cut into equal sections of at most SECTION, each with a grammar of its own.  Parquet gives the
commit protocol: a task that is lost and run again leaves no second copy, and any store that Spark writes to will do.

**Grammar.**  Re-Pair replaces a frequent pair of neighbouring symbols by a new symbol, again and again.  A round here
counts all pairs of a section, takes every pair at least about a sixteenth as frequent as the most frequent one, and replaces
their occurrences from the most frequent pair on (an occurrence gives way to a more frequent neighbour, a run of equal
symbols is paired off from its left); it ends when no pair occurs ``least`` times.  Rules only use older symbols.  Beside
each rule stands the number of ids that its symbol expands to, so ``decode`` finds any range of ids by a running sum and
opens only the symbols that touch it.

**Encoding.**  Texts go through the tokenizers library without special tokens added.  Where a text is its words' ids put
together it is encoded by distinct words, each once in a worker: that holds for word_bpe_49k.json, whose normalizer lower-cases
and whose split never spans white space or the border of a letter and a following mark.  ``by_words=False`` encodes each
text in one call, for files of which that isn't known.  A text with the string of a special token is always encoded in one call.

Edge cases: a null text is empty, and an empty text has the end id only; a null doc_id comes first; rows with the same
doc_id follow one another by a hash of their texts, then by text, repeated rows are all kept; an empty table gives a table
without frames; other columns of documents don't matter, whatever their names.  Very long texts make one long frame.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ._common import bounded_batches, ensure_checkpoint_dir, shuffle_partitions, tidy

#: Ids that share a grammar at most, and occurrences that make a pair frequent.
SECTION, LEAST = 1 << 18, 32
#: A round takes pairs down to the most frequent one's count divided by this.
SPREAD = 16
#: Pairs are first counted in 2 to the power of this many cells.
CELL_BITS = 16
#: The id that ends a document.
END_ID = 1
#: Distinct words that a worker remembers.
MOST_WORDS = 600_000

_MAGIC = b"QTG1"
_HEAD = struct.Struct("<IIIIB")
# A mark behind an ASCII or Latin-1 letter and before white space or the end is a piece of its own.
_MARK = re.compile(rb"([.,;:!?])(?=[ \t\n\v\f\r]|\Z)(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
# A word of such letters only, as UTF-8.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# How byte-level models write bytes that have no printable Latin-1 character: by the characters from 256 on, in turn.
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def grammar(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rules (n x 2), lengths (n) and symbols that expand to ids; rule i makes the symbol base + i."""
    seq, rules, lengths, n = ids.astype(np.uint32), [], [np.ones(base, dtype=np.int64)], base
    least = max(least, 4)  # half of a pair's occurrences may overlap, and a rule must be used twice
    while len(seq) > least:
        # Sums over hashed pairs are never under a pair's count: only pairs in full cells are sorted and counted one by one.
        cell = ((seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA6B))) >> np.uint32(32 - CELL_BITS)
        full = np.bincount(cell, minlength=1 << CELL_BITS)
        for bound in dict.fromkeys((max(least, int(full.max()) // SPREAD), least)):
            at = np.flatnonzero((full >= bound)[cell])
            pairs = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
            ordered = np.sort(pairs)
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(at) else at
            counts = np.diff(np.append(first, len(ordered)))
            often = np.flatnonzero(counts >= bound)
            if len(often):
                break
        else:
            break
        keys, counts = ordered[first[often]], counts[often]
        rank_of = np.empty(len(keys), dtype=np.int64)
        rank_of[np.lexsort((keys, -counts))] = np.arange(len(keys))
        found = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        hit = keys[found] == pairs
        at, rank = at[hit], rank_of[found[hit]]
        # Places of one pair that overlap are paired off from the left ...
        joined = np.concatenate([[False], np.diff(at) == 1])
        run = np.flatnonzero(~(joined & np.concatenate([[False], rank[1:] == rank[:-1]])))
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at, rank = at[place % 2 == 0], rank[place % 2 == 0]
        # ... and of different pairs that overlap the more frequent one goes first.
        joined = np.diff(at) == 1
        keep = np.ones(len(at), dtype=bool)
        keep[1:] &= ~joined | (rank[1:] < rank[:-1])
        keep[:-1] &= ~joined | (rank[:-1] < rank[1:])
        used = np.bincount(rank[keep], minlength=len(keys))
        keep &= used[rank] > 1
        at, rank = at[keep], rank[keep]
        kept = np.flatnonzero(used > 1)  # by rank
        symbol = np.zeros(len(keys), dtype=np.uint32)
        symbol[kept] = n + np.arange(len(kept), dtype=np.uint32)
        by_rank = np.empty(len(keys), dtype=np.uint64)
        by_rank[rank_of] = keys
        new = np.stack([by_rank[kept] >> np.uint64(32), by_rank[kept] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules.append(new)
        known = np.concatenate(lengths)
        lengths = [known, known[new].sum(axis=1)]
        n += len(new)
        seq[at] = symbol[rank]
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        seq = seq[stay]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)), np.concatenate(lengths)[base:], seq


def expand(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int, start: int = 0, n: int | None = None) -> np.ndarray:
    """The n ids from start on (all by default), opening only symbols that reach into them."""
    size = np.concatenate([np.ones(base, dtype=np.int64), lengths.astype(np.int64)])
    seq = symbols.astype(np.int64)
    total = int(size[seq].sum())
    stop = total if n is None else min(total, start + n)
    while len(seq):
        ends = np.cumsum(size[seq])
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[lo - 1]) if lo else 0
        seq, start, stop = seq[lo:hi], start - skipped, stop - skipped
        opened = seq >= base
        if not opened.any():
            break
        twice = np.repeat(seq, 1 + opened)
        at = np.cumsum(1 + opened) - 1  # the last place of each symbol
        pair = rules[seq[opened] - base].astype(np.int64)
        twice[at[opened] - 1], twice[at[opened]] = pair[:, 0], pair[:, 1]
        seq = twice
    return seq[: max(stop - start, 0)].astype(np.uint32)


def pack(ids: np.ndarray, base: int, section: int = SECTION, least: int = LEAST) -> bytes:
    """The bytes of a frame: a head, then for each section its head, rules, lengths and symbols, little-endian."""
    parts = max(1, -(-len(ids) // section))
    out = [_MAGIC, struct.pack("<I", parts)]
    for part in np.array_split(ids, parts):
        rules, lengths, symbols = grammar(part, base, least)
        wide = base + len(rules) > 1 << 16
        kind = "<u4" if wide else "<u2"
        out += [_HEAD.pack(len(part), len(rules), len(symbols), base, wide), rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes()]
    return b"".join(out)


def sections(frame: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """n_ids, rules, lengths, symbols and base of each section of a frame."""
    if frame[:4] != _MAGIC:
        raise ValueError("not a frame of token ids")
    at = 8
    for _ in range(struct.unpack_from("<I", frame, 4)[0]):
        n, n_rules, n_symbols, base, wide = _HEAD.unpack_from(frame, at)
        at += _HEAD.size
        kind, width = ("<u4", 4) if wide else ("<u2", 2)
        rules = np.frombuffer(frame, kind, 2 * n_rules, at).reshape(-1, 2)
        at += 2 * n_rules * width
        lengths = np.frombuffer(frame, "<u4", n_rules, at)
        at += 4 * n_rules
        symbols = np.frombuffer(frame, kind, n_symbols, at)
        at += n_symbols * width
        yield n, rules, lengths, symbols, base


def unpack(frame: bytes) -> Iterator[bytes]:
    """All ids of each section as little-endian bytes: each rule is spelled out once, from older ones."""
    for n, rules, lengths, symbols, base in sections(frame):
        ids, spelled = np.arange(base, dtype="<u4").tobytes(), []
        for a, b in rules.tolist():
            spelled.append((ids[4 * a : 4 * a + 4] if a < base else spelled[a - base]) + (ids[4 * b : 4 * b + 4] if b < base else spelled[b - base]))
        known = np.frombuffer(ids + b"".join(spelled), "<u4")
        size = np.concatenate([np.ones(base, dtype=np.int64), lengths])
        first, size = (np.cumsum(size) - size)[symbols], size[symbols]
        yield known[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(n)].tobytes()


def decode(frame: bytes, start: int, n: int) -> np.ndarray:
    """The n ids of a frame from start on, without opening the rest."""
    out = []
    for size, rules, lengths, symbols, base in sections(frame):
        if start < size and n > 0:
            out.append(expand(rules, lengths, symbols, base, max(start, 0), n + min(start, 0)))
        start, n = start - size, n  # relative to the next section
    return np.concatenate(out)[: max(n, 0)] if out else np.zeros(0, dtype=np.uint32)


class Encoder:
    """Texts as UTF-8 bytes to ids as little-endian bytes; words are encoded once while they are remembered."""

    def __init__(self, path: str, by_words: bool = True, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.base = self.model.get_vocab_size()
        self.special = [t.content.lower().encode() for t in self.model.get_added_tokens_decoder().values()]
        self.by_words, self.most, self.known = by_words, most, {}

    def __call__(self, text: bytes) -> bytes:
        low = text.lower()  # of bytes: A-Z only
        if not self.by_words or any(s in low for s in self.special):
            return np.array(self.model.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        known = self.known
        words = _MARK.sub(rb" \1", low).split()
        found = list(map(known.get, words))
        if None in found:
            new = {w: self.word(w) for w in {w for w, x in zip(words, found, strict=True) if x is None}}
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
            if len(known) + len(new) <= self.most:  # words met early are the frequent ones: they stay when it is full
                known.update(new)
        return b"".join(found)

    def word(self, word: bytes) -> bytes:
        if _LETTERS.fullmatch(word):  # composed letters without white space are one piece: only the merges are left to do
            return array("I", [t.id for t in self.model.model.tokenize(word.decode().lower().encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
        return array("I", self.model.encode(word.decode(), add_special_tokens=False).ids).tobytes()


_ENCODERS: dict = {}


def encoder(path: str, by_words: bool) -> Encoder:
    """One encoder for each file in a worker: what it knows serves the worker's later tasks."""
    if (path, by_words) not in _ENCODERS:
        _ENCODERS[path, by_words] = Encoder(path, by_words)
    return _ENCODERS[path, by_words]


def _ordered(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), F.asc_nulls_first("doc_id"), "h")
    return dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text").select("doc_id", "text")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, section: int = SECTION, least: int = LEAST, by_words: bool = True) -> None:
    """Write the ids of docs (doc_id, text), each document's followed by end_id, by ascending doc_id to the folder path."""
    bounded_batches(docs.sparkSession)
    doc_id = docs.schema["doc_id"].dataType
    schema = StructType().add("part", "integer").add("before", "long").add("n_ids", "long").add("doc_ids", ArrayType(doc_id)).add("n_tokens", ArrayType(LongType())).add("frame", "binary")
    end = np.array([end_id], dtype="<u4").tobytes()

    @tidy
    def frames(batches):
        encode, part, before = encoder(tokenizer, by_words), TaskContext.get().partitionId(), 0
        ids, counts, held, n, kind = [], [], [], 0, None

        def row():
            data = np.frombuffer(b"".join(held), "<u4")
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([pack(data, max(encode.base, end_id + 1), section, least)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            keys, kind = batch.column(0), batch.column(0).type
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                data = encode(text.as_py())
                held += (data, end)
                ids.append(keys[i].as_py())
                counts.append(len(data) // 4 + 1)
                n += counts[-1]
                if n >= section:
                    yield row()
                    before, ids, counts, held, n = before + n, [], [], [], 0
        if ids:
            yield row()

    _ordered(docs).mapInArrow(frames, schema).write.option("compression", "zstd").parquet(path)


def _based(frames: DataFrame) -> DataFrame:
    """frames with start, the ids before each: the parts' sums are as many rows as the table was written in."""
    sums = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return frames.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    frames = spark.read.parquet(path)
    bounded_batches(spark)
    doc_id = frames.schema["doc_ids"].dataType.elementType
    schema = StructType().add("doc_id", doc_id).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")

    @tidy
    def documents(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, counts, frame, start = (batch.column(c)[r] for c in range(4))
                counts, start, sums, k, left, crc = counts.as_py(), start.as_py(), [], 0, 0, 0
                left = counts[0]
                for data in unpack(frame.as_py()):
                    at = 0
                    while at < len(data):
                        crc = zlib.crc32(data[at : at + 4 * left], crc)
                        took = min(4 * left, len(data) - at)
                        at, left = at + took, left - took // 4
                        if left == 0:
                            sums.append(crc)
                            k, crc = k + 1, 0
                            left = counts[k] if k < len(counts) else 0
                starts = start + np.cumsum([0, *counts[:-1]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), batch.column(0).type.value_type), pa.array(starts), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=schema.names)

    return _based(frames).select("doc_ids", "n_tokens", "frame", "start").mapInArrow(documents, schema)


def tokens(spark: SparkSession, path: str, first: int, n: int) -> DataFrame:
    """position, id of the n ids from position first on over all files: frames beside the range aren't opened."""
    frames = _based(spark.read.parquet(path).select("part", "before", "n_ids", "frame")).where((F.col("start") < first + n) & (F.col("start") + F.col("n_ids") > first))
    bounded_batches(spark)

    @tidy
    def ids(batches):
        for batch in batches:
            for frame, start, size in zip(*(batch.column(c) for c in range(3)), strict=True):
                lo, hi = max(first, start.as_py()), min(first + n, start.as_py() + size.as_py())
                got = decode(frame.as_py(), lo - start.as_py(), hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi, dtype=np.int64)), pa.array(got.astype(np.int64))], names=["position", "id"])

    return frames.select("frame", "start", "n_ids").mapInArrow(ids, "position long, id long")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which every machine reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write docs to path (a new folder in spark.checkpoint.dir by default) and read the files back."""
    path = path or shared_folder(docs.sparkSession, "token-files")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
