"""Operator 12, a Merkle manifest of a dataset: leaf hashes, authentication paths and their check, by traversal scheduling.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text.  A row's leaf is H of its fields, each
``-`` if null, else its UTF-8 byte count, ``:`` and its value.  In each group (lang) leaves ascend by key (doc_id); while
there are several nodes, every ARITY consecutive ones (the last run may be shorter, even one) become their H.  What remains
is the group's subroot; subroots by group (null first, bytewise) become the root in the same way.

**Plan.**  Texts are read once, for the leaves; from there on only digests travel.  Leaves are numbered in their group by
a range exchange, places in a part and the parts' counts.  ARITY**LEVELS consecutive leaves are a block.  A treehash pass
folds each block to its root with ARITY - 1 nodes a level at most; the roots, thousands of times fewer, are the leaves of
the next round, until one node a group is left; then the groups' subroots are treated alike.  Paths of block roots come
down by a join on (group, block), and each block is traversed leaf by leaf: for each level the traversal holds the run that
the leaf's ancestor is in, and a treehash stack that has built the next run by the time it is needed, by taking one leaf for each
leaf passed (``traverse``).  That is ARITY nodes a level and stack, however large the block is; the path above the block is shared.

Edge cases: a null key comes first; rows with equal keys are ordered by leaf, so repeated rows are neighbours and all stay;
null and empty texts have different leaves; an empty table has no rows and no root; a group of one row is its own subroot,
with no siblings there, and a proof without siblings is H of nothing; very long texts only make their leaf's hash longer;
columns besides key, group and fields don't matter, whatever their names.  Only a hot group's narrow rows are dealt over many parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ._common import bounded_batches, cut, shuffle_partitions, tidy

ARITY, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(*fields: Column) -> Column:
    """The leaf of a row with these fields, in this order."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*(part(f) for f in fields)).cast("binary"), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and a proof of ``manifest(..., proofs=True)`` lead to, for whoever received both."""
    return F.aggregate(proof, node, lambda n, s: F.sha2(F.concat(F.substring(s.others, F.lit(1), 64 * s.at), n, F.substring(s.others, 64 * s.at + 1, F.length(s.others))).cast("binary"), 256))


class Treehash:
    """Leaves pushed from the left become nodes of the given height; at most ARITY - 1 wait on each level below."""

    def __init__(self, height: int):
        self.levels: list[list[bytes]] = [[] for _ in range(height + 1)]

    def push(self, node: bytes) -> None:
        for level in self.levels[:-1]:
            level.append(node)
            if len(level) < ARITY:
                return
            node = h(*level)
            level.clear()
        self.levels[-1].append(node)

    def finish(self) -> list[bytes]:
        """The nodes of that height, short runs below folded up."""
        for level, above in zip(self.levels, self.levels[1:], strict=False):
            if level:
                above.append(h(*level))
                level.clear()
        out, self.levels[-1] = self.levels[-1], []
        return out


def height_of(n: int) -> int:
    """Rounds until one of n nodes remains."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def block_root(leaves: Sequence[bytes], height: int) -> bytes:
    """The single node of that height over at most ARITY**height leaves."""
    stack = Treehash(height)
    for node in leaves:
        stack.push(node)
    return stack.finish()[0]


def traverse(leaves: Sequence[bytes], height: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """For each leaf in turn, from the lowest level up: the place of its ancestor in its run, and the run."""
    spans = [ARITY ** (level + 1) for level in range(height)]
    ahead = [Treehash(level) for level in range(height)]
    runs = []
    for level, span in enumerate(spans):  # the runs of the first leaf
        for node in leaves[:span]:
            ahead[level].push(node)
        runs.append(ahead[level].finish())
    for i in range(len(leaves)):
        yield [(i // (span // ARITY) % ARITY, run) for span, run in zip(spans, runs, strict=True)]
        for level, span in enumerate(spans):
            if i + span < len(leaves):
                ahead[level].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[level] = ahead[level].finish()


def _numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows, which have a group g, with idx, the place in the group by that order, and n, the group's size."""
    by = [F.asc_nulls_first("g"), *order]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    # The low bits of this id are the row's place in its part.
    placed = cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    # For each group as many rows as it has parts: the window below is no longer than the number of partitions.
    counts = placed.groupBy("part", "g").agg(F.min("place").alias("lo"), F.count("*").alias("m"))
    every = Window.partitionBy("g")
    before = F.sum("m").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    bases = counts.select(F.col("part").alias("p"), F.col("g").alias("of"), (before - F.col("lo")).alias("base"), F.sum("m").over(every).alias("n"))
    met = placed.join(bases, (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("of")))
    return met.select(*rows.columns, (F.col("place") + F.col("base")).alias("idx"), "n")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One row a block: g, block, n (nodes of the whole group) and its at most ARITY**levels nodes in order."""
    more = [c for c in nodes.columns if c not in ("g", "idx", "n")]
    return nodes.groupBy("g", F.expr(f"idx div {ARITY**levels}").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", *more))).alias("nodes"))


def _height(n: int, levels: int) -> int:
    """Levels of a block: all of them where the group has several blocks, else those until one node remains."""
    return min(levels, height_of(n))


def _roots(blocks: DataFrame, levels: int) -> DataFrame:
    """g, idx, n, digest: the blocks' roots as the nodes of the next round."""
    schema = StructType().add("g", blocks.schema["g"].dataType).add("idx", "long").add("n", "long").add("digest", "binary")

    @tidy
    def roots(batches):
        for batch in batches:
            digests, sizes = [], batch.column(2).to_pylist()
            for n, nodes in zip(sizes, batch.column(3), strict=True):
                digests.append(bytes.fromhex(block_root([d.hex().encode() for d in nodes.values.field(0).to_pylist()], _height(n, levels)).decode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-n // ARITY**levels) for n in sizes], pa.int64()), pa.array(digests, pa.binary())], names=schema.names)

    return blocks.select("g", "block", "n", F.transform("nodes", lambda x: F.struct(x.digest.alias("digest"))).alias("nodes")).mapInArrow(roots, schema)


_PATH = ArrayType(StructType().add("at", "integer").add("others", "string"))


def _steps(path) -> list[dict]:
    return [{"at": at, "others": b"".join(run[:at] + run[at + 1 :]).decode()} for at, run in path]


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    """g, idx, path, top of each node: the steps up to the group's last node, and that."""
    blocks = cut(_blocks(nodes, levels))
    roots = cut(_roots(blocks, levels))
    if (roots.agg(F.max("n")).first()[0] or 0) > 1:
        above = _paths(roots, levels)
    else:
        above = roots.select("g", "idx", F.array().cast(_PATH).alias("path"), F.lower(F.hex("digest")).alias("top"))
    met = blocks.join(above.select(F.col("g").alias("of"), F.col("idx").alias("b"), "path", "top"), F.col("g").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")))
    schema = StructType().add("g", blocks.schema["g"].dataType).add("idx", "long").add("path", _PATH).add("top", "string")

    @tidy
    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                g, n, inner, path, top = (batch.column(c)[r] for c in range(5))
                idx, digests = (inner.values.field(c).to_pylist() for c in range(2))
                up = path.as_py()
                paths = [_steps(p) + up for p in traverse([d.hex().encode() for d in digests], _height(n.as_py(), levels))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g.as_py()] * len(idx), batch.column(0).type), pa.array(idx, pa.int64()), pa.array(paths, batch.column(3).type), pa.array([top.as_py()] * len(idx), pa.string())], names=schema.names
                )

    return met.select("g", "n", F.transform("nodes", lambda x: F.struct(x.idx.alias("idx"), x.digest.alias("digest"))).alias("nodes"), "path", "top").mapInArrow(each, schema)


def manifest(docs: DataFrame, received: Column | None = None, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row (and proof: array<at, others>).

    received is the leaf that was computed from what arrived, null where that is the row itself; it is folded up with the row's
    siblings to folded_root, and verified says whether that is the root.  proof_sha256 is H of the siblings, from the lowest level up.
    """
    bounded_batches(docs.sparkSession)
    arrived = F.lit(None).cast("string") if received is None else received
    rows = docs.select(F.col(group).alias("g"), F.col(key).alias("key"), F.unhex(leaf(*(F.col(c) for c in fields))).alias("digest"), F.unhex(arrived).alias("got"))
    # Whatever the range exchange samples are these narrow rows, not texts that would be hashed twice.
    nodes = _numbered(cut(rows), [F.asc_nulls_first("key"), F.asc("digest")])
    blocks = cut(_blocks(nodes.select("g", "idx", "n", "key", "digest", "got"), levels))
    roots = cut(_roots(blocks, levels))
    up = cut(_paths(roots, levels))  # of block roots in their group
    tops = up.where(F.col("idx") == 0).select(F.lit(0).alias("g"), F.col("g").alias("lang"), F.unhex("top").alias("digest"))
    tops = cut(_numbered(cut(tops), [F.asc_nulls_first("lang")]))
    over = _paths(tops.select("g", "idx", "n", "digest"), levels).select("idx", F.col("path").alias("last"), F.col("top").alias("root"))
    over = tops.select("lang", "idx").join(over, "idx").select("lang", "last", "root")
    above = up.join(over, F.col("g").eqNullSafe(F.col("lang"))).select(F.col("g").alias("of"), F.col("idx").alias("b"), F.concat("path", "last").alias("path"), F.col("top").alias("subroot"), "root")
    met = blocks.join(above, F.col("g").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")))
    schema = StructType().add(key, docs.schema[key].dataType)
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema.add(c, "string")
    schema.add("verified", "boolean")
    if proofs:
        schema.add("proof", _PATH)

    @tidy
    def checked(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                n, inner, path, subroot, root = (batch.column(c)[r] for c in range(5))
                keys, digests, got = (inner.values.field(c) for c in range(3))
                leaves = [d.hex().encode() for d in digests.to_pylist()]
                up, subroot, root = path.as_py(), subroot.as_py(), root.as_py()
                shared = "".join(s["others"] for s in up).encode()
                sides = [(s["others"][: 64 * s["at"]].encode(), s["others"][64 * s["at"] :].encode()) for s in up]
                sums, folded, paths = [], [], []
                for node, other, path in zip(leaves, got.to_pylist(), traverse(leaves, _height(n.as_py(), levels)), strict=True):
                    node = node if other is None else other.hex().encode()
                    siblings = []
                    for at, run in path:
                        left, right = run[:at], run[at + 1 :]
                        siblings += left + right
                        node = h(*left, node, *right)
                    for left, right in sides:
                        node = h(left, node, right)
                    sums.append(h(*siblings, shared).decode())
                    folded.append(node.decode())
                    if proofs:
                        paths.append(_steps(path) + up)
                columns = [keys, pa.array([x.decode() for x in leaves]), pa.array([subroot] * len(leaves)), pa.array([root] * len(leaves)), pa.array(sums), pa.array(folded), pa.array([x == root for x in folded])]
                if proofs:
                    columns.append(pa.array(paths, batch.column(2).type))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    inner = F.transform("nodes", lambda x: F.struct(x.key.alias("key"), x.digest.alias("digest"), x.got.alias("got"))).alias("nodes")
    return met.select("n", inner, "path", "subroot", "root").mapInArrow(checked, schema)


def tampered_leaf(text: str = "text", key: str = "doc_id", fields: Sequence[str] = FIELDS) -> Column:
    """The leaf of the row with A-Z of its text lower-cased, where 3 divides the CRC-32 of its key in decimal, else null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    return F.when(hit, leaf(*(low if c == text else F.col(c) for c in fields)))
