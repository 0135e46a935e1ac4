"""Operator 2, URL filters: glob rules packed into multiword Shift-And masks, all simulated over each URL at once.

A rule is a host with an optional path prefix.  It becomes two globs over ``host + path``: the host itself and any
subdomain.  ``*`` stands for bytes other than ``/``, ``**`` for any bytes, ``?`` for one byte other than ``/``.
Each glob is a row of state bits; the bits of all globs lie behind one another in 64-bit words, and one step of

    D = carry_shift(D & advance[c]) | (D & loop[c])

moves every glob over byte c.  A batch of URLs runs together, column by column, so Python's work is per byte position
and not per URL.

With many rules the globs are dealt into blocks of at most WORDS words (a longer glob has a block of its own), by the rarest GRAM bytes that a fitting
URL must contain.  A URL is put through the blocks whose bytes it contains, and through those of globs without such bytes; all others
would end without a fit.  A block's masks are made when it is first used, and the last KEPT blocks are kept, so memory stays bounded
whatever the number of rules: WORDS * 8 bytes a row of the batch, 4 KB a kept word, and the globs themselves.

Edge cases: repeated rows and ids each get their verdict; an empty table gives none; very long URLs are read whole; columns of pages besides
id and url don't matter, whatever their names; a null or ``://``-less URL has an empty host and path, fits no rule, and gets the method's default verdict.
A rule needs the URL's path to start with its own, so ``http://x.com`` (empty path) doesn't fit ``com/``.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, ...]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
#: The method's own globs, for URLs that no rule fits: (verdict, glob); later ones give way to earlier ones.
METHOD_GLOBS = (("block", "*spam*/**"), ("block", "*spam*"), ("block", "*cheap-pills*/**"), ("block", "*casino*/**"), ("block", "**/*.exe"), ("block", "**/wp-login*"))
DEFAULT_VERDICT = "allow"


class GlobAutomaton:
    """Bit-parallel simulation of many globs; picklable."""

    def __init__(self, globs: list[str]):
        loops, steps = [], []  # per state bit: byte class of its self-loop, and of the step to the next bit
        self.accept: list[int] = []
        self.start: list[int] = []
        slash = 1 << ord("/")
        every = (1 << 256) - 1
        for g in globs:
            self.start.append(len(loops))
            loops.append(0)
            steps.append(0)
            i, raw = 0, g.encode()
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops[-1] = every
                    i += 2
                elif raw[i : i + 1] == b"*":
                    loops[-1] |= every & ~slash
                    i += 1
                else:
                    steps[-1] = every & ~slash if raw[i : i + 1] == b"?" else 1 << raw[i]
                    loops.append(0)
                    steps.append(0)
                    i += 1
            self.accept.append(len(loops) - 1)
        self.words = -(-len(loops) // 64)
        self.advance, self.loop = self._pack(steps), self._pack(loops)
        self.first = np.zeros(self.words, dtype=np.uint64)
        for s in self.start:
            self.first[s // 64] |= np.uint64(1 << (s % 64))

    def _pack(self, classes: list[int]) -> np.ndarray:
        table = np.zeros((256, self.words), dtype=np.uint64)
        every = (1 << 256) - 1
        for bit, cls in enumerate(classes):
            mask = np.uint64(1 << (bit % 64))
            if cls and cls & (cls - 1) == 0:
                table[cls.bit_length() - 1, bit // 64] |= mask
            elif cls:  # all bytes, or all but the slash
                table[:, bit // 64] |= mask
                if cls != every:
                    table[ord("/"), bit // 64] &= ~mask
        return table

    def match(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each string, a column for each glob: does it fit the whole string?"""
        lengths = ends - begins
        n = len(lengths)
        order = np.argsort(-lengths, kind="stable")
        begin, left = begins[order], lengths[order]
        d = np.tile(self.first, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for j in range(int(left[0]) if n else 0):
            live = int(np.searchsorted(-left[:live], -j, side="left"))  # strings longer than j come first
            c = data[begin[:live] + j]
            now = d[:live]
            moved = now & self.advance[c]
            shifted = moved << one
            shifted[:, 1:] |= moved[:, :-1] >> top
            d[:live] = shifted | (now & self.loop[c])
        hit = np.empty((n, len(self.accept)), dtype=bool)
        for k, bit in enumerate(self.accept):
            hit[order, k] = (d[:, bit // 64] >> np.uint64(bit % 64)) & one == one
        return hit


#: Words of a block, bytes that a block's globs share, and blocks whose masks are kept.
WORDS, GRAM, KEPT = 16, 4, 512


def _literals(glob: str) -> list[bytes]:
    return [x for x in re.split(rb"[*?]+", glob.encode()) if len(x) >= GRAM]


class GlobSet:
    """Ranked globs in blocks; finds for each string the best (smallest) rank of a glob that fits it."""

    def __init__(self, globs: list[str], ranks: list[int]):
        grams = [{x[i : i + GRAM] for x in _literals(g) for i in range(len(x) - GRAM + 1)} for g in globs]
        count = Counter(g for gs in grams for g in gs)
        key = [min(gs, key=lambda g: (count[g], g)) if gs else b"" for gs in grams]
        self.blocks: list[tuple[list[str], np.ndarray]] = []  # globs and their ranks
        spans: dict[bytes, list[int]] = {}
        held: list[int] = []

        def close():
            if held:
                self.blocks.append(([globs[k] for k in held], np.array([ranks[k] for k in held], dtype=np.int64)))
                held.clear()

        bits = 0
        for k in sorted(range(len(globs)), key=lambda k: (key[k], k)):
            size = len(globs[k].encode()) + 1
            if held and (bits + size > 64 * WORDS or (key[k] == b"") != (key[held[0]] == b"")):
                close()
            bits = size if not held else bits + size
            held.append(k)
            b = len(self.blocks)
            spans.setdefault(key[k], [b, b])[1] = b
        close()
        self.always = np.arange(spans[b""][0], spans[b""][1] + 1) if b"" in spans else np.zeros(0, dtype=np.int64)
        known = sorted((int.from_bytes(g), lo, hi) for g, (lo, hi) in spans.items() if g)
        self.grams, self.lo, self.hi = (np.array([x[i] for x in known], dtype=np.int64) for i in range(3))
        self._made: OrderedDict[int, GlobAutomaton] = OrderedDict()

    def _automaton(self, block: int) -> GlobAutomaton:
        made = self._made
        if block not in made:
            made[block] = GlobAutomaton(self.blocks[block][0])
            if len(made) > KEPT:
                made.popitem(last=False)
        made.move_to_end(block)
        return made[block]

    def _tasks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (block, string) to be run, sorted, each once."""
        n = len(offsets) - 1
        pairs = [np.stack([np.repeat(self.always, n), np.tile(np.arange(n), len(self.always))])]
        first, last = int(offsets[0]), int(offsets[-1])
        if len(self.grams) and last - first >= GRAM:
            x = data[first:last].astype(np.int64)
            g = sum(x[i : len(x) - GRAM + 1 + i] << (8 * (GRAM - 1 - i)) for i in range(GRAM))
            at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
            found = np.flatnonzero(self.grams[at] == g)
            row = np.searchsorted(offsets, found + first, side="right") - 1
            inside = found + first + GRAM <= offsets[row + 1]
            at, row = at[found[inside]], row[inside]
            size = self.hi[at] - self.lo[at] + 1
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(np.stack([np.repeat(self.lo[at], size) + step, np.repeat(row, size)]))
        return np.unique(np.concatenate(pairs, axis=1).T, axis=0)

    def best(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The smallest rank of a glob that fits, for each string; -1 where none does."""
        none = np.iinfo(np.int64).max
        out = np.full(len(offsets) - 1, none)
        tasks = self._tasks(data, offsets)
        edges = np.flatnonzero(np.r_[True, np.diff(tasks[:, 0]) != 0, True]) if len(tasks) else np.zeros(1, dtype=np.int64)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            block, rows = int(tasks[lo, 0]), tasks[lo:hi, 1]
            hit = self._automaton(block).match(data, offsets[rows], offsets[rows + 1])
            out[rows] = np.minimum(out[rows], np.where(hit, self.blocks[block][1], none).min(axis=1))
        return np.where(out == none, -1, out)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by built-in string functions."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _AZ, _az)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def filter_urls(pages: DataFrame, rules=RULES, method_globs=METHOD_GLOBS, default=DEFAULT_VERDICT, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and the method's glob (null if none) for every row of pages."""
    bounded_batches(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: (-len(r.text.encode()), r.text))  # the longest first
    by_rule = GlobSet([g for r in ranked for g in r.globs()], [k for k, r in enumerate(ranked) for _ in r.globs()])
    by_method = GlobSet([g for _, g in method_globs], list(range(len(method_globs))))
    texts, verdicts = [r.text for r in ranked], [r.verdict for r in ranked]

    def run(batches):
        # The last entry serves the rank -1.
        rule_of, rule_says = np.array([*texts, None], dtype=object), np.array([*verdicts, None], dtype=object)
        glob_of, glob_says = np.array([*(g for _, g in method_globs), None], dtype=object), np.array([*(v for v, _ in method_globs), default], dtype=object)
        for b in batches:
            text = b.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
            rule, glob = by_rule.best(data, offsets), by_method.best(data, offsets)
            verdict = np.where(rule >= 0, rule_says[rule], glob_says[glob])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.string()) for x in (rule_of[rule], verdict, glob_of[glob]))], names=[id_column, "host", "path", "rule", "verdict", "method_glob"])

    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rows = rows.select("*", F.concat("host", "path").alias("whole"))
    kind = dict(rows.dtypes)[id_column]
    return rows.mapInArrow(run, f"{id_column} {kind}, host string, path string, rule string, verdict string, method_glob string")
