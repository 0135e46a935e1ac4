"""Position-wise sequence channels over centred windows that are cut off at the sequence's ends.

Each channel is an expression ``array<double>`` over a sequence column, one value per residue, so a table of channels
needs no shuffle: residues are exploded only for the output.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STANDARD = "ACDEFGHIKLMNPQRSTVWY"
# Kyte-Doolittle hydropathy.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
# Eisenberg hydrophobicity, normalized consensus scale.
EISENBERG = {"A": 0.25, "R": -1.76, "N": -0.64, "D": -0.72, "C": 0.04, "Q": -0.69, "E": -0.62, "G": 0.16, "H": -0.40, "I": 0.73, "L": 0.53, "K": -1.10, "M": 0.26, "F": 0.61, "P": -0.07, "S": -0.26, "T": -0.18, "W": 0.37, "Y": 0.02, "V": 0.54}
# TOP-IDP disorder propensity.
DISORDER = {"A": 0.06, "C": 0.02, "D": 0.192, "E": 0.736, "F": -0.697, "G": 0.166, "H": 0.303, "I": -0.486, "K": 0.586, "L": -0.326, "M": -0.397, "N": 0.007, "P": 0.987, "Q": 0.318, "R": 0.18, "S": 0.341, "T": 0.059, "V": -0.121, "W": -0.884, "Y": -0.51}
CHARGE = {"K": 1.0, "R": 1.0, "D": -1.0, "E": -1.0}


def residues(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def _windows(values: Column, radius: int, body) -> Column:
    """body(window array, width) at each position of the array, which is bound once for all positions."""

    def whole(v):
        n = F.size(v)

        def at(i):
            a = F.greatest(F.lit(1), i - radius)
            width = F.least(n, i + radius) - a + 1
            return body(F.slice(v, a, width), width)

        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), at)).otherwise(F.array().cast("array<double>"))

    return F.element_at(F.transform(F.array(values), whole), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


#: Residues of one step of a kernel: what it holds besides a batch's texts doesn't grow with their number or length.
STEP = 1 << 18


def _mean_pieces(text: str | None, radius: int, table: np.ndarray) -> Iterator[np.ndarray]:
    """Window means of a text in pieces of up to STEP residues; a window is summed from left to right, all windows of a piece at once."""
    text = text or ""
    for begin in range(0, len(text), STEP):
        end = min(begin + STEP, len(text))
        left, right = max(0, begin - radius), min(len(text), end + radius)
        values = table[np.minimum(np.frombuffer(text[left:right].encode("utf-32-le"), "<u4"), len(table) - 1)]
        at, n = np.arange(begin, end), len(values)
        total = np.zeros(n)
        for k in range(-min(radius, n), min(radius, n) + 1):
            total[max(0, -k) : n - max(0, k)] += values[max(0, k) : n - max(0, -k)]
        width = np.minimum(len(text) - 1, at + radius) - np.maximum(0, at - radius) + 1
        yield total[begin - left : end - left] / width


def _lookup(scale: dict[str, float], default: float) -> np.ndarray:
    known = {ord(c): float(v) for c, v in scale.items() if len(c) == 1}
    table = np.full(max(known, default=0) + 2, float(default))
    for c, v in known.items():
        table[c] = v
    return table


def _window_means(sequence: Column, radius: int, scale: dict[str, float], default: float = 0.0) -> Column:
    """Mean of a residue scale over each window.  Arrays go back as soon as they have STEP values together."""
    table = _lookup(scale, default)

    @F.pandas_udf("array<double>")
    def means(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            ready, size = [], 0
            for s in texts:
                ready.append(np.concatenate([np.zeros(0), *_mean_pieces(s, radius, table)]))
                size += len(ready[-1])
                if size >= STEP:
                    yield pd.Series(ready)
                    ready, size = [], 0
            yield pd.Series(ready, dtype=object)

    return means(sequence)


def _window_moments(sequence: Column, radius: int, scale: dict[str, float], default: float = 0.0) -> Column:
    """Channel.moments of window means: only four numbers of a text leave the kernel."""
    table = _lookup(scale, default)

    @F.pandas_udf(MOMENTS)
    def moments(texts: pd.Series) -> pd.DataFrame:
        def one(s):
            n, total, top, spread = 0, 0.0, None, 0.0
            for v in _mean_pieces(s, radius, table):
                mine, mean = len(v), v.mean()
                spread += ((v - mean) ** 2).sum() + ((mean - total / n) ** 2 * n * mine / (n + mine) if n else 0.0)
                n, total, top = n + mine, total + v.sum(), v.max() if top is None else max(top, v.max())
            return n, total, top, spread

        return pd.DataFrame([one(s) for s in texts], columns=["n", "total", "top", "spread"]).astype({"n": "int64", "top": "float64"})

    return moments(sequence)


def _scaled(sequence: Column, scale: dict[str, float], default: float = 0.0) -> Column:
    table = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])
    return F.transform(residues(sequence), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(default)))


MOMENTS = "n long, total double, top double, spread double"


@dataclass(frozen=True)
class Channel:
    name: str
    radius: int = 0
    needs_background = True

    def values(self, sequence: Column) -> Column:
        raise NotImplementedError

    def moments(self, sequence: Column) -> Column:
        """Of a sequence's values their number, sum, largest (null without values) and sum of squared differences from their mean."""

        def whole(v):
            n, total = F.size(v), _sum(v)
            around = F.aggregate(v, F.struct(F.lit(0.0).alias("s"), (total / F.when(n > 0, n)).alias("m")), lambda a, x: F.struct((a.s + (x - a.m) * (x - a.m)).alias("s"), a.m.alias("m")))
            return F.struct(n.cast("long").alias("n"), total.alias("total"), F.array_max(v).alias("top"), around.s.alias("spread"))

        none = F.array().cast("array<double>")
        return F.element_at(F.transform(F.array(F.coalesce(self.values(sequence), none)), whole), 1)

    def definition(self) -> dict:
        return {"kind": type(self).__name__} | asdict(self)


@dataclass(frozen=True)
class Composition(Channel):
    """Share of residues in a set."""

    letters: str = "ST"

    def values(self, sequence):
        return _window_means(sequence, self.radius, dict.fromkeys(self.letters, 1.0))

    def moments(self, sequence):
        return _window_moments(sequence, self.radius, dict.fromkeys(self.letters, 1.0))


@dataclass(frozen=True)
class Scale(Channel):
    """Window mean of a residue scale: hydropathy, disorder propensity, net charge or one of the user's own."""

    scale: tuple = tuple(HYDROPATHY.items())

    def values(self, sequence):
        return _window_means(sequence, self.radius, dict(self.scale))

    def moments(self, sequence):
        return _window_moments(sequence, self.radius, dict(self.scale))


def net_charge(name: str, radius: int) -> Scale:
    return Scale(name, radius, tuple(CHARGE.items()))


def disorder(name: str, radius: int) -> Scale:
    return Scale(name, radius, tuple(DISORDER.items()))


@dataclass(frozen=True)
class Moment(Channel):
    """Hydrophobic moment; the phase starts anew at each window's first residue."""

    angle: float = 100.0

    def __post_init__(self):
        if not 0 < self.angle <= 360:
            raise ValueError("the angle lies in (0, 360]")

    def values(self, sequence):
        d = math.radians(self.angle)

        def body(w, n):
            part = lambda f: _sum(F.transform(w, lambda h, k: h * f(k * F.lit(d))))
            return F.hypot(part(F.cos), part(F.sin)) / n

        return _windows(_scaled(sequence, EISENBERG), self.radius, body)


@dataclass(frozen=True)
class Entropy(Channel):
    """Shannon entropy of the window's residues, in bits."""

    def values(self, sequence):
        def body(w, n):
            share = lambda c: F.size(F.filter(w, lambda x: x == c)) / n
            return 0.0 - _sum(F.transform(F.array_distinct(w), lambda c: share(c) * F.log2(share(c))))

        return _windows(residues(sequence), self.radius, body)


@dataclass(frozen=True)
class Dipeptide(Channel):
    """Share of a pair of letters among the window's neighbouring pairs; sequences under two residues have no value."""

    pair: str = "GG"

    def __post_init__(self):
        if self.radius < 1:
            raise ValueError("a window of pairs needs a radius of 1 or more")

    def values(self, sequence):
        def body(w, n):
            hits = F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.when(F.concat(a, b) == self.pair, 1.0).otherwise(0.0))
            return _sum(hits) / (n - 1)

        return F.when(F.length(sequence) >= 2, _windows(residues(sequence), self.radius, body))


@dataclass(frozen=True)
class Motif(Channel):
    """1 for every residue that some match covers; matches start at every position and may overlap."""

    regex: str = "A"
    needs_background = False

    def __post_init__(self):
        if re.compile(self.regex).match(""):
            raise ValueError("a motif may not match nothing")

    def values(self, sequence):
        pattern = re.compile(self.regex)

        @F.pandas_udf("array<double>")
        def marks(texts: pd.Series) -> pd.Series:
            def one(s):
                edge, at = np.zeros(len(s) + 1), 0  # +1 where a match begins, -1 behind its end
                while m := pattern.search(s, at):
                    edge[m.start()] += 1
                    edge[m.end()] -= 1
                    at = m.start() + 1
                return (np.cumsum(edge[:-1]) > 0).astype(float).tolist()

            return texts.map(lambda s: None if s is None else one(s))

        return marks(sequence)


class ChannelSet:
    """Channels with unique names and a fingerprint of their definitions."""

    RESERVED = ("filename", "sequence_id", "position", "residue")

    def __init__(self, *channels: Channel):
        names = [c.name for c in channels]
        if len(set(names)) < len(names) or set(names) & set(self.RESERVED) or not names:
            raise ValueError("channel names must be unique and not reserved")
        self.channels = channels

    def definitions(self) -> str:
        return json.dumps([c.definition() for c in self.channels], sort_keys=True, separators=(",", ":"), ensure_ascii=True)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.definitions().encode()).hexdigest()

    def table(self, sequences: DataFrame) -> DataFrame:
        """filename, sequence_id, position, residue and a column for each channel."""
        wide = sequences.select("filename", "sequence_id", residues(F.col("sequence")).alias("r"), *(c.values(F.col("sequence")).alias(f"c{i}") for i, c in enumerate(self.channels)))
        each = wide.select("filename", "sequence_id", F.posexplode("r").alias("i", "residue"), *(f"c{i}" for i in range(len(self.channels))))
        return each.select("filename", "sequence_id", (F.col("i") + 1).alias("position"), "residue", *(F.expr(f"c{i}[i]").alias(c.name) for i, c in enumerate(self.channels)))

    def background_table(self, sequences: DataFrame) -> DataFrame:
        """channel, mu, sigma: population mean and deviation over all residues of all sequences, from one scan and one aggregate."""
        use = [c for c in self.channels if c.needs_background]
        # a sequence leaves its moments alone; they are put together as the moments of groups are
        each = sequences.select(*(c.moments(F.col("sequence")).alias(f"m{i}") for i, c in enumerate(use)))
        sums = [f.alias(f"{n}{i}") for i in range(len(use)) for n, f in zip(("n", "total", "within", "squares"), (F.sum(f"m{i}.n"), F.sum(f"m{i}.total"), F.sum(f"m{i}.spread"), F.sum(F.when(F.col(f"m{i}.n") > 0, F.col(f"m{i}.total") * F.col(f"m{i}.total") / F.col(f"m{i}.n")))), strict=True)]

        def row(i, c):
            n = F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))
            mu = F.col(f"total{i}") / n
            between = F.greatest(F.col(f"squares{i}") / n - mu * mu, F.lit(0.0))
            return F.struct(F.lit(c.name).alias("channel"), mu.alias("mu"), F.sqrt(F.col(f"within{i}") / n + between).alias("sigma"))

        return each.agg(*sums).select(F.explode(F.array(*(row(i, c) for i, c in enumerate(use)))).alias("r")).select("r.*")

    def backgrounds(self, sequences: DataFrame) -> dict[str, tuple[float, float]]:
        """The background of each channel that needs one; a zero or missing sigma is an error."""
        use = [c for c in self.channels if c.needs_background]
        got = {r["channel"]: (r["mu"], r["sigma"]) for r in self.background_table(sequences).collect()} if use else {}
        for c in use:
            mu, sigma = got.get(c.name, (None, None))
            if mu is None or sigma is None or not math.isfinite(sigma) or sigma == 0:
                raise ValueError(f"no usable background for {c.name}")
        return got

    def to_json(self, backgrounds: dict) -> str:
        return json.dumps({"type": "channel-backgrounds", "version": 1, "fingerprint": self.fingerprint(), "definitions": json.loads(self.definitions()), "backgrounds": {k: {"bg_mu": m, "bg_sigma": s} for k, (m, s) in backgrounds.items()}}, sort_keys=True)

    def from_json(self, text: str) -> dict[str, tuple[float, float]]:
        d = json.loads(text)
        if d.get("type") != "channel-backgrounds" or d.get("version") != 1 or d.get("fingerprint") != self.fingerprint():
            raise ValueError("these backgrounds belong to other channels")
        return {k: (v["bg_mu"], v["bg_sigma"]) for k, v in d["backgrounds"].items()}

    def normalized(self, table: DataFrame, backgrounds: dict[str, tuple[float, float]]) -> DataFrame:
        return table.withColumns({k: (F.col(k) - m) / s for k, (m, s) in backgrounds.items()})


def load(path: str) -> ChannelSet:
    module, _, name = path.rpartition(".")
    found = getattr(importlib.import_module(module), name)
    if not isinstance(found, ChannelSet):
        raise TypeError(f"{path} is no channel set")
    return found
