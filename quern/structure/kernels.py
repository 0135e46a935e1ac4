"""Kernels that are sequential by nature, per model and chain pair, in numpy: contact-graph splitting, superposition,
solvent-accessible area, helix axes, local alignment.  A group is one pair of chains of one model."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def components(nodes, graph) -> list[list]:
    """Connected parts, each sorted, in order of their smallest node."""
    left, out = set(nodes), []
    for n in sorted(nodes):
        if n not in left:
            continue
        part, todo = [], [n]
        left.discard(n)
        while todo:
            x = todo.pop()
            part.append(x)
            new = graph[x] & left
            left -= new
            todo += new
        out.append(sorted(part))
    return out


def split_patches(xyz: np.ndarray, labels: list[tuple], cutoff: float = 8.0, min_contacts: int = 5, min_residues: int = 3, max_bridge: int = 1, budget: int = 1_000_000) -> list[dict]:
    """Patches of a chain pair; labels are (chain, number).  A part that qualifies is split by the smallest, then first,
    set of up to max_bridge residues whose removal leaves two or more qualifying parts; ids p1, p2, ... depth first."""
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1) <= cutoff * cutoff
    chain = np.array([c for c, _ in labels])
    across = d2 & (chain[:, None] < chain[None]) | d2 & (chain[:, None] > chain[None])
    ends = np.flatnonzero(across.any(1)).tolist()
    ends.sort(key=lambda i: labels[i])
    place = {i: k for k, i in enumerate(ends)}
    graph = {place[i]: {place[j] for j in ends if j != i and d2[i, j]} for i in ends}
    cross = {place[i]: {place[j] for j in ends if across[i, j]} for i in ends}
    side = [chain[i] for i in ends]

    def qualifies(part) -> bool:
        inside = set(part)
        pairs = sum(len(cross[n] & inside) for n in part) // 2
        touched = [n for n in part if cross[n] & inside]
        sides = {c: sum(side[n] == c for n in touched) for c in set(side)}
        return pairs >= min_contacts and len(sides) == 2 and min(sides.values()) >= min_residues

    left, out = budget, []

    def separator(part):
        nonlocal left
        inside = set(part)
        for size in range(1, min(max_bridge, len(part) - 2) + 1):
            for cut in combinations(part, size):
                if left <= 0:
                    raise ValueError("separator search limit exceeded; reduce max_bridge or increase budget")
                left -= 1
                rest = inside - set(cut)
                sub = {n: graph[n] & rest for n in rest}
                good = [p for p in components(rest, sub) if qualifies(p)]
                if len(good) >= 2:
                    return cut, good
        return None, []

    def visit(part, parent):
        me = {"id": f"p{len(out) + 1}", "parent": parent, "members": [labels[ends[n]] for n in part], "contacts": sum(len(cross[n] & set(part)) for n in part) // 2}
        out.append(me)
        cut, good = separator(part)
        me["bridge"] = [labels[ends[n]] for n in cut or ()]
        me["status"] = "split" if cut else "leaf"
        for p in good:
            visit(p, me["id"])

    for part in components(graph, graph):
        if qualifies(part):
            visit(part, None)
    return out


PATCHES = "model string, chain_a string, chain_b string, patch string, parent string, status string, contacts int, members array<string>, bridge array<string>"


def patches(residues: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """Patches of every chain pair that has a contact; pairs: model, chain_a, chain_b."""
    keys = pairs.select("model", "chain_a", "chain_b").distinct()
    both = keys.join(residues, "model").where("chain = chain_a OR chain = chain_b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chain", "number"])
        labels = list(zip(pdf["chain"], pdf["number"].astype(int), strict=True))
        name = lambda m: [f"{c}:{n}" for c, n in m]
        k = pdf.iloc[0]
        got = split_patches(pdf[["x", "y", "z"]].to_numpy(float), labels, **options)
        return pd.DataFrame([(k.model, k.chain_a, k.chain_b, p["id"], p["parent"], p["status"], p["contacts"], name(p["members"]), name(p["bridge"])) for p in got], columns=[c.split()[0] for c in PATCHES.split(", ")])

    return both.groupBy("model", "chain_a", "chain_b").applyInPandas(run, PATCHES)


def superposition(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Proper rotation, translation and RMSD that lay moving on fixed; fewer than 3 points or points on a line are an error."""
    if len(moving) < 3 or len(moving) != len(fixed):
        raise ValueError("three or more matched points are needed")
    a, b = moving - moving.mean(0), fixed - fixed.mean(0)
    if min(np.linalg.matrix_rank(a, tol=1e-6), np.linalg.matrix_rank(b, tol=1e-6)) < 2:
        raise ValueError("the points lie on a line")
    u, _, vt = np.linalg.svd(a.T @ b)
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    t = fixed.mean(0) - r @ moving.mean(0)
    return r, t, float(np.sqrt((((moving @ r.T + t) - fixed) ** 2).sum(1).mean()))


FITS = "key string, n int, rmsd double, rotation array<double>, translation array<double>, problem string"


def superpose(matched: DataFrame) -> DataFrame:
    """Fit of each key's matched points (key, xa, ya, za on xb, yb, zb)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = [pdf["key"].iloc[0], len(pdf), None, None, None, None]
        try:
            r, t, rmsd = superposition(pdf[["xa", "ya", "za"]].to_numpy(float), pdf[["xb", "yb", "zb"]].to_numpy(float))
            row[2:5] = [rmsd, r.ravel().tolist(), t.tolist()]
        except ValueError as e:
            row[5] = str(e)
        return pd.DataFrame([row], columns=[c.split()[0] for c in FITS.split(", ")])

    return matched.groupBy("key").applyInPandas(run, FITS)


def sphere(n: int = 240) -> np.ndarray:
    """Points spread over a unit sphere on a golden spiral."""
    k = np.arange(n) + 0.5
    z, phi = 1 - 2 * k / n, math.pi * (1 + 5**0.5) * k
    s = np.sqrt(1 - z * z)
    return np.stack([s * np.cos(phi), s * np.sin(phi), z], axis=1)


def accessible_area(xyz: np.ndarray, radii: np.ndarray, probe: float = 1.4, points: int = 240) -> np.ndarray:
    """Area of each atom that a probe can touch."""
    unit, grown = sphere(points), radii + probe
    out = np.empty(len(xyz))
    for i in range(len(xyz)):
        near = np.flatnonzero((((xyz - xyz[i]) ** 2).sum(1) < (grown + grown[i]) ** 2) & (np.arange(len(xyz)) != i))
        p = xyz[i] + unit * grown[i]
        free = np.ones(points, dtype=bool)
        for j in near:
            free &= ((p - xyz[j]) ** 2).sum(1) >= grown[j] ** 2
        out[i] = 4 * math.pi * grown[i] ** 2 * free.mean()
    return out


def buried_area(atoms: DataFrame) -> DataFrame:
    """model, chain_a, chain_b, area: what two chains hide from the probe when they come together."""
    from .contacts import RADII

    chains = atoms.select("model", "chain").distinct()
    keys = chains.alias("a").join(chains.alias("b"), "model").where("a.chain < b.chain").selectExpr("model", "a.chain AS chain_a", "b.chain AS chain_b")
    both = keys.join(atoms, "model").where("chain = chain_a OR chain = chain_b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf.iloc[0]
        xyz, r = pdf[["x", "y", "z"]].to_numpy(float), pdf["element"].map(lambda e: RADII.get(e, 1.7)).to_numpy(float)
        one = (pdf["chain"] == k.chain_a).to_numpy()
        area = accessible_area(xyz[one], r[one]).sum() + accessible_area(xyz[~one], r[~one]).sum() - accessible_area(xyz, r).sum()
        return pd.DataFrame([(k.model, k.chain_a, k.chain_b, float(area))], columns=["model", "chain_a", "chain_b", "area"])

    return both.groupBy("model", "chain_a", "chain_b").applyInPandas(run, "model string, chain_a string, chain_b string, area double")


def local_alignment(a: str, b: str, match: float = 2, mismatch: float = -3, open_: float = -5, extend: float = -1) -> tuple[float, int, int, int, int]:
    """Best local score with affine gaps (a gap of k costs open + (k - 1) extend), and first and end places in a and b.

    Letters outside ACGT never match.  Vectorised along b, row by row over a.
    """
    x, y = np.frombuffer(a.encode(), dtype=np.uint8), np.frombuffer(b.encode(), dtype=np.uint8)
    sure = np.isin(y, np.frombuffer(b"ACGT", dtype=np.uint8))
    m = len(y)
    h, e = np.zeros(m + 1), np.full(m + 1, -np.inf)
    origin, eo = np.arange(m + 1) + 0j, np.zeros(m + 1, dtype=complex)  # start as (b place) + i (a place)
    best = (0.0, 0, 0, 0, 0)
    for i, c in enumerate(x):
        s = np.where((y == c) & sure, match, mismatch)
        up = h + open_
        take = up >= e + extend
        e, eo = np.where(take, up, e + extend), np.where(take, origin, eo)
        diag, fresh = h[:-1] + s, h[:-1] <= 0
        do = np.where(fresh, np.arange(m) + 1j * i, origin[:-1])
        row, ro = np.zeros(m + 1), np.zeros(m + 1, dtype=complex)
        row[1:], ro[1:] = diag, do
        better = e[1:] > row[1:]
        row[1:][better], ro[1:][better] = e[1:][better], eo[1:][better]
        low = row <= 0
        row[low], ro[low] = 0, (np.arange(m + 1) + 1j * (i + 1))[low]
        # gaps along b: running maximum of value - extend * place
        lift = row + open_ - extend * np.arange(m + 1)
        run = np.maximum.accumulate(lift)
        src = np.maximum.accumulate(np.where(lift == run, np.arange(m + 1), 0))
        f = np.full(m + 1, -np.inf)
        f[1:] = run[:-1] + extend * np.arange(m)
        gap = f > row
        ro[1:] = np.where(gap[1:], ro[src[:-1]], ro[1:])
        row = np.where(gap, f, row)
        h, origin = row, ro
        k = int(h.argmax())
        if h[k] > best[0]:
            o = origin[k]
            best = (float(h[k]), int(o.imag), i + 1, int(o.real), k)
    return best


def align(pairs: DataFrame) -> DataFrame:
    """Both strands of each pair (transcript, locus, a, b): raw and normalised score, strand, places in the transcript and locus."""
    comp = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")

    def run(batches):
        for pdf in batches:
            out = []
            for t, l, a, b in zip(pdf["transcript"], pdf["locus"], pdf["a"], pdf["b"], strict=True):
                plus, minus = local_alignment(a, b), local_alignment(a, b.translate(comp)[::-1])
                best, strand = (plus, "+") if plus[0] >= minus[0] else (minus, "-")
                s, a0, a1, b0, b1 = best
                if s <= 0:
                    out.append((t, l, 0.0, 0.0, ".", None, None, None, None))
                else:
                    lo, hi = (b0, b1) if strand == "+" else (len(b) - b1, len(b) - b0)
                    out.append((t, l, s, 100 * s / (2 * len(a)), strand, a0, a1, lo, hi))
            yield pd.DataFrame(out, columns=["transcript", "locus", "raw", "score", "strand", "t_start", "t_end", "l_start", "l_end"]).astype({c: "Int32" for c in ("t_start", "t_end", "l_start", "l_end")})

    return pairs.select("transcript", "locus", "a", "b").mapInPandas(run, "transcript string, locus string, raw double, score double, strand string, t_start int, t_end int, l_start int, l_end int")
