"""Two complexes that share a chain, laid over each other: fits by mergeable moments, coverage of binding sites, clashes between the
partners, and what putting one shared chain in the other's place changes.

jobs: job, shared_a, shared_b, start_a, start_b (first number of the shared sequence on either side), length, length_a, length_b (of
the whole chains), known (are confidences known on both sides?), and any further columns.  ``model_jobs`` makes them from models.
first and second: the atoms of either side (job, chain, number, name, element, plddt, x, y, z).  A subset is a named set of matched
Cα atoms that the second complex is moved by: all of them, all but three at either end, each binding site, the confident ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import near_any, near_pairs
from ..session import settled
from .contacts import BACKBONE, RADII, heavy

# Limits of the comparison, in angstroms where they are lengths.
CLASH, CONTACT, SITE = 0.4, 4.5, 8.0
RMSD_WARNING, SITE_RMSD_WARNING, COVERAGE_WARNING = 2.0, 1.5, 0.9
FAR, FAR_SHARE, ENDS, CONFIDENT = 3.0, 0.1, 3, 80.0
#: Two overlaps count as equal within this.
SAME = 1e-6
#: Of two atoms at different distances, the farther one can overlap more by its radii only up to this.
_SLACK = 2 * (max(RADII.values()) - min(RADII.values()))
_PLACE = ["job", "subset"]
#: No two atoms farther apart clash.
_CLASHING = 2 * max(RADII.values()) - CLASH + SAME


def model_jobs(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """job, ..., model_a, model_b: every model of one side with every model of the other that belongs to the same comparison ``on``."""
    a, b = first.select(on, F.col("model").alias("model_a")).distinct(), second.select(on, F.col("model").alias("model_b")).distinct()
    return a.join(b, on).withColumn("job", F.concat_ws("/", on, "model_a", "model_b"))


def matched(first: DataFrame, second: DataFrame, jobs: DataFrame) -> DataFrame:
    """job, position (from 1 in the shared sequence), number_a, number_b, plddt_a, plddt_b, f (fixed), m (mobile: array of x, y, z)."""

    def side(atoms, s, name):
        j = atoms.where("name = 'CA'").join(jobs.select("job", F.col(f"shared_{s}").alias("chain"), F.col(f"start_{s}").alias("start"), "length"), ["job", "chain"])
        position = F.col("number") - F.col("start") + 1
        return j.where(position.between(F.lit(1), F.col("length"))).select("job", position.alias("position"), F.col("number").alias(f"number_{s}"), F.col("plddt").alias(f"plddt_{s}"), F.array(*(F.col(c).cast("double") for c in "xyz")).alias(name))

    return side(first, "a", "f").join(side(second, "b", "m"), ["job", "position"])


def sites(atoms: DataFrame, jobs: DataFrame, side: str, reach: float = SITE) -> DataFrame:
    """job, partner, number: residues of the shared chain whose Cα lies within reach of a heavy atom of a partner chain."""
    shared = jobs.select("job", F.col(f"shared_{side}").alias("shared"))
    t = heavy(atoms).join(shared, "job")
    ca, others = (t.where(c).select("job", "number", F.col("chain").alias("partner"), "x", "y", "z") for c in ("chain = shared AND name = 'CA'", "chain <> shared"))
    asked = ca.drop("partner").join(others.select("job", "partner").distinct(), "job")  # a job has few chains
    return near_any(asked, others, ["job", "partner"], reach).select("job", "partner", "number").distinct()


def subsets(pairs: DataFrame, jobs: DataFrame, site_a: DataFrame, site_b: DataFrame, partners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job, subset, position) and the list (job, subset) of those that are asked for, with members or without."""
    whole = F.when((F.col("length") == F.col("length_a")) & (F.col("length") == F.col("length_b")), "whole_chain").otherwise("matched_segment")
    j = pairs.select("job", "position", "number_a", "number_b", "plddt_a", "plddt_b").join(jobs.select("job", "length", whole.alias("whole"), "known"), "job")
    inner = (F.col("position") > ENDS) & (F.col("position") <= F.col("length") - ENDS)
    sure = F.col("known") & (F.col("plddt_a") >= CONFIDENT) & (F.col("plddt_b") >= CONFIDENT)
    fixed = j.select("job", "position", F.explode(F.array_compact(F.array("whole", F.when(inner, "exclude_terminal_three"), F.when(sure, "source_plddt_ge_80")))).alias("subset"))
    named = lambda s: F.concat(F.lit(f"site_{s}_"), F.col("partner"))
    at = [j.join(t.select("job", F.col("number").alias(f"number_{s}"), named(s).alias("subset")), ["job", f"number_{s}"]).select("job", "position", "subset") for s, t in (("a", site_a), ("b", site_b))]
    asked = jobs.select("job", F.explode(F.array_compact(F.array(whole, F.lit("exclude_terminal_three"), F.when(F.col("known"), "source_plddt_ge_80")))).alias("subset"))
    asked = asked.unionByName(partners.select("job", F.concat(F.lit("site_"), "side", F.lit("_"), "partner").alias("subset")))
    return reduce(DataFrame.unionByName, [fixed.select("job", "subset", "position"), *(t.select("job", "subset", "position") for t in at)]), asked


def moments(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """job, subset, n and sums over matched points: f0.., m0.., of products mf00.. (mobile i, fixed j), ff00.., mm00.. (i <= j).

    Sums of parts add up, so one aggregate serves all subsets, however many tasks hold a job's points.
    """
    f, m = [F.col("f")[i] for i in range(3)], [F.col("m")[i] for i in range(3)]
    sums = {f"f{i}": f[i] for i in range(3)} | {f"m{i}": m[i] for i in range(3)} | {f"mf{i}{j}": m[i] * f[j] for i in range(3) for j in range(3)}
    sums |= {f"ff{i}{j}": f[i] * f[j] for i in range(3) for j in range(i, 3)} | {f"mm{i}{j}": m[i] * m[j] for i in range(3) for j in range(i, 3)}
    return members.join(pairs.select("job", "position", "f", "m"), ["job", "position"]).groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


def covariances(sums: DataFrame) -> DataFrame:
    """The same about the means: n, f0.., m0.. are means, mf, ff and mm central sums."""
    n = F.col("n")
    mean = {f"{s}{i}": F.col(f"{s}{i}") / n for s in "fm" for i in range(3)}
    central = {f"mf{i}{j}": F.col(f"mf{i}{j}") - F.col(f"m{i}") * F.col(f"f{j}") / n for i in range(3) for j in range(3)}
    central |= {f"{s}{s}{i}{j}": F.col(f"{s}{s}{i}{j}") - F.col(f"{s}{i}") * F.col(f"{s}{j}") / n for s in "fm" for i in range(3) for j in range(i, 3)}
    return sums.select(*_PLACE, "n", *(c.alias(k) for k, c in (mean | central).items()))


def _rotations(batches):
    """Rotation (row by row) and shift that take mobile to fixed, where there are three points or more that aren't on a line."""
    for t in batches:
        square = lambda s, t=t: np.stack([t[f"{s}{min(i, j)}{max(i, j)}"] for i in range(3) for j in range(3)], axis=1).reshape(-1, 3, 3)
        cov = np.stack([t[f"mf{i}{j}"] for i in range(3) for j in range(3)], axis=1).reshape(-1, 3, 3)
        u, _, vt = np.linalg.svd(cov)
        sign = np.ones((len(t), 1, 3))
        sign[:, 0, 2] = np.sign(np.linalg.det(u @ vt))
        rotation = (u * sign) @ vt
        fixed, mobile = (np.stack([t[f"{s}{i}"] for i in range(3)], axis=1) for s in "fm")
        shift = fixed - np.einsum("ni,nij->nj", mobile, rotation)
        spread = [np.linalg.eigvalsh(square(s)) for s in ("ff", "mm")]
        good = (t["n"].to_numpy() >= 3) & np.all([e[:, 1] > 1e-12 * np.maximum(e[:, 2], 1e-300) for e in spread], axis=0)
        yield pd.DataFrame({"job": t["job"], "subset": t["subset"], "n": t["n"], "rotation": [r.ravel() if g else None for r, g in zip(rotation, good, strict=True)], "shift": [s if g else None for s, g in zip(shift, good, strict=True)]})


def fits(sums: DataFrame) -> DataFrame:
    """job, subset, n, rotation (9), shift (3); null where points are too few or on a line."""
    return covariances(sums).mapInPandas(_rotations, f"job {dict(sums.dtypes)['job']}, subset string, n long, rotation array<double>, shift array<double>")


def moved(p: list[Column], rotation: Column, shift: Column) -> list[Column]:
    return [sum((p[i] * rotation[3 * i + j] for i in range(3)), shift[j]) for j in range(3)]


def deviations(pairs: DataFrame, fit: DataFrame) -> DataFrame:
    """job, subset, position, deviation of every matched position under each fit."""
    j = pairs.join(fit.where("rotation IS NOT NULL"), "job")
    at = moved([F.col("m")[i] for i in range(3)], F.col("rotation"), F.col("shift"))
    return j.select("job", "subset", "position", F.sqrt(sum(((at[i] - F.col("f")[i]) ** 2 for i in range(3)), F.lit(0.0))).alias("deviation"))


def closest(left: DataFrame, right: DataFrame, keys: list[str], reach: float = CONTACT) -> DataFrame:
    """keys, distance: the smallest distance of a point on the left to one on the right.

    The search goes out from reach; only keys that have found no pair go on, four times as far each time, so that points are compared with
    their surroundings and not with all others.
    """
    rest = settled(left.select(*keys).distinct().join(right.select(*keys).distinct(), keys))
    found = []
    while True:
        near = near_pairs(left.join(rest, keys), right.join(rest, keys), keys, reach)
        got = near.select(*(F.col(f"a.{k}").alias(k) for k in keys), "distance").groupBy(*keys).agg(F.min("distance").alias("distance"))
        got = settled(got)
        found.append(got)
        rest = settled(rest.join(got, keys, "left_anti"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        reach *= 4


def geometry(left: DataFrame, right: DataFrame, keys: list[str], clash: float = CLASH, contact: float = CONTACT) -> DataFrame:
    """keys, number_a, atom_a, number_b, atom_b, distance, overlap, clash, contact, backbone: heavy-atom pairs that clash or touch."""
    near = near_pairs(left, right, keys, max(contact, 2 * max(RADII.values()) - clash))
    overlap = F.col("a.radius") + F.col("b.radius") - F.col("distance")
    both = F.col("a.name").isin(*BACKBONE) & F.col("b.name").isin(*BACKBONE)
    t = near.select(
        *(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.number").alias("number_a"), F.col("a.name").alias("atom_a"), F.col("b.number").alias("number_b"), F.col("b.name").alias("atom_b"),
        "distance", overlap.alias("overlap"), (overlap > clash).alias("clash"), (F.col("distance") <= contact).alias("contact"), both.alias("backbone"),
    )
    return t.where("clash OR contact")


def _overlap(p: Column, q: Column) -> Column:
    return p["radius"] + q["radius"] - F.sqrt(_square(p, q))


def _square(p: Column, q: Column) -> Column:
    return sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz"), F.lit(0.0))


def _clashing(limit: float) -> Callable[[Column, Column], Column]:
    return lambda p, q: F.when((_overlap(p, q) > limit) & ~F.isnan(_overlap(p, q)), _overlap(p, q))


_ATOM = ["x", "y", "z", "radius", "main"]


def _listed(t: DataFrame, keys: list[str], name: str) -> DataFrame:
    return t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y", "z", "radius", F.col("name").isin(*BACKBONE).alias("main")))).alias(name))


def _spread(t: DataFrame) -> DataFrame:
    """A row for each atom of the list ``all``, with its place i; the lists ``all`` and ``other`` stay only where one holds several atoms, and
    the one atom of ``other`` is ``twin``."""
    several = F.coalesce((F.size("all") > 1) | (F.size("other") > 1), F.size("all") > 1)
    lists = {c: F.when(F.col("several"), F.col(c)) for c in ("all", "other")}
    t = t.withColumns({"several": several, "twin": F.try_element_at("other", F.lit(1))}).select("*", F.posexplode("all").alias("i", "p__"))
    return t.withColumns(lists).select(*t.columns[:-2], "i", "p__.*")


def _best(list_: str, value: Callable[[Column, Column], Column]) -> Column:
    """value, i, j: the largest value of an atom of a's list with one of b's, and their places; null where no two have a value."""
    one = {"all": lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in _ATOM)), "other": lambda s: F.col(f"{s}.twin")}[list_]
    a, b = (F.when(F.col(f"{s}.several"), F.col(f"{s}.{list_}")).otherwise(F.when(one(s).isNotNull(), F.array(one(s)))) for s in "ab")
    of = lambda p, q, i, j: F.when(value(p, q).isNotNull(), F.struct(value(p, q).alias("value"), i.alias("i"), j.alias("j")))
    return F.array_max(F.flatten(F.transform(a, lambda p, i: F.transform(b, lambda q, j: of(p, q, i, j)))))


def _here(best: Column) -> Column:
    """Is the best pair this one?"""
    return ~(F.col("a.several") | F.col("b.several")) | F.coalesce((best["i"] == F.col("a.i")) & (best["j"] == F.col("b.i")), F.lit(False))


def clash_counts(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys, by (columns of the left), clash_atom_pairs: clashes are counted where they are found."""
    near = near_pairs(left.select(*keys, *by, "x", "y", "z", "radius"), right.select(*keys, "x", "y", "z", "radius"), keys, _CLASHING)
    clashes = near.where(F.col("a.radius") + F.col("b.radius") - F.col("distance") > CLASH)
    return clashes.groupBy(*(F.col(f"a.{k}").alias(k) for k in [*keys, *by])).agg(F.count(F.lit(1)).alias("clash_atom_pairs"))


def summary(left: DataFrame, right: DataFrame, keys: list[str], clash: float = CLASH, contact: float = CONTACT) -> DataFrame:
    """keys, min_distance, max_overlap, clash_atom_pairs, clash_residue_pairs, backbone_clashes, contact_residue_pairs.

    Every atom knows all of its residue, so a pair of residues is counted where its worst clash or closest contact is found, and pairs
    are not gathered.
    """
    least = closest(left, right, keys)
    span = least.agg(F.max("distance")).first()[0]
    if span is None:
        near = near_pairs(left, right, keys, 1.0)
    else:  # what overlaps most lies hardly farther off than what is closest
        at = least.withColumn("reach", F.col("distance") + _SLACK + SAME)
        near = near_pairs(left.join(at.select(*keys, "reach"), keys), right.join(at.select(*keys, "reach"), keys), keys, F.col("reach"))
    most = near.select(*(F.col(f"a.{k}").alias(k) for k in keys), (F.col("a.radius") + F.col("b.radius") - F.col("distance")).alias("overlap")).groupBy(*keys).agg(F.max("overlap").alias("max_overlap"))
    a, b = (_spread(_listed(t, [*keys, "number"], "all").withColumn("other", F.lit(None).cast("array<struct<x:double>>"))) for t in (left, right))
    met = near_pairs(a, b, keys, max(contact, 2 * max(RADII.values()) - clash) + SAME)
    clashes, touches = F.col("a.radius") + F.col("b.radius") - F.col("distance") > clash, F.col("distance") <= contact
    worst = _here(_best("all", _clashing(clash)))
    nearest = _here(_best("all", lambda p, q: F.when(F.sqrt(_square(p, q)) <= contact, -_square(p, q))))
    counts = met.where(clashes | touches).groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(
        F.count_if(clashes).alias("clash_atom_pairs"), F.count_if(F.when(clashes, worst)).alias("clash_residue_pairs"), F.count_if(clashes & F.col("a.main") & F.col("b.main")).alias("backbone_clashes"),
        F.count_if(F.when(touches, nearest)).alias("contact_residue_pairs"),
    )
    numbers = ["clash_atom_pairs", "clash_residue_pairs", "backbone_clashes", "contact_residue_pairs"]
    return least.withColumnRenamed("distance", "min_distance").join(most, keys, "left").join(counts, keys, "left").na.fill(0, numbers)


def clash_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number_a, atom_a, number_b, atom_b, overlap_before, overlap_after, change: introduced, worsened, preexisting or resolved clashes.

    before and after: geometry in the same numbering.  A clash is worse if it overlaps by more than SAME more.
    """
    k = [*keys, "number_a", "atom_a", "number_b", "atom_b"]
    a, b = (t.where("clash").groupBy(*k).agg(F.max("overlap").alias(name)) for t, name in ((before, "overlap_before"), (after, "overlap_after")))
    change = (
        F.when(F.col("overlap_before").isNull(), "introduced").when(F.col("overlap_after").isNull(), "resolved")
        .when(F.col("overlap_after") > F.col("overlap_before") + SAME, "worsened").otherwise("preexisting")
    )
    return a.join(b, k, "full_outer").withColumn("change", change)


def changed_clashes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], keys: list[str]) -> DataFrame:
    """What clash_changes says of the clashes of before and after, each the left and the right atoms (keys, number, name, radius, x, y, z).

    Every atom knows its places before and after, so a clash is judged where it is found: after, or before where there is none after.
    Clashes are neither kept nor dealt out anew.
    """
    k = [*keys, "number", "name"]

    def found(these, others):
        sides = (_spread(_listed(t, k, "all").join(_listed(o, k, "other"), k, "left")) for t, o in zip(these, others, strict=True))
        near = near_pairs(*sides, keys, _CLASHING).where(F.col("a.radius") + F.col("b.radius") - F.col("distance") > CLASH)
        best, other = (_best(c, _clashing(CLASH)) for c in ("all", "other"))
        one = F.struct((F.col("a.radius") + F.col("b.radius") - F.col("distance")).alias("here"), _clashing(CLASH)(F.col("a.twin"), F.col("b.twin")).alias("there"))
        many = F.when(_here(best), F.struct(best["value"].alias("here"), other["value"].alias("there")))  # once for all places of two atoms
        names = [F.col(f"{s}.{c}").alias(f"{n}_{s}") for s in "ab" for c, n in (("number", "number"), ("name", "atom"))]
        judged = near.select(*(F.col(f"a.{c}").alias(c) for c in keys), *names, F.when(~(F.col("a.several") | F.col("b.several")), one).otherwise(many).alias("o"))
        # Exploded, as a filter would be taken into the join, which then wouldn't be compiled.
        return judged.select(*judged.columns[:-1], F.explode(F.when(F.col("o").isNotNull(), F.array("o"))).alias("o")).select("*", "o.*").drop("o")

    now, then = found(after, before), found(before, after).where("there IS NULL")
    worse = F.when(F.col("there").isNull(), "introduced").when(F.col("here") > F.col("there") + SAME, "worsened").otherwise("preexisting")
    named = lambda t, a, b, change: t.select(*keys, "number_a", "atom_a", "number_b", "atom_b", F.col(a).alias("overlap_before"), F.col(b).alias("overlap_after"), change.alias("change"))
    return named(now, "there", "here", worse).unionByName(named(then, "here", "there", F.lit("resolved")))


class Overlap:
    """The parts of a comparison of all jobs; each is a DataFrame of its own."""

    def __init__(self, first: DataFrame, second: DataFrame, jobs: DataFrame):
        self.first, self.second, self.jobs = first, second, jobs
        self.pairs = settled(matched(first, second, jobs))
        self.sites = {"a": settled(sites(first, jobs, "a")), "b": settled(sites(second, jobs, "b"))}
        chains = lambda atoms, s: atoms.select("job", "chain").distinct().join(jobs.select("job", F.col(f"shared_{s}").alias("shared")), "job").where("chain <> shared").select("job", F.lit(s).alias("side"), F.col("chain").alias("partner"))
        self.partners = chains(first, "a").unionByName(chains(second, "b"))
        self.members, self.asked = subsets(self.pairs, jobs, self.sites["a"], self.sites["b"], self.partners)
        self.sums = settled(moments(self.pairs, self.members))
        self.fits = settled(fits(self.sums))
        self.whole = self.fits.where(F.col("subset").isin("whole_chain", "matched_segment"))

    def _side(self, atoms: DataFrame, s: str, shared: bool) -> DataFrame:
        t = heavy(atoms).join(self.jobs.select("job", F.col(f"shared_{s}").alias("shared"), F.col(f"start_{s}").alias("start"), "length", F.col("start_a").alias("start_a__")), "job")
        return t.where((F.col("chain") == F.col("shared")) if shared else (F.col("chain") != F.col("shared")))

    def _placed(self, atoms: DataFrame, fit: DataFrame) -> DataFrame:
        """atoms moved by each fit of their job, with its subset."""
        j = atoms.join(fit.where("rotation IS NOT NULL").select("job", "subset", "rotation", "shift"), "job")
        at = moved([F.col(c) for c in "xyz"], F.col("rotation"), F.col("shift"))
        return j.select(*_PLACE, "chain", "number", "name", "radius", *(c.alias(n) for n, c in zip("xyz", at, strict=True)))

    def cross(self, fit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(left, right): the first side's partners and the second side's, moved, for each subset; keys job, subset, chain_a, chain_b."""
        fit = self.whole if fit is None else fit
        left = self._side(self.first, "a", False).join(fit.where("rotation IS NOT NULL").select("job", "subset"), "job").select(*_PLACE, F.col("chain").alias("chain_a"), "number", "name", "radius", "x", "y", "z")
        right = self._placed(self._side(self.second, "b", False), fit).withColumnRenamed("chain", "chain_b")
        chains_a, chains_b = left.select(*_PLACE, "chain_a").distinct(), right.select(*_PLACE, "chain_b").distinct()
        return settled(left.join(chains_b, _PLACE)), settled(right.join(chains_a, _PLACE))

    def cross_summary(self, fit: DataFrame | None = None) -> DataFrame:
        keys = [*_PLACE, "chain_a", "chain_b"]
        left, right = self.cross(fit)
        return settled(summary(left, right, keys))

    def cross_clashes(self, fit: DataFrame | None = None) -> DataFrame:
        """job, subset, clash_atom_pairs between the first side's partners and the second side's, moved, where there are any."""
        moving = self._placed(self._side(self.second, "b", False), self.whole if fit is None else fit)
        return clash_counts(moving, self._side(self.first, "a", False), ["job"], ["subset"])

    def fit_table(self) -> DataFrame:
        """job, subset, matched_CA, fit_RMSD, status for every subset asked for: linear in the matched positions, as no partners meet."""
        own = deviations(self.pairs, self.fits).join(self.members, ["job", "subset", "position"], "left_semi").groupBy(*_PLACE).agg(F.sqrt(F.avg(F.col("deviation") ** 2)).alias("fit_RMSD"))
        j = self.asked.join(self.sums.select(*_PLACE, F.col("n").alias("matched_CA")), _PLACE, "left").join(own, _PLACE, "left").na.fill(0, ["matched_CA"])
        return j.withColumn("status", F.when(F.col("fit_RMSD").isNull(), "insufficient or degenerate coordinates").otherwise("computed"))

    def sensitivity(self) -> DataFrame:
        """job, subset, matched_CA, fit_RMSD, min_partner_distance, clash_atom_pairs, status for every subset asked for."""
        crossed = self.cross_summary(self.fits).groupBy(*_PLACE).agg(F.min("min_distance").alias("min_partner_distance"), F.sum("clash_atom_pairs").alias("clash_atom_pairs"))
        return self.fit_table().join(crossed, _PLACE, "left").select(*_PLACE, "matched_CA", "fit_RMSD", "min_partner_distance", "clash_atom_pairs", "status")

    def exchanged(self) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
        """(before, after), each (shared chain, partners): the second side's partners with their own shared chain, and, moved, with the first's.

        Numbers of the shared chain are those of the first side; residues of the second one beyond the match are numbered as they are, with
        ``b`` for origin.
        """
        shared, partner = self._side(self.second, "b", True), self._side(self.second, "b", False).withColumnRenamed("chain", "chain_b")
        position = F.col("number") - F.col("start") + 1
        inside = position.between(F.lit(1), F.col("length"))
        own = shared.select("job", F.when(inside, "a").otherwise("b").alias("origin"), F.when(inside, position + F.col("start_a__") - 1).otherwise(F.col("number")).alias("number"), "name", "radius", "x", "y", "z")
        new = self._side(self.first, "a", True).select("job", F.lit("a").alias("origin"), "number", "name", "radius", "x", "y", "z")

        def met(left, right):
            chains, origins = right.select("job", "chain_b").distinct(), left.select("job", "origin").distinct()
            return left.join(chains, "job"), right.select("job", "chain_b", "number", "name", "radius", "x", "y", "z").join(origins, "job")

        return met(own, partner), met(new, self._placed(self._side(self.second, "b", False), self.whole).withColumnRenamed("chain", "chain_b"))

    def replaced(self) -> tuple[DataFrame, DataFrame]:
        """(before, after): geometry of what was exchanged."""
        return tuple(geometry(*sides, ["job", "chain_b", "origin"]) for sides in self.exchanged())

    def changes(self) -> DataFrame:
        return changed_clashes(*self.exchanged(), ["job", "chain_b", "origin"])

    def site_table(self) -> DataFrame:
        """job, side, partner, matched_site_CA, observed_site_CA, site_coverage, site_RMSD (under the whole fit)."""
        dev = deviations(self.pairs, self.whole).join(self.pairs.select("job", "position", "number_a", "number_b"), ["job", "position"])
        out = []
        for s in "ab":
            seen = self.sites[s].join(dev.select("job", F.col(f"number_{s}").alias("number"), "deviation"), ["job", "number"], "left").groupBy("job", "partner").agg(
                F.count("deviation").alias("matched_site_CA"), F.count(F.lit(1)).alias("observed_site_CA"), F.sqrt(F.avg(F.col("deviation") ** 2)).alias("site_RMSD")
            )
            out.append(self.partners.where(F.col("side") == s).join(seen, ["job", "partner"], "left"))
        t = reduce(DataFrame.unionByName, out).na.fill(0, ["matched_site_CA", "observed_site_CA"])
        return t.withColumn("site_coverage", F.when(F.col("observed_site_CA") > 0, F.col("matched_site_CA") / F.col("observed_site_CA")))

    def assessment(self) -> DataFrame:
        """job, matched_CA, coverage, CA_RMSD, far_share, cross_clashes, introduced, worsened, alternative_clashes, alignment_warning, status."""
        dev = deviations(self.pairs, self.whole).groupBy("job").agg(F.count(F.lit(1)).alias("matched_CA"), F.sqrt(F.avg(F.col("deviation") ** 2)).alias("CA_RMSD"), F.avg((F.col("deviation") > FAR).cast("int")).alias("far_share"))
        bad_site = (F.coalesce("site_coverage", F.lit(0.0)) < COVERAGE_WARNING) | F.coalesce(F.col("site_RMSD") > SITE_RMSD_WARNING, F.lit(False))
        by_site = self.site_table().groupBy("job").agg(F.count_if(bad_site).alias("bad_sites"))
        every = self.cross_clashes(self.fits).withColumn("whole", F.col("subset").isin("whole_chain", "matched_segment"))
        crossed = every.groupBy("job").agg(F.coalesce(F.sum(F.when(F.col("whole"), F.col("clash_atom_pairs"))), F.lit(0)).alias("cross_clashes"), F.coalesce(F.max("clash_atom_pairs"), F.lit(0)).alias("most"))
        changed = self.changes().where(F.col("change").isin("introduced", "worsened")).groupBy("job").agg(F.count_if(F.col("change") == "introduced").alias("introduced"), F.count_if(F.col("change") == "worsened").alias("worsened"))
        t = self.jobs.select("job", "length", "length_a", "length_b").join(dev, "job").join(by_site, "job", "left").join(crossed, "job", "left").join(changed, "job", "left").na.fill(0, ["bad_sites", "cross_clashes", "most", "introduced", "worsened"])
        t = t.withColumn("coverage", F.col("matched_CA") / F.col("length")).withColumn("alternative_clashes", (F.col("most") > 0) & (F.col("cross_clashes") == 0))
        partial = (F.col("length") != F.col("length_a")) | (F.col("length") != F.col("length_b"))
        t = t.withColumn("alignment_warning", partial | (F.col("coverage") < COVERAGE_WARNING) | (F.col("CA_RMSD") > RMSD_WARNING) | (F.col("far_share") > FAR_SHARE) | (F.col("bad_sites") > 0))
        replaced = (F.col("introduced") > 0) | (F.col("worsened") > 0)
        # The words of the status.
        issues = F.array_compact(
            F.array(
                F.when(F.col("alignment_warning"), "shared-chain alignment requires review"), F.when(F.col("cross_clashes") > 0, "cross-partner clashes detected"), F.when(replaced, "merged shared-chain interface requires refinement"),
                F.when(F.col("alternative_clashes"), "partner clashes detected with alternative alignments"),
            )
        )
        only = replaced & ~F.col("alignment_warning") & (F.col("cross_clashes") == 0) & ~F.col("alternative_clashes")
        status = F.when(only, "WARNING — Partners do not clash; merged shared-chain interface requires refinement").when(F.size(issues) > 0, F.concat(F.lit("WARNING — "), F.array_join(issues, "; "))).otherwise("No detected geometric conflict")
        return t.select("job", "matched_CA", "coverage", "CA_RMSD", "far_share", "cross_clashes", "introduced", "worsened", "alternative_clashes", "alignment_warning", status.alias("status"))
