"""Searches in rounds give what comparing all pairs gives, also with slices so thin that many rounds are needed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.structure import contacts, surroundings


@pytest.fixture(params=[(16, 512, 4096), (1, 3, 2)])
def slices(request, monkeypatch):
    for name, value in zip(("FIRST", "ASKED", "MET"), request.param, strict=True):
        monkeypatch.setattr(surroundings, name, value)


def points(spark, n, spread, seed):
    at = np.random.default_rng(seed).normal(0, spread, (n, 3))
    at[:2] += 900  # far from everything but each other
    rows = [("m", f"C{i % 3}", i % 3, i // 12, "CA" if i % 12 < 3 else "X", i, "CNOS"[i % 4], float(i % 90), *map(float, p)) for i, p in enumerate(at)]
    return spark.createDataFrame(rows, "model string, chain string, place int, number long, name string, ord long, element string, plddt double, x double, y double, z double")


def test_touched_residues_equal_those_of_all_pairs(spark, slices):
    atoms = points(spark, 240, 6.0, 1)
    own, listed = contacts.touched(atoms, 6.0)
    pairs = contacts.early_contacts(atoms, 6.0).collect()
    assert 0 < len(pairs) and {(r.chain, r.number) for r in own.collect()} == {(r.chain_a, r.number_a) for r in pairs}
    assert {(r.chain_a, r.chain_b, r.number_b) for r in listed.collect()} == {(r.chain_a, r.chain_b, r.number_b) for r in pairs}


def test_legacy_scores_of_chains_that_touch_nothing(spark):
    atoms = points(spark, 48, 1.0, 2).withColumn("x", F.col("x") + 500 * F.col("place"))
    got = contacts.legacy_scores(atoms, 6.0).collect()
    assert len(got) == 3 and all(r.n_residues == 0 and r.interface_plddt == 0 for r in got)


@pytest.mark.parametrize("n_points", [24, 130])
def test_burial_equals_every_point_against_every_atom(spark, slices, n_points):
    atoms = points(spark, 90, 3.0, 3).withColumn("number", F.floor(F.col("ord") / 8))
    rows = [r.asDict() for r in atoms.collect()]
    for r in rows:
        r["r"] = contacts.RADII[r["element"]] + contacts.PROBE
    sphere, want = contacts._sphere(n_points), {}
    hides = lambda q, b: sum((b[c] - v) ** 2 for c, v in zip("xyz", q, strict=True)) < b["r"] ** 2
    for a in rows:
        q = [[a[c] + p * a["r"] for c, p in zip("xyz", s, strict=True)] for s in sphere]
        free = [p for p in q if not any(hides(p, b) for b in rows if b["chain"] == a["chain"] and b is not a)]
        for other in {"C0", "C1", "C2"} - {a["chain"]}:
            hid = sum(any(hides(p, b) for b in rows if b["chain"] == other) for p in free)
            sums = want.setdefault((*sorted((a["chain"], other)), a["chain"], a["number"]), [0.0, 0.0, 0.0])
            area = 4 * np.pi / n_points * a["r"] ** 2
            for k, v in enumerate((len(free), hid, hid * (a["element"] in "CS"))):
                sums[k] += area * v
    got = {(r.chain_a, r.chain_b, r.chain, r.number): (r.sasa_isolated, r.buried_area, r.buried_nonpolar_area) for r in contacts.burial(atoms.withColumn("name", F.col("ord").cast("string")), points=n_points).collect()}
    assert got.keys() == want.keys() and any(v[1] > 0 for v in want.values())
    assert all(np.allclose(got[k], want[k]) for k in want)
