"""Changes and counts of pairs that are judged where a pair is found, against the same from the pairs themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.structure import contacts, overlap


def residues(spark, seed, drop):
    at = np.random.default_rng(seed).normal(0, 6, (60, 3))
    rows = [("m", f"C{i % 3}", i, i, 50.0, *map(float, p)) for i, p in enumerate(at) if i % 10 != drop]
    return spark.createDataFrame(rows, "model string, chain string, number int, token_index int, plddt double, x double, y double, z double")


def test_changed_contacts_equal_those_of_the_contacts(spark):
    before, after = residues(spark, 1, 3), residues(spark, 1, 7).withColumn("x", F.col("x") + F.col("number") % 4)
    want = contacts.contact_changes(contacts.contacts(before, 5.0).where("number_a % 3 > 0"), contacts.contacts(after, 6.0).where("number_b % 5 > 0"))
    got = contacts.changed_contacts(before, after, (5.0, 6.0), (F.expr("a.number % 3 > 0"), F.expr("b.number % 5 > 0")))
    assert {r.change for r in got.collect()} == {"lost", "kept", "gained"}
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan  # contacts aren't gathered in memory


def complexes(spark):
    rng = np.random.default_rng(5)
    s, p, q, u = (rng.normal(0, 4, (n, 3)) for n in (14, 30, 24, 36))
    rows = lambda chain, at, per, name: [("j", chain, i // per + 1, name or "NXC"[i % 3], "CNOS"[i % 4], 90.0, *map(float, v)) for i, v in enumerate(at)]
    schema = "job string, chain string, number int, name string, element string, plddt double, x double, y double, z double"
    first = spark.createDataFrame(rows("S", s, 1, "CA") + rows("P", p, 3, "") + rows("Q", q, 1, ""), schema).withColumn("element", F.when(F.col("chain") == "S", "C").otherwise(F.col("element")))
    second = spark.createDataFrame(rows("T", s + rng.normal(0, 0.3, s.shape), 1, "CA") + rows("U", u, 3, ""), schema).withColumn("element", F.when(F.col("chain") == "T", "C").otherwise(F.col("element")))
    jobs = spark.createDataFrame([("j", "S", "T", 1, 1, 14, 14, 14, True)], "job string, shared_a string, shared_b string, start_a int, start_b int, length int, length_a int, length_b int, known boolean")
    return overlap.Overlap(first, second, jobs)


def test_fits_do_not_lay_partners_over_each_other(spark, monkeypatch):
    o = complexes(spark)
    want = o.sensitivity()
    monkeypatch.setattr(overlap.Overlap, "cross_summary", lambda *a: pytest.fail("partners were compared"))
    got = o.fit_table()
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def places(spark, seed, shift=0.0):
    """Atoms of two sides in residues of four; some atoms have several places, one number and one name are null."""
    rng = np.random.default_rng(seed)
    schema = "job string, number int, name string, radius double, x double, y double, z double"

    def side(n):
        rows = [("j" if i % 5 else "k", i // 4, "NXC"[i % 3], (1.7, 1.55, 1.8)[i % 3], *map(float, p)) for i, p in enumerate(rng.normal(0, 4, (n, 3)))]
        rows += [(*r[:4], r[4] + 0.5 * d, r[5] - d, r[6]) for r in rows[::6] for d in (0.4, 1.1)]
        rows += [("j", None, "N", 1.7, 0.1, 0.2, shift), ("j", 900, None, 1.7, 0.3, 0.1, shift), ("j", 901, "N", 1.7, float("nan"), 0.0, 0.0)]
        return spark.createDataFrame([(*r[:6], r[6] + shift) for r in rows], schema)

    return side(48), side(60)


def test_changed_clashes_equal_those_of_the_clashes(spark):
    before, after = places(spark, 7), places(spark, 7, 0.0)
    after = after[0].where("number % 7 <> 2 OR number IS NULL"), after[1].withColumn("z", F.when(F.col("number") % 4 == 1, F.col("z")).otherwise(F.col("z") + 0.6))
    want = overlap.clash_changes(*(overlap.geometry(*t, ["job"]) for t in (before, after)), ["job"])
    got = overlap.changed_clashes(before, after, ["job"])
    assert {r.change for r in got.collect()} == {"introduced", "worsened", "preexisting", "resolved"}
    plain = lambda d: sorted([str(round(v, 9) if isinstance(v, float) else v) for v in r] for r in d.select(want.columns).collect())
    assert plain(got) == plain(want)


def test_summary_counts_pairs_of_residues_once(spark):
    left, right = places(spark, 8)
    got = {r.job: r for r in overlap.summary(left, right, ["job"]).collect()}
    a, b = ([r for r in t.collect() if r.x == r.x] for t in (left, right))
    for job in "jk":
        d = [(p, q, float(np.linalg.norm(np.subtract(p[4:7], q[4:7])))) for p in a for q in b if p.job == q.job == job]
        clashes, touches = [(p, q) for p, q, v in d if p.radius + q.radius - v > overlap.CLASH], [(p, q) for p, q, v in d if v <= overlap.CONTACT]
        main = [(p, q) for p, q in clashes if p.name in contacts.BACKBONE and q.name in contacts.BACKBONE]
        residues = lambda pairs: len({(p.number, q.number) for p, q in pairs})
        want = (len(clashes), residues(clashes), len(main), residues(touches))
        assert job == "k" or (residues(clashes) < len(clashes) and residues(touches) < len(touches))
        r = got[job]
        assert (r.clash_atom_pairs, r.clash_residue_pairs, r.backbone_clashes, r.contact_residue_pairs) == want
        assert np.isclose(r.min_distance, min(v for *_, v in d)) and np.isclose(r.max_overlap, max(p.radius + q.radius - v for p, q, v in d))


def test_assessment_does_not_gather_pairs(spark, monkeypatch):
    o = complexes(spark)
    every, changes = o.sensitivity(), overlap.clash_changes(*o.replaced(), ["job", "chain_b", "origin"])
    crossed = every.where("subset = 'whole_chain'").first().clash_atom_pairs
    assert crossed > 0 and sorted((r.subset, r.clash_atom_pairs) for r in every.collect() if r.clash_atom_pairs) == sorted((r.subset, r.clash_atom_pairs) for r in o.cross_clashes(o.fits).collect())
    want = {k: changes.where(F.col("change") == k).count() for k in ("introduced", "worsened")}
    for name in ("geometry", "clash_changes", "summary"):
        monkeypatch.setattr(overlap, name, lambda *a: pytest.fail("pairs were gathered"))
    got = o.assessment().first()
    assert (got.cross_clashes, got.introduced, got.worsened) == (crossed, want["introduced"], want["worsened"])
    assert want["introduced"] > 0 and want["worsened"] > 0


def test_sites_take_the_first_partner_found_and_gather_no_pairs(spark):
    left, right = places(spark, 9)
    atoms = left.withColumn("chain", F.lit("S")).withColumn("name", F.lit("CA")).unionByName(right.withColumn("chain", F.when(F.col("number") % 2 == 0, "P").otherwise("Q"))).where("x = x AND chain IS NOT NULL").withColumn("element", F.lit("C"))
    jobs = spark.createDataFrame([("j", "S"), ("k", "S")], "job string, shared_a string")
    got = overlap.sites(atoms, jobs, "a", 3.0)
    rows = atoms.collect()
    near = lambda p, q: sum((p[c] - q[c]) ** 2 for c in "xyz") <= 9.0
    want = {(p.job, q.chain, p.number) for p in rows if p.chain == "S" for q in rows if q.chain != "S" and p.job == q.job and near(p, q)}
    assert 0 < len(want) and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
