"""Helices are judged without joins: a table of residues that Spark takes to be small was sent whole to every executor."""

import pytest

from quern.plans import registry
from quern.structure import helices

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g42_helices", "g42_kinks"])
def test_no_residues_are_joined(spark, name):
    assert "Join" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_segments_go_on_over_batches(spark):
    rows = [("m", chain, i, None if i == 31 else "H" if i % 12 else "T", float(i), float(i * i % 7), float(i % 5)) for chain in ("A", "B", None) for i in range(1, 60) if i not in (40, 52)]
    schema = "model string, chain string, number int, code string, x double, y double, z double"
    t = spark.createDataFrame(rows, schema)
    want = sorted(map(str, helices.normalized(t, 2).collect())), sorted(map(str, helices.judged_kinks(t, 2).collect()))
    assert len(want[0]) > 20 and len(want[1]) > 3
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for n in (1, 3, 7):
            spark.conf.set(key, n)
            assert (sorted(map(str, helices.normalized(t, 2).collect())), sorted(map(str, helices.judged_kinks(t, 2).collect()))) == want, n
    finally:
        spark.conf.set(key, old)
