"""What a channel holds of many or long texts is bounded: an array of all windows of 10,000 texts was built at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import channels
from quern.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_moments_leave_the_kernel(spark):
    df = registry.QUERIES["f3_channels"](spark, SF)
    assert "moments(" in plan(df) and "means(" not in plan(df)


def test_moments_agree_with_values(spark):
    rng = random.Random(7)
    texts = [None, "", "K", "ST", "".join(rng.choices("STKRDEAC", k=200)), "aSé\U0001f600K"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, sequence string")
    s = F.col("sequence")
    for c in (channels.Composition("st", 4, "ST"), channels.net_charge("q", 2), channels.Entropy("e", 2), channels.Dipeptide("d", 3, "ST")):
        for r in t.select(c.values(s).alias("v"), c.moments(s).alias("m")).collect():
            v = r.v or []
            mean = sum(v) / len(v) if v else 0
            assert r.m.n == len(v) and (r.m.top == max(v) if v else r.m.top is None)
            assert math.isclose(r.m.total or 0, sum(v), abs_tol=1e-9) and math.isclose(r.m.spread or 0, sum((x - mean) ** 2 for x in v), abs_tol=1e-9)


def test_pieces_of_a_text_see_their_neighbours(monkeypatch):
    table = channels._lookup({"S": 1.0, "T": 0.5}, 0.0)
    text = "".join(random.Random(8).choices("STA", k=100))
    want = np.concatenate(list(channels._mean_pieces(text, 6, table)))
    for step in (1, 5, 99):
        monkeypatch.setattr(channels, "STEP", step)
        got = list(channels._mean_pieces(text, 6, table))
        assert len(got) == -(-100 // step) and np.array_equal(np.concatenate(got), want)


@pytest.mark.parametrize("name", ["f3_backgrounds"])
def test_backgrounds_explode_no_residues(spark, name):
    assert "arrays_zip" not in plan(registry.QUERIES[name](spark, SF))
