"""Steps whose work must grow with their input, and results that large tables brought to light."""

import random
import time

from pyspark.sql import functions as F

from quern.functions import sequences
from quern.operators import genomics as G


def seconds(df) -> float:
    begun = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - begun


def test_anchored_candidates_look_at_the_asked_places_only(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", "".join(rng.choices("AMK", k=60)), "".join(rng.choices("MAL", k=4 * (i % 2))), 1 + i) for i in range(40)]
    t = spark.createDataFrame([*rows, ("none", None, "MM", 3)], "protein string, sequence string, tail string, anchor int")
    for first, last in ((15, -20), (-3, -1), (2, 4), (0, 3), (-2, 0)):
        want = set()
        for p, s, tail, anchor in rows:
            x, a = tail + s, len(tail) + anchor
            for at in range(1, len(x) + 1):
                rel = at - a + 1 if at >= a else at - a
                if x[at - 1] == "M" and min(first, last) <= rel <= max(first, last):
                    want.add((p, rel, x[at - 1 :]))
        assert {tuple(r) for r in G.anchored_candidates(t, first, last).select("protein", "anchor_start", "sequence").collect()} == want
    long = spark.range(4).select(F.concat(F.lit("p"), "id").alias("protein"), F.repeat(F.lit("AKML"), 100_000).alias("sequence"), F.lit("MK").alias("tail"), F.lit(30).alias("anchor"))
    assert seconds(G.anchored_candidates(long, 15, -20)) < 15  # minutes when every place of the text was cut out


def test_contacts_follow_the_single_precision_of_the_sql(spark, tmp_path):
    import duckdb

    from quern.plans import registry

    # 20 times the coordinates, in single precision, lie 253.50000088 thousandths apart, in double precision 253.49999903.
    rows = [(0, [0.0, 0.0, 0.0], 0), (1, [-0.0027961009182035923, -0.0096583291888237, -0.0077171316370368], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("j10_contacts", "a13_contact_statistics"):
        got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
        assert got == con.execute(registry.ORACLE_SQL[name]).fetchall(), name


def test_codons_are_read_in_one_pass(spark):
    texts = ["", "AT", "ATG", "atgTAAx", "AUGNNNTGA\n", "ATGé\U0001f600A"]
    t = spark.createDataFrame([(i, s) for i, s in enumerate([*texts, None])], "k int, s string")
    got = {r["k"]: r["p"] for r in t.select("k", sequences.translate_codons(F.col("s")).alias("p")).collect()}
    assert [got[i] for i in range(7)] == ["", "", "M", "M*", "MX*", "MX", ""]
    long = spark.range(4).select(F.repeat(F.lit("ATGTAA"), 100_000).alias("s"))
    assert seconds(long.select(sequences.translate_codons(F.col("s")))) < 15  # minutes when each codon was cut out by its place


def test_contigs_are_cut_in_one_pass(spark):
    from quern.operators.contigs import Contigs

    t = spark.createDataFrame([("a", "ACGT\nACé\U0001f600T"), ("b", ""), ("c", None)], "id string, sequence string")
    assert {tuple(r) for r in Contigs.of(t, 4).chunks.collect()} == {("a", 0, "ACGT"), ("a", 1, "\nACé"), ("a", 2, "\U0001f600T")}
    long = spark.range(4).select("id", F.repeat(F.lit("ACGT"), 500_000).alias("sequence"))
    assert seconds(Contigs.of(long, 100).chunks) < 15  # each of 20,000 chunks was cut from the start of 2 million bases


def test_window_means_are_taken_in_whole_arrays(spark):
    from quern import channels

    rng = random.Random(3)
    texts = [None, "", "K", "ST", "aSé\U0001f600K", "".join(rng.choices("STKRDEAC", k=200))]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, sequence string")
    scale = {"S": 0.1, "T": 0.7, "K": -1.3}
    for radius in (0, 1, 4, 300):
        want = []
        for s in texts:
            v = [scale.get(c, 0.0) for c in s or ""]
            want.append([sum(w := v[max(0, i - radius) : i + radius + 1]) / len(w) for i in range(len(v))])
        got = [r["v"] for r in t.select("k", channels.Scale("x", radius, tuple(scale.items())).values(F.col("sequence")).alias("v")).orderBy("k").collect()]
        assert [[round(x, 12) for x in r] for r in got] == [[round(x, 12) for x in r] for r in want], radius
    each = spark.range(8).select(F.repeat(F.lit("STKRAC"), 100_000).alias("sequence"))
    assert seconds(each.select(channels.Composition("st", 40, "ST").values(F.col("sequence")))) < 25  # 80 values a place, one by one, took longer


def test_open_starts_keep_bases_where_they_lie(spark):
    rng = random.Random(4)
    texts = ["", "A", "N" * 30, "".join(rng.choices("ACGTNn", k=90)), "ACGé\U0001f600T" * 9, "A" * 41]
    t = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(texts)], "id string, sequence string")
    for window, most, chunk in ((10, 0.1, 7), (3, 0.4, 16), (1, 0.0, 5), (12, 0.25, 4)):
        want = set()
        for i, s in enumerate(texts):
            good = [sum(c in "Nn" for c in s[k : k + window]) / window <= most for k in range(max(len(s) - window + 1, 0))]
            for k, g in enumerate(good):
                if g and (k == 0 or not good[k - 1]):
                    want.add((f"c{i}", k, next((j for j in range(k, len(good)) if not good[j]), len(good)) - 1))
        got = G.open_starts(t, window, most, chunk)
        assert {tuple(r) for r in got.select("id", "first", "last").collect()} == want, (window, most, chunk)
    assert "split(" not in got._jdf.queryExecution().toString()  # no row a base


def test_draws_in_one_bin_are_swept(spark):
    n = 60_000
    ones = spark.range(n).select(F.lit("a").alias("id"), (F.col("id") * 2).alias("first"), (F.col("id") * 2).alias("last"), F.col("id").alias("before"))
    rest = spark.range(1).select(F.lit("b").alias("id"), F.lit(0).cast("long").alias("first"), F.lit(2_000_000_000).cast("long").alias("last"), F.lit(n).cast("long").alias("before"))
    draws = spark.range(n).select(F.col("id").alias("nth"), F.col("id").alias("k")).union(spark.sql("SELECT -1L, 2000060001L")).union(spark.sql("SELECT -2L, 2000060000L"))
    begun = time.monotonic()
    got = {r["nth"]: (r["id"], r["start"]) for r in G.starts_at(ones.union(rest), draws, n + 2_000_000_001).collect()}
    assert got == {i: ("a", 2 * i) for i in range(n)} | {-2: ("b", 2_000_000_000)}
    assert time.monotonic() - begun < 25  # 3.6 billion comparisons before


def test_interactions_are_counted_without_doubling_rows(spark):
    from quern.structure import contacts

    rows = [("m", "A", "B", 1, 2, a, b, d, kind) for kind in ("hydrogen_bond", "steric") for a, b, d in (("N", "O", 3.0), ("N", "OG", 2.5), ("N", "O", 2.9))] + [("m", "A", "B", 1, 3, "N", None, 3.4, "steric")]
    t = spark.createDataFrame(rows, "model string, chain_a string, chain_b string, number_a int, number_b int, atom_a string, atom_b string, distance double, kind string")
    got = contacts.interaction_counts(t)
    assert {tuple(r) for r in got.collect()} == {("m", "A", "B", "hydrogen_bond", 2, 2.5), ("m", "A", "B", "steric", 2, 2.5)}
    assert "Expand" not in got._jdf.queryExecution().toString()


def test_interface_scores_read_contacts_that_are_settled(spark):
    from quern.plans import registry

    got = registry.QUERIES["g30_interface_score"](spark, "/root/testdata/sf0.001")
    assert "embedding" not in got._jdf.queryExecution().toString()  # contacts were found anew for each join
