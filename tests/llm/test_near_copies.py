"""The near-copy stage against brute force: families with borderline members, hot buckets over several batches, edges."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import near_copies

from .test_operators import brute_components, docs_of


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(7))


def replaced(rng, words, at):
    return [word(rng) if k in at else w for k, w in enumerate(words)]


def shingles(words):
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}


def brute(texts):
    sets = [shingles(t.split()) for t in texts]
    return brute_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def found(spark, texts):
    got = near_copies.classified(docs_of(spark, list(enumerate(texts)))).collect()
    return {r.doc_id: r.component_id for r in got}


def test_borderline_member_of_a_family_keeps_its_only_link(spark):
    rng = random.Random(1)
    y = [word(rng) for _ in range(1000)]
    x = [word(rng) for _ in range(110)] + y[110:]
    copies = [replaced(rng, y, {rng.randrange(200, 1000)}) for _ in range(300)]
    texts = [" ".join(t) for t in (x, y, *copies)]
    assert len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))
    assert all(len(shingles(x) & shingles(c)) < 0.8 * len(shingles(x) | shingles(c)) for c in copies)
    assert found(spark, texts) == {i: 0 for i in range(302)}


def test_families_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_NODES", 20)
    rng, texts = random.Random(2), []
    for _ in range(3):  # members lie about 0.75 to 0.85 from one another: many components in one family
        base = [word(rng) for _ in range(200)]
        texts += [" ".join(replaced(rng, base, set(range(at, at + rng.randrange(8, 14))))) for at in (rng.randrange(0, 186) for _ in range(70))]
    texts += [" ".join(word(rng) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    label = brute(texts)
    assert len({label[k] for k in range(210)}) > 3
    assert found(spark, texts) == label


def test_sets_alike_equal_brute_force(monkeypatch):
    monkeypatch.setattr(near_copies, "_WIDE", 7)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 40, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(0, 30))) for _ in range(40)] + [np.zeros(0, dtype=np.uint64)]
    got = near_copies.alike(sets[:20], sets[20:], 0.8)
    for i, j in itertools.product(range(20), range(21)):
        both = len(np.intersect1d(sets[i], sets[20 + j]))
        assert got[i, j] == (both > 0 and both >= 0.8 * (len(sets[i]) + len(sets[20 + j]) - both))


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_buckets_meet_alike_however_batches_fall(size):
    rng = np.random.default_rng(4)
    key = np.sort(np.concatenate([np.repeat(np.arange(30), rng.integers(1, 12, 30)), np.full(100, 31), np.full(9, 32)]))
    nh = np.arange(len(key)) * 5
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(nh[i : i + size])], names=["key", "nh"]) for i in range(0, len(key), size)]
    rows = [r for b in near_copies._meet(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    pairs = {frozenset(r[1:]) for r in rows if r[1] is not None}
    want = set()
    for k in set(key.tolist()):
        m = nh[key == k].tolist()
        if len(m) <= near_copies.SMALL:
            want |= {frozenset(p) for p in itertools.combinations(m, 2)}
        else:
            want |= {frozenset((p, x)) for p in m[: near_copies.PIVOTS] for x in m if x != p}
    assert {p for p in pairs if len(p) == 2} == want
    heads = sorted((r[0], r[2]) for r in rows if r[1] is None)
    firsts = sorted((k, x) for k in set(key.tolist()) for x in nh[key == k][: near_copies.SMALL + 1].tolist())
    assert set(firsts) - {f for f in firsts if f[0] in (31, 32)} <= set(heads) and {k for k, _ in heads} == {k for k, _ in firsts}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one  two"), (5, "one three"), (1, None), (7, "x " * 30_000)]
    df = docs_of(spark, rows)
    assert {(r.doc_id, r.component_id) for r in near_copies.classified(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (7, 7)}
    kept = near_copies.keep_representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7]
    assert near_copies.classified(docs_of(spark, [])).count() == 0
