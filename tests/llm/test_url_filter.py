"""Glob sets in blocks against regular expressions, and many rules in bounded memory."""

import random
import re
import resource
import time

import numpy as np

from quern.llm import url_filter


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"xx" + b"".join(raw), dtype=np.uint8), 2 + np.cumsum([0, *map(len, raw)])


def test_blocks_equal_regular_expressions(monkeypatch):
    monkeypatch.setattr(url_filter, "WORDS", 1)
    monkeypatch.setattr(url_filter, "KEPT", 3)
    rng = random.Random(6)
    piece = lambda: rng.choice(["abcd", "bcda", "xyzz", "a", "/", "é", ".com/", "abcd", "q", "*", "**", "?"])
    globs = ["".join(piece() for _ in range(rng.randrange(1, 6))) for _ in range(300)] + ["long" * 40 + "*"]
    globs = [g for g in globs if "?" not in g or "é" not in g]  # ? stands for a byte
    ranks = [rng.randrange(400) for _ in globs]
    texts = ["".join(rng.choice(["abcd", "bcda", "xyzz", "a", "/", ".com/", "q"]) for _ in range(rng.randrange(0, 6))) for _ in range(400)] + ["", "long" * 40, "abc", "bcd"]
    texts += [t.replace("q", "é") for t in texts[:50]]

    def fits(g, t):
        out, i = "", 0
        while i < len(g):
            out += ".*" if g.startswith("**", i) else {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i]))
            i += 2 if g.startswith("**", i) else 1
        return re.fullmatch(out.encode(), t.encode(), re.DOTALL) is not None

    bare = {"*", "**", "***", "****"}  # these fit nearly everything
    some = [k for k, g in enumerate(globs) if g not in bare]
    got = url_filter.GlobSet([globs[k] for k in some], [ranks[k] for k in some]).best(*packed(texts))
    want = [min((ranks[k] for k in some if fits(globs[k], t)), default=-1) for t in texts]
    assert got.tolist() == want and len(set(want)) > 5


def test_a_hundred_thousand_rules_in_bounded_memory():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rules = [url_filter.Rule("block", f"{word(rng.randrange(5, 12))}.{rng.choice(['com', 'net', 'org'])}", f"/{word(3)}/") for _ in range(100_000)]
    ranked = sorted(rules, key=lambda r: (-len(r.text.encode()), r.text))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    globs = url_filter.GlobSet([g for r in ranked for g in r.globs()], [k for k, r in enumerate(ranked) for _ in r.globs()])
    some = rng.sample(range(100_000), 300)
    texts = [f"{rng.choice(['', 'www.', 'a.b.'])}{ranked[k].host}{ranked[k].path}{word(6)}" for k in some] + [f"{word(9)}.com/{word(3)}/{word(8)}" for _ in range(1700)]
    began = time.time()
    got = globs.best(*packed(texts))
    took = time.time() - began
    by_place = {}
    for k, r in enumerate(ranked):
        by_place.setdefault(r.text, k)

    def want(t):
        host, _, path = t.partition("/")
        labels, first = host.split("."), path.split("/")[0]
        found = [by_place.get(f"{'.'.join(labels[i:])}/{first}/", -1) for i in range(len(labels))]
        return min((k for k in found if k >= 0), default=-1)

    assert got.tolist() == [want(t) for t in texts] and (got[:300] >= 0).all()
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 600 and took < 60  # MB, seconds
