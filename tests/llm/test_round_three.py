"""Divergence audit, Merkle manifest and token files against brute force and round trips."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import divergence, merkle, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, rank int, value string, digest string"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source); further columns clash with names the operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "v", "d") for r in rows], DOCS)


# Divergence.
def brute_audit(rows, least):
    docs = [("" if lang is None else lang, "" if source is None else source, re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or "")) for _, text, lang, source in rows]
    docs = [(lang, source, ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in terms]) for lang, source, terms in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, terms in mine for t in set(terms))
        kept = [t for t, n in seen.items() if n >= least]
        count = defaultdict(Counter)
        for _, source, terms in mine:
            count[source].update(t for t in terms if t in set(kept))
            count[None].update(t for t in terms if t in set(kept))

        def p(unit, t, count=count, kept=kept):
            return 1 + 10**9 * (count[unit][t] + 2) // (sum(count[unit].values()) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        sources = {d[1] for d in mine}
        for s in sources:
            pairs = [(sum(f(p(s, t), p(o, t)) for t in kept), o) for o in sources if o != s]
            terms = [(f(p(s, t), p(None, t)), t) for t in kept if count[s][t] and p(s, t) > p(None, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcDEfé中") for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    rows = [(i, rng.choice([" ", ", ", "7", "\n"]).join(rng.choice(pool[: 80 if i % 3 else 25]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é"])) for i in range(150)]
    rows += [(900, None, "en", "quiet"), (901, "", "xx", "alone"), (902, "one two", "yy", "u"), (903, "one two", "yy", "w"), (None, "one", None, None)]
    return rows + rows[:5] + [(904, "long " * 20_000 + "Z" * 5000, "en", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "MOST_TERMS", 50)
    rows = audit_rows(seed)
    got = sorted(tuple(r) for r in divergence.audit(docs_of(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows, 10)
    assert divergence.audit(docs_of(spark, [])).count() == 0


def test_radix_selection_equals_sorting(spark):
    rng = random.Random(5)
    rows = [("g", rng.randrange(2**30), f"w{i}") for i in range(300)] + [("ties", 7, f"{rng.choice(['same prefix ', 'é', ''])}{i:05d}") for i in range(400)] + [("few", 2**30 - 1, "only"), ("zero", 0, "b"), ("zero", 0, "a")]
    rows += [("two", v, f"x{i}") for i, v in enumerate([5] * 3 + [9] * 4 + [1] * 50)]
    got = divergence.top(spark.createDataFrame(rows, "g string, v long, item string"), ["g"], "v", "item", 10, last_bin=20)
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, v, t, k) for k, (v, t) in enumerate(sorted(((v, t) for x, v, t in rows if x == g), key=lambda x: (-x[0], x[1].encode()))[:10], 1)}
    assert {(r.g, r.v, r.item, r["rank"]) for r in got.collect()} == want
    all_ranks = divergence.ranks(spark.createDataFrame(rows, "g string, v long, item string"), ["g"], "v", "item")
    for g in {r[0] for r in rows}:
        mine = sorted(((v, t) for x, v, t in rows if x == g), key=lambda x: (-x[0], x[1].encode()))
        assert [(r.v, r.item) for r in all_ranks.where(F.col("g") == g).orderBy("rank").collect()] == mine


def test_shares_are_exact_beyond_longs(spark):
    c, n, v = 10**13, 3 * 10**13 + 1, 10**6
    got = spark.range(1).select(divergence.share(F.lit(c), F.lit(n), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (c + 2) // (n + 2 * v)


# Manifest.
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def leaf(i, source, lang, n, text):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))

    def climb(nodes):
        """The last node, and for each first one its siblings level by level as (left, right)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
                paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
                at[k] = i // 8
            nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        return nodes[0], paths

    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    each = [(i, lang, leaf(i, source, lang, len(text or ""), text), leaf(i, source, lang, len(text or ""), text if text is None else low(text))) for i, text, lang, source in rows]
    langs = sorted({e[1] for e in each}, key=lambda x: (x is not None, (x or "").encode()))
    sub = {lang: climb([e[2] for e in sorted((e for e in each if e[1] == lang), key=lambda e: (e[0] is not None, e[0] or 0, e[2]))]) for lang in langs}
    root, over = climb([sub[lang][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        for e, path in zip(sorted((e for e in each if e[1] == lang), key=lambda e: (e[0] is not None, e[0] or 0, e[2])), sub[lang][1], strict=True):
            node = e[3] if e[0] is not None and zlib.crc32(str(e[0]).encode()) % 3 == 0 else e[2]
            steps = path + over[n]
            for left, right in steps:
                node = h(*left, node, *right)
            out.append((e[0], e[2], sub[lang][0], root, h(*(x for left, right in steps for x in left + right)), node, node == root))
    return sorted(out, key=str)


def manifest_rows(n, seed=1):
    rng = random.Random(seed)
    rows = [(i * 7 - 20, rng.choice([None, "", "Ab", "xyz é", "T" * 3000]), rng.choice(["en"] * 5 + ["fr", None, "é", ""]), rng.choice(["a", None])) for i in range(n)]
    return rows + ([(None, "null id", "en", "a"), (None, "null id", None, "a"), rows[0], rows[0], (rows[0][0], "other", rows[0][2], "b"), (10**12, "lone", "solo", "a")] if n else [])


@pytest.mark.parametrize(("n", "levels"), [(0, 4), (1, 4), (90, 4), (700, 1), (300, 2)])
def test_manifest_equals_brute_force(spark, n, levels):
    rows = manifest_rows(n)
    docs = docs_of(spark, rows)
    got = merkle.manifest(docs, received=merkle.tampered_leaf(), levels=levels)
    assert sorted((tuple(r) for r in got.collect()), key=str) == (brute_manifest(rows) if rows else [])


def test_proofs_lead_to_the_root(spark):
    got = merkle.manifest(docs_of(spark, manifest_rows(150)), proofs=True, levels=1)
    checked = got.select(merkle.fold(F.col("leaf"), F.col("proof")).alias("at"), "root", "verified", "proof_sha256", F.sha2(F.array_join(F.transform("proof", lambda s: s.others), "").cast("binary"), 256).alias("sum"))
    assert all(r.at == r.root and r.verified and r.sum == r.proof_sha256 for r in checked.collect())


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 200, 512])
def test_traversal_holds_one_run_a_level(n):
    leaves = [str(i).encode() for i in range(n)]
    height = merkle.height_of(n)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    assert merkle.block_root(leaves, height) == levels[-1][0]
    for i, path in enumerate(merkle.traverse(leaves, height)):
        assert path == [(i // 8**k % 8, levels[k][i // 8 ** (k + 1) * 8 : i // 8 ** (k + 1) * 8 + 8]) for k in range(height)]


# Token files.
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def token_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéüßñABC") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ",", ".", "'s", "...", "!?", "’", "#1", "-x"])
    rows = [(i * 5 - 30, " ".join(word() for _ in range(rng.randrange(0, 200))), "en", "a") for i in range(60)]
    rows += [(1000, None, None, None), (1001, "", "en", "a"), (1002, "say <|endoftext|> and <|STARTOFTEXT|>", "en", "a"), (None, "null id", "en", "a"), (None, None, "en", "a"), (3, "twice", "en", "a"), (3, "twice", "en", "a"), (3, "other", "en", "a")]
    return rows + [(2000, "again and again " * 20_000, "en", "a"), (2001, "é ﬁ İ Σς  x　y ½. café́. ́a", "en", "a")]


def test_token_files_read_back_what_the_tokenizer_gives(spark, model, tmp_path):
    rows = token_rows()
    path = str(tmp_path / "ids")
    token_files.write(docs_of(spark, rows), path, P.path("word_bpe_49k.json"), section=1000)
    got = token_files.read(spark, path).collect()
    ids = {k: [*model.encode(t or "", add_special_tokens=False).ids, 1] for k, (_, t, *_) in enumerate(rows)}
    key = lambda i: (i is not None, i or 0)
    ordered = sorted(got, key=lambda r: r.start)
    assert [key(r.doc_id) for r in ordered] == sorted(key(r[0]) for r in rows)
    start = 0
    for r in ordered:
        assert r.start == start
        start += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((rows[k][0], len(x), crc(x)) for k, x in ids.items())
    # Any range of ids, over borders of sections and frames.
    at = {r.doc_id: r for r in ordered if r.doc_id == 2000}[2000]
    whole = ids[next(k for k, r in enumerate(rows) if r[0] == 2000)]
    for lo, n in ((0, 5), (995, 2010), (at.n_tokens - 3, 3)):
        part = token_files.tokens(spark, path, at.start + lo, n).orderBy("position").collect()
        assert [r.position for r in part] == list(range(at.start + lo, at.start + lo + n)) and [r.id for r in part] == whole[lo : lo + n]
    assert token_files.token_files(docs_of(spark, []), P.path("word_bpe_49k.json"), str(tmp_path / "none")).count() == 0


def test_words_encode_like_whole_texts(model):
    encode, rng = token_files.Encoder(P.path("word_bpe_49k.json"), most=50), random.Random(7)
    marks = "abzÀÖØöøÿß×÷é.,;:!?'\"- \n\t\v\x1c ́가中½²_<>|0Σİﬁ"
    for _ in range(400):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(0, 40)))
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encode.known) <= 50


@pytest.mark.parametrize("name", ["text", "equal", "pairs", "random", "empty", "one"])
def test_grammars_expand_to_their_ids(name):
    rng = np.random.default_rng(3)
    ids = {
        "text": rng.choice(np.arange(50), 5000, p=np.arange(1, 51) / 1275), "equal": np.full(4097, 9), "pairs": np.tile([3, 4], 1500), "random": rng.integers(0, 60_000, 3000), "empty": np.zeros(0, dtype=int), "one": np.array([5]),
    }[name].astype(np.uint32)
    rules, lengths, symbols = token_files.grammar(ids, 60_000, 4)
    assert (token_files.expand(rules, lengths, symbols, 60_000) == ids).all()
    assert all(max(rule) < 60_000 + k for k, rule in enumerate(rules.tolist()))
    assert name not in ("equal", "pairs") or len(symbols) < 20
    frame = token_files.pack(ids, 60_000, 700, 4)
    assert b"".join(token_files.unpack(frame)) == ids.astype("<u4").tobytes()
    for _ in range(30):
        lo, n = int(rng.integers(0, len(ids) + 1)), int(rng.integers(0, 900))
        assert (token_files.decode(frame, lo, n) == ids[lo : lo + n]).all()
    with pytest.raises(ValueError):
        list(token_files.sections(b"????" + frame[4:]))


def test_a_pair_is_replaced_before_a_rarer_one_that_overlaps_it():
    rules, lengths, symbols = token_files.grammar(np.array([1, 2, 3] * 5 + [1, 2, 9] * 20 + [7, 3] * 2, dtype=np.uint32), 10, 4)
    assert rules[0].tolist() == [1, 2] and lengths[0] == 2 and json.dumps(symbols.tolist()) and isinstance(pa.array(symbols), pa.Array)
