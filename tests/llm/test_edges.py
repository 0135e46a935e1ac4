"""Operators on empty tables, repeated rows, a very long text and columns whose names are those of their results."""

import pytest
from pyspark.sql import functions as F

from quern.llm import chat, mixing, passages, secrets, sketches, url_filter

RESULT = "size source_size target taken n_bytes n_removed spans kept_sha256 n_chars fingerprint n_turns host verdict".split()
LONG = "some words that go on and on " * 8000


def crowded(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit("clash").alias(c) for c in RESULT if c not in df.columns))


DOCS = [(1, "a few words here", "s", "en"), (1, "a few words here", "s", "en"), (2, LONG, "s", "en"), (3, LONG, None, "en"), (None, None, "t", "en")]


@pytest.mark.parametrize(
    ("run", "n"),
    [(mixing.mix, 5), (passages.remove_repeats, 5), (sketches.edited_fingerprints, 5), (lambda d: secrets.redact(d), 5)],
    ids=["mix", "passages", "sketches", "redact"],
)
def test_documents(spark, run, n):
    schema = "doc_id long, text string, source string, lang string"
    assert len(run(crowded(spark, DOCS, schema)).collect()) == n
    assert run(crowded(spark, [], schema)).collect() == []


def test_repeats_and_long_texts_have_defined_results(spark):
    docs = crowded(spark, DOCS, "doc_id long, text string, source string, lang string")
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in passages.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect()}
    assert cut == {(1, 16): 0, (2, len(LONG)): 0, (3, len(LONG)): len(LONG), (None, 0): 0}
    prints = {r.doc_id: r.fingerprint for r in sketches.edited_fingerprints(docs).collect()}
    assert prints[2] == prints[3] != prints[1]
    assert {r.text for r in secrets.redact(docs).where("doc_id = 1").collect()} == {"a few words here"}


def test_conversations_and_pages(spark):
    schema = "conv_id long, turn long, role string, text string"
    convs = crowded(spark, [(1, 0, "user", LONG), (1, 0, "user", LONG), (2, 0, "assistant", None)], schema)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(convs).collect()}
    assert got == {1: (2, 0), 2: (1, 0)} and chat.digests(crowded(spark, [], schema)).count() == 0
    pages = crowded(spark, [(1, "http://x.com/" + "a" * 100_000), (1, "http://x.com/" + "a" * 100_000)], "page_id long, url string")
    assert [(r.host, len(r.path), r.rule) for r in url_filter.filter_urls(pages).collect()] == [("x.com", 100_001, "com/")] * 2
    assert url_filter.filter_urls(crowded(spark, [], "page_id long, url string")).count() == 0
