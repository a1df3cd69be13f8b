import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import bpe, token_counts
from skein.llm.common import tokenizer_path

MULTI, EN = (tokenizer_path(f"byte_bpe_{x}50k.tiktoken") for x in ("multi_", ""))


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(path).ranks, special_tokens={})


PARTS = [*"abceinrst'!?12 \n\t", "  ", " the", "ing", "é", "日", "\xa0", "\x1c", "'ll", "'s"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_equals_the_library(text):
    leaf, bpe.LEAF_CHARS, bpe.LEAF_BYTES = (bpe.LEAF_CHARS, bpe.LEAF_BYTES), 7, 1
    try:
        c = bpe.codec(MULTI)
        c.known.clear()
        c.known.older.clear()
        ids = c.encode(text)
        assert ids == library(MULTI).encode_ordinary(text)
        assert c.decode(ids) == text.encode()
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = leaf


def test_memory_is_bounded():
    held = bpe.Remembering(lambda k: k.upper(), 10, 5)
    assert [held[x] for x in ["a", "b", "toolong", *map(str, range(100)), "a"]][2] == "TOOLONG"
    assert len(held) <= 10 and len(held.older) <= 10 and "toolong" not in held and held["a"] == "A"


def test_long_units_are_split_by_halves():
    c, rng = bpe.codec(MULTI), random.Random(1)
    for n in (10, 5000, 20000):
        text = "".join(rng.choice("abcde12,.") for _ in range(n))
        assert c.encode(text) == library(MULTI).encode_ordinary(text)


def test_documents(spark, docs, odd):
    lib = library(MULTI)
    got = sorted(map(tuple, bpe.round_trip_digests(docs(odd), MULTI).collect()), key=str)
    want = []
    for i, t in odd:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(docs(odd), MULTI), MULTI)
    assert sorted((r[1] for r in back.collect())) == sorted((t or "").encode() for _, t in odd)
    assert bpe.encode_documents(docs(odd).limit(0), MULTI).count() == 0


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(-3, 90), st.integers(0, 12), TEXTS), max_size=5))
def test_counts_follow_edits(text, edits):
    leaf, token_counts.LEAF = token_counts.LEAF, 9
    try:
        tree = token_counts.TokenTree(text, bpe.codec(EN))
        for start, removed, inserted in edits:
            at = min(max(start, 0), len(text))
            text = text[:at] + inserted + text[min(len(text), at + removed) :]
            tree.edit(start, removed, inserted)
            assert tree.text() == text and tree.tokens == len(library(EN).encode_ordinary(text))
    finally:
        token_counts.LEAF = leaf


def test_edits_touch_little():
    tree = token_counts.TokenTree("some words here " * 4000, bpe.codec(EN))
    before = tree.encoded
    tree.edit(30000, 3, "new")
    assert tree.encoded - before < 5 * token_counts.LEAF


def test_edit_tables(spark, docs, odd):
    edits = spark.createDataFrame([(4, 2, 0, 4, "1"), (4, 1, 4, 4, ""), (99, 1, 0, 0, "x"), (6, 1, None, None, None), (None, 1, 0, 0, "y")], "doc_id long, seq int, start int, removed int, inserted string")
    for run in (1000, 1):
        trees = token_counts.build_trees(docs(odd), EN)
        got = {r["doc_id"]: r for r in token_counts.counts_after(trees, edits, EN, run).withColumn("text", token_counts.text_of(F.col("leaves"))).collect()}
        assert got[4]["text"] == "1three four five" and got[4]["n_tokens"] == len(library(EN).encode_ordinary("1three four five"))
        assert got[6]["text"] == dict(odd)[6] and got[1]["n_tokens"] == 0 and len(got) == len({i for i, _ in odd})
    assert token_counts.counts_after(token_counts.build_trees(docs(odd), EN), edits.limit(0), EN).count() == len(odd)
    assert token_counts.counts_with_edits(token_counts.revision(docs(odd)).limit(0), EN).count() == 0


def test_query_against_whole_encodings(spark):
    """Counts of op6 are those of the library for the text before and after its edits; edits encode little."""
    got = {r["doc_id"]: r for r in token_counts.op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = token_counts.revision(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert len(got) == len(rows)
    for r in rows:
        text = before = r["text"] or ""
        for e in r["edits"]:
            text = text[: e["start"]] + e["inserted"] + text[e["start"] + e["removed"] :]
        one = got[r["doc_id"]]
        assert (one["n_tokens"], one["n_tokens_edited"]) == (len(library(EN).encode_ordinary(before)), len(library(EN).encode_ordinary(text)))
        assert one["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest() and one["n_chars"] == len(text)
    assert sum(r["n_chars_encoded"] for r in got.values() if r["n_chars"] > 20000) < 0.5 * sum(r["n_chars"] for r in got.values() if r["n_chars"] > 20000) + 1


@pytest.mark.parametrize("path", [MULTI, EN])
def test_neighbours_of_an_encoding_are_compatible(path):
    c = bpe.codec(path)
    ids = c.tokens(b" antidisinterconnectednesslessness")
    assert len(ids) > 3 and all(c.seam(a, b) == (a, b) for a, b in zip(ids, ids[1:]))
