"""Counts against the tokenizer library itself."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from lumigate.llm.token_counts import Lengths, counter, frequent_lengths, load, token_counts, tokenizer_path

ALPHABET = "ab'sStT  \n\t\r\x0b\x0c\x85\xa0\x1c\x1f\x00éªº²¼1٣2,.-—…’日😀<|endoftext|>İſ​ 　"


def test_counts_equal_the_librarys():
    path = tokenizer_path()
    tok, count, rnd = load(path), counter(path, frequent_lengths(path)), random.Random(3)
    for _ in range(5000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))) + "<|endoftext|>" * (rnd.random() < 0.1)
        assert count(text) == len(tok.encode(text, add_special_tokens=False).ids), text


def test_the_cache_is_bounded():
    cache = Lengths(load(tokenizer_path()), {"the": 1}, entries=3)
    assert [cache[w] for w in (" aab", " aac", " aad", " aae", "the")] and len(cache) <= 4


def test_rows_are_all_kept(spark):
    long = "one two " * 50_000
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, long, None), (3, "a b", 1), (3, "a b", 1)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect())
    assert got == [(-1, 400_000, 100_001, True), (1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False)]
    assert token_counts(docs.limit(0)).count() == 0
