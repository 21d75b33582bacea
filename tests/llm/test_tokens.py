"""Counts of odd characters, prefixes and budgets, against the library."""

import random
import sys

import public_tokenizers
import tokenizers

from measured.llm import tokens

from . import cases

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def test_characters_of_all_of_unicode():
    t, c, r = tokenizers.Tokenizer.from_file(VOCAB), tokens.counter(VOCAB), random.Random(3)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    for x in ("İ೜", "İ࢏", "İ₏", '"?\U0001908f', "Ᲊa", "\U00010d50x", "aͅΣ", "ÅÅ"):
        assert c.count(x) == count(x), x
    chars = [chr(i) for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    r.shuffle(chars)
    for i in range(0, 60_000, 6):
        x = "".join(y + r.choice(["", " ", "a", "1", "!", "'s"]) for y in chars[i : i + 6])
        assert c.count(x) == count(x), x


def test_stored_prefixes_answer_every_budget(spark):
    t = tokenizers.Tokenizer.from_file(VOCAB)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    texts = ["An  international thing,\nshe SAID: 42!", "", None, "Ünïcöde 日本 \U0001f389 it's", "one<|endoftext|>two", "x" * 300]
    stored = tokens.prefix_counts(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"), VOCAB).persist()
    for r in stored.collect():
        assert len(r.counts) == len(r.normal) + 1
        if "<|" not in r.normal:
            assert r.counts == [count(r.normal[:i]) for i in range(len(r.normal) + 1)]
    got = tokens.truncated(stored, 0, 1, 3, 7, 1000).collect()
    assert len(got) == 5 * len(texts)
    for r in got:
        want, n = tokens.counter(VOCAB).cut(texts[r.doc_id] or "", r.budget)
        assert (r.text, r.n_tokens) == (want, n) and n <= r.budget


def test_counts_of_very_long_texts(spark):
    r = random.Random(4)
    rows = [(1, "a" * 400_000), (2, " ".join(str(r.random()) for _ in range(20_000))), (3, "é́ " * 50_000), (None, None)]
    t = tokenizers.Tokenizer.from_file(VOCAB)
    got = {x.doc_id: x for x in tokens.counted(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as TEXT", "2 as n_tokens"), VOCAB).collect()}
    for d, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[d].n_tokens, got[d].over_limit, got[d].n_bytes) == (n, n > 2048, len((x or "").encode()))
    assert cases.bag(tokens.counted(spark.createDataFrame([], "doc_id bigint, text string"), VOCAB)) == {}
