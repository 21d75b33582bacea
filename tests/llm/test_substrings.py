"""Factors of the parse, and arrangements of words that hashes might confuse."""

import random

from measured.llm import ngram_join, substrings
from measured.llm.common import word_hashes

from . import cases
from .test_operators import plain_substrings


def thue_morse(n, a="a", b="b"):
    return " ".join(b if bin(i).count("1") % 2 else a for i in range(n))


def factors_of(spark, rows, w):
    df = spark.createDataFrame(rows, cases.SCHEMA)
    return {r.doc: r.factors for r in substrings.factors(df, w).collect()}


def test_factors_are_long_copies_of_other_places(spark):
    r = random.Random(8)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p, q = text(400), text(90)
    docs = [text(20) + p + text(30), text(5) + p[100:350] + text(9), q + p[:200] + q[40:], text(50) + q[10:80], text(300), p[380:] + text(60)]
    rows = [(i, " ".join(x), None, None, None) for i, x in enumerate(docs)]
    got = factors_of(spark, rows, 35)
    assert sorted(got) == [0, 1, 2, 3]
    for i, fs in got.items():
        gone = set()
        for f in fs:
            assert f.words >= 35 and (f.of_doc, f.of_start) != (i, f.start)
            assert docs[i][f.start : f.start + f.words] == docs[f.of_doc][f.of_start : f.of_start + f.words]
            gone |= set(range(f.start, f.start + f.words))
        key = cases.bag(substrings.digests(spark.createDataFrame(rows, cases.SCHEMA)))
        assert next(x for x in key if x[0] == i)[2] == len(gone)
    #: One copy each, carried over all the borders of blocks inside it.
    assert [(f.start, f.words, f.of_doc) for f in got[1]] == [(5, 250, 0)]
    assert len(got[0]) == 2 and got[0][0].start == 20 and got[0][1].start + got[0][1].words == 370


def test_parse_takes_the_longest_copy():
    place = lambda d, f: {"doc": d, "hash": 0, "first": f}
    found = [{"first": a, "last": b, "low": place(*x), "high": place(*y)} for a, b, x, y in ((0, 9, (1, 0), (2, 50)), (10, 10, (1, 90), (2, 60)), (11, 20, (2, 61), (3, 5)), (30, 31, (9, 30), (4, 4)))]
    assert substrings.parsed(found, (9, 0), 35) == [(0, 55, 2, 0, 50), (30, 36, 4, 0, 4)]
    assert substrings.parsed([{"first": 3, "last": 4, "low": place(9, 3), "high": place(9, 3)}], (9, 0), 35) == [(3, 36, 9, 0, 3)]


def test_arrangements_that_cancel_in_polynomials(spark):
    a, b = thue_morse(4096), thue_morse(4096, "b", "a")
    assert len({int(x) for x in word_hashes(f"{a.replace(' ', '')} {b.replace(' ', '')} x".encode())}) == 3
    long = [thue_morse(1024).replace(" ", ""), thue_morse(1024, "b", "a").replace(" ", "")]
    rows = [(i, x + " " + " ".join(f"v{i}" for _ in range(9)).replace("v", "same" if i < 2 else "v"), None, None, None) for i, x in enumerate(long)]
    sets = [ngram_join.shingles(f"{x} one two three four five six seven".encode()) for x in long]
    assert len(set(map(int, sets[0])) & set(map(int, sets[1]))) == len(sets[0]) - 1
    x = substrings.Hashed(f"{a} {b}".encode())
    import numpy as np

    start = np.arange(x.n - 1024)
    assert len(np.unique(x.stretch(start, start + 1024))) > 3000
    rows = [(0, a, None, None, None), (1, b, None, None, None)]
    assert cases.bag(substrings.digests(spark.createDataFrame(rows, cases.SCHEMA), 35)) == plain_substrings(rows, 35)


def test_substrings_of_very_long_and_repeated_rows(spark):
    r = random.Random(1)
    x = " ".join(f"w{r.randrange(10**5)}" for _ in range(200_000))
    rows = [(1, x, None, None, None)] * 2 + [(2, x[:1000], None, None, None), (3, "y" * 500_000, None, None, None), (None, "z " * 3000, None, None, None), (4, "", None, None, None), (4, None, None, None, None)]
    got = substrings.digests(spark.createDataFrame(rows, cases.SCHEMA))
    assert cases.bag(got) == plain_substrings(rows, 35)
    assert cases.bag(got.select("doc_id")) == cases.bag(spark.createDataFrame(rows, cases.SCHEMA).select("doc_id"))
