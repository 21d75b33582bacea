"""Tiles by size and place, large cells, and names that clash."""

import random

from pyspark.sql import functions as F

from measured.llm import ngram_join

from . import cases
from .test_operators import plain_join


def rows_of(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, cases.SCHEMA)


def copies(r, n, words=60, most=6):
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(words)] = f"x{r.randrange(50)}"
        yield " ".join(w[r.randint(0, 4) : r.randint(words - 15, words)])


def test_small_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 3)
    monkeypatch.setattr(ngram_join, "WIDE", 5)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 64)
    r = random.Random(21)
    texts = [t for n in (40, 25, 3, 1, 1) for t in copies(r, n)] + [" ".join(f"v{r.randrange(6)}" for _ in range(r.randint(1, 14))) for _ in range(60)]
    rows, df = rows_of(spark, texts)
    assert cases.bag(ngram_join.digests(df)) == plain_join(rows)


def test_large_cells_and_sets_of_every_size_and_place(spark):
    r = random.Random(22)
    texts = [t for n in (300, 200) for t in copies(r, n, most=9)]
    for n in range(5, 60):
        base = [f"a{n}x{i}" for i in range(n)]
        texts += [" ".join(base), " ".join(base[: -(-3 * n // 4)]), " ".join(base[n // 4 :]), " ".join(base + [f"b{i}" for i in range(n // 3)]), " ".join(base[r.randrange(3) :])]
    rows, df = rows_of(spark, texts)
    assert cases.bag(ngram_join.digests(df)) == plain_join(rows)


def test_pages_of_one_template_do_not_meet(spark):
    """80 words shared, 20 of their own: 0.655 similar; rows grow with pages."""
    r = random.Random(24)
    shared = [f"s{i}" for i in range(80)]
    found = {}
    for n in (300, 1200):
        rows, df = rows_of(spark, [" ".join(shared + [f"o{r.randrange(10**9)}" for _ in range(20)]) for _ in range(n)])
        d = ngram_join.keyed(df).withColumn("row", F.lit(0).cast("bigint"))
        all_ = ngram_join.sets(d).persist()
        reps = all_.where("n > 0")
        told = ngram_join.shared(ngram_join.postings(d, ngram_join.sketch(all_), {})).withColumn("label", F.col("sid")).persist()
        found[n] = ngram_join.all_cells(told, reps).count(), ngram_join.some_cells(told, reps).count()
        assert told.count() >= n
    assert all(b <= 8 * a + 100 for a, b in zip(found[300], found[1200], strict=True)) and found[1200][0] <= 12_000


def test_names_that_clash(spark, monkeypatch):
    whole = ngram_join.identity
    monkeypatch.setattr(ngram_join, "identity", lambda t: (whole(t)[0] % 5, whole(t)[1]) if len(t) else (0, 0))
    rows, df = rows_of(spark, [t for n in (6, 6, 5) for t in copies(random.Random(25), n)])
    d = ngram_join.keyed(df).withColumn("row", F.lit(0).cast("bigint"))
    all_ = [r for r in ngram_join.sets(d).where("n >= 0").collect()]
    assert len({r.sid for r in all_}) <= 5
    assert cases.bag(ngram_join.digests(df)) == plain_join(rows)


def test_very_long_text(spark):
    x = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, x, None, None, None), (2, x + " tail", None, None, None), (3, "w" * 2_000_000, None, None, None), (None, x.upper(), None, None, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.digests(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert got == {1: (149_996, None), 2: (149_997, None), 3: (1, 3), None: (149_996, None)}
