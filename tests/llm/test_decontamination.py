"""Benchmarks searched in parts, and long and odd texts."""

import random

from measured.llm import decontaminate

from . import cases
from .test_operators import plain_hits


def test_many_parts_and_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 7)
    monkeypatch.setattr(decontaminate, "PART_BYTES", 1500)
    rows = cases.rows()
    items = [(1, rows[6][1]), (10, "a b c d"), (2, None), (3, ""), (4, rows[3][1]), (4, "one"), (None, rows[30][1]), (5, rows[0][1]), (5, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as words", "2 as NAME")
    assert sum(1 for _ in decontaminate.parts(bench, 13)) > 2
    got = cases.bag(decontaminate.digests(cases.documents(spark, True), bench))
    assert got == plain_hits(rows, items)
    assert decontaminate.kept(cases.documents(spark), bench).count() == sum(n for r, n in got.items() if not r[-1])


def test_words_beyond_ascii_count(spark):
    item = " ".join("слово" + str(i) for i in range(3000))
    bench = spark.createDataFrame([("ru", item)], "item_id string, text string")
    made = decontaminate.segments(bench, 13).collect()
    assert sum(len(decontaminate.words_of(bytes(r.words))) for r in made) >= 3000


def test_very_long_text(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(10**5)}" for _ in range(300_000)]
    rows = [(1, " ".join(words), None, None, None), (2, "x" * 2_000_000, None, None, None), (2, None, None, None, None)]
    bench = spark.createDataFrame([("a", " ".join(words[5:40])), ("b", " ".join(words[:200]))], "item_id string, text string")
    got = {(x.doc_id, x.n_words): (x.n_hit, x.n_items, x.contaminated) for x in decontaminate.digests(spark.createDataFrame(rows, cases.SCHEMA), bench).collect()}
    assert got == {(1, 300_000): (200, 2, False), (2, 1): (0, 0, False), (2, 0): (0, 0, False)}
