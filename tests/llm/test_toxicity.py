"""Labels with clashing columns and repeated ids, features against a plain
version, and what is flagged in the held-out fifth."""

import random
import zlib

from measured.llm import toxicity

from . import cases
from .test_operators import plain_distance


def test_hits_against_every_term():
    r = random.Random(5)
    words = {"".join(r.choice("abcdef") for _ in range(r.randint(3, 8))): 1.0 + i for i, _ in enumerate(range(40))}
    stems = {"".join(r.choice("abcdef") for _ in range(4)): 2.0 for _ in range(5)}
    t = toxicity.Terms(words, stems)

    def plain(w):
        if w in words:
            return "exact"
        if any(w.startswith(s) for s in stems):
            return "beginning"
        near = {w, *(w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1))}
        far = [x for x in words if len(x) >= toxicity.FUZZY_FROM]
        fuzzy = len(w) >= toxicity.FUZZY_FROM - 1
        if fuzzy and (any(plain_distance(w, x) <= 1 for x in far) or near & set(far)):
            return "misspelled"
        return None

    for _ in range(1500):
        w = "".join(r.choice("abcdef") for _ in range(r.randint(1, 9)))
        got = t.hit(w)
        want = plain(w)
        if want != "misspelled" and got and got[0] == "misspelled":
            #: A stem of five letters or more may be misspelled too.
            assert any(len(s) >= toxicity.FUZZY_FROM for s in stems)
        else:
            assert (got and got[0]) == want, w


def test_repeated_ids_and_clashing_columns(spark):
    docs = cases.documents(spark, True)
    labels = spark.createDataFrame([(i, 0, int("idiot" in (t or ""))) for i, t, *_ in cases.rows() if i is not None] * 2, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' as text", "1 as DOC_ID", "2 as h")
    rows = toxicity.sample(docs, labels).collect()
    assert len(rows) == len({i for i, *_ in cases.rows() if i is not None and zlib.crc32(str(i).encode()) % 5})
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(cases.rows())


def test_long_texts(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeu") for _ in range(3))
    rows = [(i, " ".join(word() + (" idiot" if i % 2 and j % 3 == 0 else "") for j in range(30))) for i in range(60)]
    rows += [(100, "idiot " * 100_000), (101, "x" * 1_000_000), (102, None)]
    labels = [(i, 0, i % 2) for i in range(60)]
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert len(got) == 63 and got[102] < 0.5 and got[101] < 0.5 < got[100]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.held_out and r.doc_id in labels]
    bad = [r for r in got if labels[r.doc_id]]
    assert sum(r.predicted for r in bad) >= 0.75 * len(bad) and sum(r.predicted for r in got if not labels[r.doc_id]) <= 0.03 * len(got)
