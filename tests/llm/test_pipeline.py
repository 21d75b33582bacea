"""The pipeline against its stages' plain versions."""

import collections

import corpus_pipeline
import public_tokenizers
import sentencepiece

from measured.llm import pii, quality

from . import cases, test_operators


def plain_run(spark, rows, items):
    """What the pipeline gives, from the stages' plain versions."""
    kept = collections.Counter((r.doc_id, r.n_words) for r in quality.verdicts(cases.documents(spark)).where("kept").collect())
    left = [r for r in rows if (r[0], len(cases.words(r[1]))) in kept]
    component = {}
    for d, _, c in test_operators.plain_join(left):
        component[d] = c
    best = {}
    for r in left:
        best.setdefault(component[r[0]], r) if r[0] == component[r[0]] else None
    clean = {r[0] for r in test_operators.plain_hits(list(best.values()), items) if not r[-1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for r in best.values():
        if r[0] in clean:
            ids = [*sp.encode(pii.redact(r[1], pii.found(r[1]))), sp.eos_id()]
            want[r[0], len(ids), cases.sha(" ".join(map(str, ids))), cases.sha(sp.decode(ids))] += 1
    return want


def test_pipeline(spark, tmp_path):
    """With columns whose names clash with those of the operators."""
    rows = cases.rows()
    cases.documents(spark).selectExpr("*", "'x' as label", "2 as row", "3 as _spans").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, rows[6][1])]
    spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as name").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert cases.bag(got) == plain_run(spark, rows, items)


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_no_documents(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
