"""A corpus pipeline: five stages, each applied to all the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from measured.llm import decontaminate, ngram_join, pieces, pii, quality
from measured.llm.common import drop_written, scope, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the adaptive thresholds go. Null and
    empty texts fail; repeated rows are judged alike; extra columns pass."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that of the smallest
    id, null before all, then of the smallest text hash. Of repeated rows one
    stays; rows without words, which link with nothing, all stay."""
    return ngram_join.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts are clean; an empty
    benchmark keeps all."""
    return decontaminate.kept(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets, and n_chars
    follows. Null texts stay null, and no row goes."""
    return pii.redacted(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of each document, with an end id, n_tokens and the digests of
    ids and of the text decoded from them. A null text has the end id alone."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("pii", personal_data),
    ("sentencepiece", tokenized),
]

#: Thresholds from sketches and merge encodings are beyond SQL; tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, after each stage has been applied to all that
    the one before kept.

    Every stage's result is a table in the shared folder; the table before it,
    and what the stage wrote on its way, is deleted as soon as it is there. Extra
    columns pass through all stages but the last, also where their names clash;
    repeated rows and ids, nulls, empty and very long texts are as each stage
    says; no documents give no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name))
        drop_written(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
