"""The queries of this subpackage, by name, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, ngram_join, pieces, pii, quality, substrings, tokens, toxicity, warc
from .common import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES = {
    "op1_pii": lambda spark, d: pii.digests(docs(spark, d), total=True),
    "op2_token_counts": lambda spark, d: tokens.counted(docs(spark, d), public_tokenizers.path("word_bpe_49k.json"), fit=True),
    "op3_toxicity": lambda spark, d: toxicity.scored(docs(spark, d), table(spark, d, "labels")),
    "op4_sentencepiece": lambda spark, d: pieces.digests(docs(spark, d), public_tokenizers.path("piece_bpe_32k.model")),
    "op5_licenses": lambda spark, d: licenses.digests(docs(spark, d)),
    "op6_warc": lambda spark, d: warc.round_trip(table(spark, d, "pages")),
    "op7_quality": lambda spark, d: quality.verdicts(docs(spark, d)),
    "op8_substring_dedup": lambda spark, d: substrings.digests(docs(spark, d)),
    "op9_ngram_jaccard": lambda spark, d: ngram_join.digests(docs(spark, d)),
    "op10_decontamination": lambda spark, d: decontaminate.digests(docs(spark, d), table(spark, d, "benchmark")),
}

#: DuckDB SQL; it has no base32, so that is spelled out bit by bit.
SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, sha1(html) AS h, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM s)
        SELECT page_id, payload_bytes,
          array_to_string(list_transform(range(0, 160, 5), lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
            ((('0x' || substr(h, CAST(b // 20 * 5 + 1 AS BIGINT), 5))::BIGINT) >> CAST(15 - b % 20 AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to
        FROM r""",
}
