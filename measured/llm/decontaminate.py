"""Benchmark passages in documents, by Wu-Manber search over words.

Patterns are windows of consecutive benchmark words. Patterns of one length
share a table that says, for each block of two words, how far the search may
move on; where it may not move, the bucket of that block holds the patterns
that end with it, and these are compared word by word.

Tables have a bounded size: a large benchmark is cut into segments that share
no window, these are dealt to parts, and documents are searched for one part
after the other; what is hit adds up.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, numbered, per_row, pick, scope, utf8, written

#: Bytes 0-9, a-z (A-Z as a-z) and those of other characters; all else parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Words of a segment, and bytes of the segments that are searched at once, about.
SEGMENT, PART_BYTES = 20_000, 4 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Searcher:
    """Wu-Manber tables for windows of ``size`` words of the items' texts.

    An item with fewer words, but not none, is one window of its own length.
    """

    def __init__(self, items: list[tuple[str, bytes]], size: int = 13):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            w = words_of(text)
            k = min(size, len(w))
            for i in range(len(w) - k + 1 if w else 0):
                owners.setdefault(tuple(w[i : i + k]), set()).add(name)
        self.owners = {p: sorted(o) for p, o in owners.items()}
        self.tables: list[tuple[int, int, dict, dict]] = []
        for k in sorted({len(p) for p in owners}):
            block = min(2, k)
            shift: dict[tuple[bytes, ...], int] = {}
            bucket: dict[tuple[bytes, ...], set] = {}
            for p in owners:
                if len(p) == k:
                    for i in range(block, k + 1):
                        b = p[i - block : i]
                        shift[b] = min(shift.get(b, k), k - i)
                    bucket.setdefault(p[k - block :], set()).add(p)
            self.tables.append((k, block, shift, bucket))

    def find(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Starts and ends of the stretches of words that occurrences of
        windows cover, in order, and whose these are."""
        n, found, names = len(words), [], set()
        for k, block, shift, bucket in self.tables:
            step, get, i = k - block + 1, shift.get, k
            while i <= n:
                b = tuple(words[i - block : i])
                s = get(b, step)
                if s:
                    i += s
                    continue
                p = tuple(words[i - k : i])
                if p in bucket[b]:
                    found.append((i - k, i))
                    names.update(self.owners[p])
                i += 1
        return union(found), names


def union(ranges: list[tuple[int, int]]) -> list[int]:
    """Starts and ends of what ranges cover, in order."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def segments(benchmark: DataFrame, size: int) -> DataFrame:
    """name and text of an item's words in stretches of SEGMENT windows, each
    window in one; an item with fewer words than a window is one stretch, one
    with none has none. A null item_id counts as the name 'null'."""

    def run(batches):
        for b in batches:
            names, out = [], []
            for name, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                w = words_of(text)
                for i in range(0, max(1, len(w) - size + 1) if w else 0, SEGMENT):
                    names.append("null" if name is None else name)
                    out.append(b" ".join(w[i : i + SEGMENT + size - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["name", "words"])

    return pick(benchmark, ("item_id", "string"), ("text", "string")).mapInArrow(run, "name string, words binary").distinct()


def parts(benchmark: DataFrame, size: int):
    """Broadcast tables of each part of a benchmark, made one at a time: its
    segments are dealt by their hash, so that a part has about PART_BYTES
    whatever the size of the benchmark or of an item."""
    spark = benchmark.sparkSession
    made = written(segments(benchmark, size), "segments")
    total = made.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, -(-total // PART_BYTES))
    for i in range(n):
        rows = made.where(F.pmod(F.xxhash64("name", "words"), F.lit(n)) == i).collect()
        yield spark.sparkContext.broadcast(Searcher([(r[0], bytes(r[1])) for r in rows], size)), i == n - 1
    drop_written(made)


def judge(n: int, spans: list[int]) -> tuple[int, bool]:
    """Words hit, and whether they make a text of n words contaminated."""
    hit = sum(spans[1::2]) - sum(spans[::2])
    return hit, hit > 0 and 20 * hit >= n


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit (words inside an
    occurrence of a benchmark window), items (names of items with occurring
    windows, sorted as strings) and contaminated (n_hit > 0 and at least a
    twentieth of the words hit).

    Null and empty texts have no words and are clean. Rows are judged by
    themselves, so null or repeated ids and repeated rows do no harm; only
    doc_id and text are read; with an empty benchmark nothing is hit.
    """
    d = pick(docs, ("doc_id", "bigint"), ("text", "string")).select("*", F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    some = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    whole = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_())])

    def searched(tables, last: bool):
        def rows(b):
            n, spans, names = [], [], []
            for x, have, of in zip(utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                w = words_of(x)
                got, o = tables.value.find(w)
                n.append(len(w))
                spans.append(union([*zip(have[::2], have[1::2], strict=True), *zip(got[::2], got[1::2], strict=True)]) if have else got)
                names.append(sorted(o | set(of)))
            if not last:
                return b.column(0), b.column(1), spans, names
            hit = [judge(k, s) for k, s in zip(n, spans, strict=True)]
            return b.column(0), n, [h for h, _ in hit], names, [c for _, c in hit]

        return rows

    with scope() as keep:
        for tables, last in parts(benchmark, size):
            if not last:
                d = written(per_row(d, "doc_id bigint, text string, spans array<int>, items array<string>", searched(tables, False), some), "searched")
            else:
                out = per_row(d, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, contaminated boolean", searched(tables, True), whole)
        if hasattr(d, "_measured_path"):
            keep(d)
    return out


def digests(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """hits() with its items as a count and a digest."""
    h = hits(docs, benchmark, size)
    return h.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def kept(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't contaminated.

    Null and empty texts are kept; repeated rows and ids are judged one by one;
    an empty table gives an empty table, an empty benchmark keeps all.
    """
    flat, c = numbered(docs)
    flat = flat.withColumn("_spans", F.array().cast("array<int>"))

    def searcher(tables, last: bool):
        @F.pandas_udf("boolean" if last else "array<int>")
        def search(texts, spans):
            out = []
            for x, have in zip(texts, spans, strict=True):
                w = words_of((x or "").encode())
                got, _ = tables.value.find(w)
                both = union([*zip(have[::2], have[1::2], strict=True), *zip(got[::2], got[1::2], strict=True)])
                out.append(not judge(len(w), both)[1] if last else [int(i) for i in both])
            return pd.Series(out, dtype="bool" if last else "object")

        return search(c("text"), F.col("_spans"))

    with scope() as keep:
        for tables, last in parts(benchmark, size):
            if not last:
                flat = written(flat.withColumn("_spans", searcher(tables, False)), "searched")
            else:
                out = flat.where(searcher(tables, True)).drop("_spans").toDF(*docs.columns)
        if hasattr(flat, "_measured_path"):
            keep(flat)
    return out
