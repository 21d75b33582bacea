"""Removal of long passages that occur more than once, by relative
Lempel-Ziv parsing against an index of all documents.

Texts are cut into blocks at anchors: the smallest hash of SEED words in each
window of W words picks a place by the window's words alone, so equal windows
have equal anchors, and the windows of one anchor form a block. The index holds
each block of every document by its anchor and its wording, with the first and the
last place where that wording stands; a block whose anchor is shared but whose
wording isn't is indexed by its windows too, as a copy may begin or end in it.

Each document is then parsed from left to right against the places that the
index gives: the factor at a window is the longest copy of one place, carried
on over the borders of blocks as long as the following blocks or windows are
copies of what follows there. The next factor begins with the first window
that the last one doesn't hold; windows across a factor's end are looked up
like any other. A factor has W words or more; all else are literals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, joined, mixed, paired, per_row, pick, slices, utf8, word_hashes, written

SEED = 12


class Hashed:
    """Hashes of all stretches of a sequence of words, from hashes of stretches
    of 1, 2, 4 .. words: two of those that overlap make any other."""

    def __init__(self, text: bytes):
        first, self.other = word_hashes(text, both=True)
        self.n = len(first)
        self.levels = [mixed(first)]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            x, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(paired(x[: max(0, len(x) - step)], x[step:]))
        return self.levels[k]

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = np.empty(len(size), np.uint64)
        order = np.frexp(size)[1] - 1
        for k in np.unique(order):
            at, x = order == k, self.level(int(k))
            out[at] = paired(paired(x[start[at]], x[end[at] - (1 << k)]), size[at].astype(np.uint64))
        return out

    def seeds(self) -> np.ndarray:
        """A hash of the SEED words from each place on, from other hashes of words."""
        x, size = mixed(self.other), 1
        while 2 * size <= SEED:
            x, size = paired(x[: len(x) - size], x[size:]), 2 * size
        return paired(x[: self.n - SEED + 1], x[SEED - size :])


def phrases(x: Hashed, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each phrase, and its anchor's hash."""
    g = x.seeds()
    n = len(g)
    #: High bits of the hash, then the place: the smallest is the leftmost of equal ones.
    key = (g >> np.uint64(31) << np.uint64(31)) | np.arange(n, dtype=np.uint64)
    span, size = w - SEED + 1, 1
    low = key
    while size < span:
        step = min(size, span - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    at = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    anchor = at[first]
    #: The place of the anchor within the phrase belongs to the phrase.
    return first, last, g[anchor]


RUN = "anchor bigint, whole bigint, doc bigint, hash bigint, first int, last int"
RUN_ARROW = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
PART = "anchor bigint, window bigint, doc bigint, hash bigint, first int"
PART_ARROW = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64()), ("first", pa.int32())])


def keyed(docs: DataFrame, *more: tuple[str, str]) -> DataFrame:
    """doc, hash and text: rows with equal keys have equal results. more: other
    columns to pick, as (name, type)."""
    d = pick(docs, ("doc_id", "bigint"), ("text", "string"), *more)
    return d.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("hash"), "text", *[n for n, _ in more])


def gathered(kind: pa.Schema, lists: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), f.type) for c, f in zip(lists, kind, strict=True)], schema=kind)


def runs(docs: DataFrame, w: int) -> DataFrame:
    """The phrases of all texts: anchor, hash of the whole phrase, place."""

    def run(batches):
        for b in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in RUN_ARROW]
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                x = Hashed(text)
                if x.n >= w:
                    a, z, g = phrases(x, w)
                    whole = x.stretch(a, z + w)
                    for c, v in zip(out, (g.view(np.int64), whole.view(np.int64), np.full(len(a), doc), np.full(len(a), key), a, z), strict=True):
                        c.append(v)
            if out[0]:
                yield gathered(RUN_ARROW, out)

    return docs.select("doc", "hash", "text").mapInArrow(run, RUN)


def windows(docs: DataFrame, w: int) -> DataFrame:
    """Every window of the phrases in ``checks`` (array of first, last,
    anchor) of a text, by the anchor's and the window's hash."""

    def run(batches):
        for b in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in PART_ARROW]
            for doc, key, text, checks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), strict=True):
                x = Hashed(text)
                at = np.concatenate([np.arange(c["first"], c["last"] + 1) for c in checks])
                anchor = np.concatenate([np.full(c["last"] + 1 - c["first"], c["anchor"]) for c in checks])
                for c, v in zip(out, (anchor, x.stretch(at, at + w).view(np.int64), np.full(len(at), doc), np.full(len(at), key), at), strict=True):
                    c.append(v)
            if out[0]:
                yield gathered(PART_ARROW, out)

    return docs.select("doc", "hash", "text", "checks").mapInArrow(run, PART)


def matches(docs: DataFrame, w: int) -> DataFrame:
    """doc, hash, first, last, low and high: stretches of windows of a document
    that the index finds elsewhere, and the first and last place of each.

    Only blocks whose anchor occurs twice go on. Counts are summed before
    they are shuffled and joined back by sort-merge joins, whose hot keys
    Spark splits; no task needs all places of an anchor. What is made of one
    document's stretches is no larger than the document.
    """
    all_ = runs(docs, w)
    place = F.struct("doc", "hash", "first")
    ends = (F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    #: Counts are written before they are joined back: Spark splits a hot key
    #: only where the join reads both sides straight from an exchange.
    twice = written(all_.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    met = written(all_.join(twice, "anchor"), "phrases")
    drop_written(twice)
    blocks = written(met.groupBy("anchor", "whole").agg(*ends, F.max(F.col("last") - F.col("first")).alias("more")), "blocks")
    copied = met.join(blocks.where("n > 1").select("anchor", "whole", "low", "high"), ["anchor", "whole"]).select("doc", "hash", "first", "last", "low", "high")
    #: Blocks that differ from every other one, and one of each kind they may share windows with.
    alone = blocks.where("n = 1")
    partners = blocks.where("n > 1").join(alone.select("anchor").distinct(), "anchor", "left_semi")
    one = alone.unionByName(partners).select("anchor", "low.*", "more")
    checks = one.groupBy("doc", "hash").agg(F.collect_list(F.struct("first", (F.col("first") + F.col("more")).alias("last"), "anchor")).alias("checks"))
    checks = written(checks, "checks")
    parts = written(windows(joined(docs, checks, ["doc", "hash"], "inner"), w), "windows")
    drop_written(checks)
    again = written(parts.groupBy("anchor", "window").agg(*ends).where("n > 1").drop("n"), "again")
    single = parts.join(again, ["anchor", "window"]).select("doc", "hash", "first", F.col("first").alias("last"), "low", "high")
    out = written(copied.unionByName(single), "matches")
    drop_written(met, blocks, parts, again)
    return out


def parsed(found: list[dict], own: tuple[int, int], w: int) -> list[tuple[int, int, int, int, int]]:
    """Factors of one document: start, number of words, and the place copied
    (doc, hash, first word), by greedy longest copies from left to right.

    At a window the places of its wording are tried, other than itself (where
    that is all there is, the copy is another row of the same id and text).
    """
    stretches: list[tuple[int, int, set]] = []
    for m in sorted(found, key=lambda m: (m["first"], -m["last"])):
        if stretches and m["first"] <= stretches[-1][1]:
            continue
        places = {(p["doc"], p["hash"], p["first"] - m["first"]) for p in (m["low"], m["high"])}
        stretches.append((m["first"], m["last"], places - {(*own, 0)} or places))
    out, k = [], 0
    while k < len(stretches):
        start, last, here = stretches[k]
        k += 1
        while k < len(stretches) and stretches[k][0] == last + 1 and (after := here & stretches[k][2]):
            here, last, k = after, stretches[k][1], k + 1
        doc, key, off = min(here)
        out.append((start, last + w - start, doc, key, start + off))
    return out


FACTOR = [("start", pa.int64()), ("words", pa.int64()), ("of_doc", pa.int64()), ("of_hash", pa.int64()), ("of_start", pa.int64())]
FACTORS = "doc bigint, hash bigint, factors array<struct<" + ",".join(f"{n}:bigint" for n, _ in FACTOR) + ">>"
FACTORS_ARROW = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("factors", pa.list_(pa.struct(FACTOR)))])


def factors(docs: DataFrame, w: int = 35) -> DataFrame:
    """doc (doc_id, or the least number for null), hash (of the text) and factors
    of each document with words that also stand elsewhere; a written table.

    A factor is start and number of words, at least ``w``, and the document and
    place that hold the same words. Rows of one id and text are one document
    here. Factors may overlap by less than ``w`` words, where a window across
    the end of one is a copy of another place.
    """
    return _factors(keyed(docs), w)


def _factors(d: DataFrame, w: int) -> DataFrame:
    all_ = matches(d, w)
    found = all_.groupBy("doc", "hash").agg(F.collect_set(F.struct("first", "last", "low", "high")).alias("found"))

    def rows(b):
        made = [parsed(x, (doc, key), w) for doc, key, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        return b.column(0), b.column(1), [[dict(zip([n for n, _ in FACTOR], f, strict=True)) for f in x] for x in made]

    out = written(per_row(found, FACTORS, rows, FACTORS_ARROW), "factors")
    drop_written(all_)
    return out


def covered(spans: list[tuple[int, int]]) -> list[int]:
    """Union of ranges, as starts and ends in order."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def without(words: list[bytes], spans: list[int]) -> list[bytes]:
    at, out = 0, []
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out += words[at:a]
        at = b
    return out + words[at:]


def cleaned(docs: DataFrame, w: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept (words left, joined by a space) of
    each row of ``docs``, after every word is removed that lies in ``w``
    consecutive words which also start anywhere else, in the input.

    Null and empty texts and texts of fewer than ``w`` words lose nothing.
    Rows with one doc_id but different texts are told apart by the text;
    repeated rows are copies of each other. Null ids are allowed, other
    columns aren't read, an empty table gives an empty table. Equality is that
    of a 64-bit hash of all words together with another of the anchor's.
    """
    return _cleaned(docs, w, digest=False)


def digests(docs: DataFrame, w: int = 35) -> DataFrame:
    """cleaned() with kept as kept_sha256, its SHA-256 in UTF-8."""
    return _cleaned(docs, w, digest=True)


def _cleaned(docs: DataFrame, w: int, digest: bool) -> DataFrame:
    name = "kept_sha256" if digest else "kept"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (name, pa.string())])
    d = keyed(docs)
    spans = _factors(d, w).select("doc", "hash", F.flatten(F.transform("factors", lambda f: F.array(f["start"], f["start"] + f["words"]))).alias("spans"))
    d = joined(d, spans, ["doc", "hash"], "left").select("doc_id", "text", "spans")

    def rows(b):
        n, gone, out = [], [], []
        for x, spans in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = x.split()
            left = without(words, covered([*zip(spans[::2], spans[1::2], strict=True)])) if spans else words
            n.append(len(words))
            gone.append(len(words) - len(left))
            text = b" ".join(left)
            out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
        return b.column(0), n, gone, out

    return per_row(d, f"doc_id bigint, n_words bigint, n_removed bigint, {name} string", rows, arrow)
