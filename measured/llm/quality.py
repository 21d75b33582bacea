"""Quality rules with thresholds that adapt to each language and source.

Each text is measured once. For each language, source and measure a sketch of
logarithmic buckets counts the values (quantiles to a set relative error;
sketches merge by adding counts, in any order, with the same result). Every
number in a threshold is a quantile of such a sketch; a value far above its
group's low quantiles, which junk can't move unless it is more than three
quarters of the group, rejects the document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, joined, numbered, per_row, pick, scope, utf8, written

SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
LETTERS = bytes(b for b in range(256) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
SMALL = bytes(b for b in range(256) if not 65 <= b <= 90)
GO_ON = bytes(range(0x80, 0xC0))

#: Measures: what is counted, and of how many.
MEASURES = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "punctuation_ratio": ("n_punctuation", "word_chars"),
    "capital_ratio": ("n_capitals", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
}
#: Sizes of texts, whose medians say how finely a ratio can be told.
SIZES = ("word_chars", "n_lines", "n_words")
#: Relative width of a sketch's buckets.
GAMMA = 1.02
#: Low-side distances, and counts in a middling text, from the lower quartile to
#: the fence.
REACH = 12.0
#: Rows of a group at which its own fence and its language's count alike.
LEAST_ROWS = 100


def repeated(words: list[bytes], window: int = 5) -> int:
    """Words in windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    code, m = ids, len(known)
    for i in range(1, window):
        code = code[: n - i] * len(known) + ids[i:]
        m *= len(known)
        if m * len(known) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            m = len(code)
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(code, twice)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def measured(text: bytes) -> tuple:
    """COUNTS of a text."""
    words = text.split()
    symbols = len(text.translate(None, SYMBOLS))
    if not words:
        return 0, 0, symbols, 0, 0, 0, 0, 0
    packed = b"".join(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), len(packed.translate(None, GO_ON)), symbols, len(lines) - len(set(lines)), repeated(words), len(packed.translate(None, LETTERS)), len(packed.translate(None, SMALL)), len(lines)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_capitals", "n_lines")


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash, COUNTS and MEASURES of each row of
    ``docs``; a measure of nothing is 0."""
    names = [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("text_hash", "bigint"), *((n, "bigint") for n in COUNTS)]
    arrow = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in names])

    def rows(b):
        got = [measured(x) for x in utf8(b.column(4))]
        return [*b.columns[:4], *([x[i] for x in got] for i in range(len(COUNTS)))]

    d = pick(docs, ("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("text", "string"))
    f = per_row(d.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "text"), ", ".join(f"{n} {t}" for n, t in names), rows, arrow)
    return f.select("*", *[F.when(F.col(n) > 0, F.col(c) / F.col(n)).otherwise(F.lit(0.0)).alias(m) for m, (c, n) in MEASURES.items()])


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sketches(f: DataFrame, *by: str) -> DataFrame:
    """Counts per bucket of every measure and size in each group: at most a few
    hundred rows a group and measure. Counts are summed before and after the
    shuffle, so a group with a third of all rows is no larger than any other."""
    long = f.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in [*MEASURES, *SIZES]])).alias("x")).select(*by, "x.*")
    bucket = F.when(F.col("v") > 0, F.ceil(F.log("v") / math.log(GAMMA))).otherwise(F.lit(NOTHING).cast("bigint"))
    return long.groupBy(*by, "measure", bucket.alias("bucket")).agg(F.count("*").alias("rows"))


#: The bucket of 0.
NOTHING = -(10**6)


def merged(s: DataFrame, *by: str) -> DataFrame:
    return s.groupBy(*by, "measure", "bucket").agg(F.sum("rows").alias("rows"))


def fences(s: DataFrame, *by: str) -> DataFrame:
    """One row a group of a sketch: n, its middling sizes, and for each measure
    the fence. It lies REACH low-side distances above the lower quartile, as a
    proportion, and then as far again as REACH counts make in a middling text,
    since no ratio of such a text can be told more finely.

    The distance is the smaller of those from the lower quartile up to the
    median and down to the twentieth. Junk lies above the rest: under half of
    it leaves both, under three quarters the quartile and the lower one, and
    odd low values move the lower one only. It is a bucket's width at least, as a
    sketch tells nothing finer. Where most texts have none of what is counted the
    quartile is 0 and the middling size alone tells.
    """
    w = Window.partitionBy(*by, "measure")
    s = s.withColumn("n", F.sum("rows").over(w)).withColumn("upto", F.sum("rows").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    value = F.when(F.col("bucket") == NOTHING, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    q = {5: "q05", 25: "q25", 50: "q50"}
    g = s.groupBy(*by, "measure").agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") * 100 >= p * F.col("n"), value)).alias(a) for p, a in q.items()])
    g = g.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == m, F.col(a))).alias(f"{m}_{a}") for m in MEASURES for a in q.values()], *[F.max(F.when(F.col("measure") == x, F.col("q50"))).alias(f"typical_{x}") for x in SIZES])

    def fence(m: str):
        low, mid, high = (F.col(f"{m}_{a}") for a in ("q05", "q25", "q50"))
        spread = F.greatest(F.least(F.log(high / mid), F.when(low > 0, F.log(mid / low))), F.lit(math.log(GAMMA)))
        return F.when(mid > 0, mid * F.exp(REACH * spread)).otherwise(F.lit(0.0)) + REACH / F.greatest(F.col(f"typical_{MEASURES[m][1]}"), F.lit(1.0))

    return g.select(*by, "n", *[f"typical_{x}" for x in SIZES], *[fence(m).alias(f"fence_{m}") for m in MEASURES])


#: What a verdict needs of a group.
LIMITS = [*(f"fence_{m}" for m in MEASURES), *(f"typical_{x}" for x in SIZES)]


def limits(s: DataFrame) -> DataFrame:
    """LIMITS of each language and source of a sketch: means of the group's own
    fences and sizes, weighted by its rows, and of its language's, made from the
    same sketches, weighted by LEAST_ROWS; so no number of rows turns a verdict
    by itself, and a group of a few rows is judged much like its language."""
    own, wide = fences(s, "lang", "source"), fences(merged(s, "lang"), "lang")
    both = own.alias("g").join(wide.alias("l"), "lang")
    return both.select("lang", "source", *[((F.col("g.n") * F.col(f"g.{x}") + LEAST_ROWS * F.col(f"l.{x}")) / (F.col("g.n") + LEAST_ROWS)).alias(x) for x in LIMITS])


def judged(docs: DataFrame) -> DataFrame:
    """Figures of each row of ``docs`` with base_failed and kept.

    kept is false where the base rules fail, or where a measure lies above the
    fence of its language and source (limits()), and so does its count above
    what a middling text would have at the fence: one odd sign in a short text
    is no sign of junk. Sketches count all rows that pass the base rules; a group
    with none has no fence.

    Null texts count as empty and fail; null languages and sources form groups
    of their own. Repeated rows are each judged, alike; extra columns aren't
    read; an empty table gives an empty table.
    """
    none = F.lit("\0none")
    f = written(figures(docs).withColumn("base_failed", base_failed()).withColumn("lang", F.coalesce("lang", none)).withColumn("source", F.coalesce("source", none)), "figures")
    s = written(sketches(f.where("not base_failed"), "lang", "source"), "sketches")
    groups = written(limits(s), "fences")
    drop_written(s)
    f = joined(f, groups, ["lang", "source"], "left")
    over = F.lit(False)
    for m, (count, size) in MEASURES.items():
        fence = F.col(f"fence_{m}")
        over = over | F.coalesce((F.col(m) > fence) & (F.col(count) > fence * F.col(f"typical_{size}")), F.lit(False))
    back = [F.when(F.col(c) != none, F.col(c)).alias(c) for c in ("lang", "source")]
    return f.select("doc_id", "text_hash", *back, *COUNTS, *MEASURES, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that judged() keeps.

    The rejected rows' keys (id, text, language and source, which alone decide),
    fewer than the documents, are joined back: sent to all executors if they are
    small, shuffled otherwise. So nulls, repeated rows and repeated ids are each
    judged as in judged(); an empty table gives an empty table.
    """
    names = {"doc_id": "_d", "text_hash": "_h", "lang": "_l", "source": "_s"}
    with scope() as keep:
        gone = keep(written(judged(docs).where("not kept").select(*[F.col(c).alias(a) for c, a in names.items()]).distinct(), "rejected"))
    flat, c = numbered(docs)
    on = c("doc_id").cast("bigint").eqNullSafe(F.col("_d")) & (F.xxhash64(c("text")) == F.col("_h")) & c("lang").eqNullSafe(F.col("_l")) & c("source").eqNullSafe(F.col("_s"))
    return joined(flat, gone, on, "left_anti").toDF(*docs.columns)


def verdicts(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
