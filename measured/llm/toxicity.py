"""Toxicity: learned terms, found misspelled too, weighed by their context.

Terms are words and beginnings of words that labelled toxic documents hold far
more often than others. They form a trie; each word of a text is run through
the trie together with a Levenshtein automaton of one edit, so that misspelled
terms are found. Every hit counts by how it was found (exact, beginning,
misspelled) and whether its context quotes it; a small logistic model over
these counts and the densest window gives the score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, per_row, pick, reach, scope, written

#: Labelled rows that a model is learned from, at most, by hash of doc_id.
MOST_LABELLED = 20_000
#: Evidence (likelihood ratio statistic) and share of toxic documents needed.
LEAST_EVIDENCE, LEAST_SHARE = 20.0, 0.9
BEGINNINGS = (4, 5, 6, 7)
#: Terms shorter than this are matched exactly.
FUZZY_FROM = 5
#: Words on each side that may quote a hit, and words of a density window.
AROUND, WINDOW = 4, 25

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")

# Letters written for others, and words that report speech.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
REPORTING = frozenset("said says saying word words term called quote quoted quotes wrote writes mot dit wort sagte palabra dijo".split())
QUOTES = "\"'“”‘’«»„‹›"

FEATURES = ("exact", "beginning", "misspelled", "quoted", "densest", "share")


class Terms:
    """Terms with weights, as a trie.

    ``words`` are matched whole, ``stems`` at the beginning of a word.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], most: int = 300_000):
        self.root: dict = {}
        for kind, terms in (("word", words), ("stem", stems)):
            for t, w in terms.items():
                node = self.root
                for c in t:
                    node = node.setdefault(c, {})
                node[kind] = (t, w)
        self.kept: dict[str, tuple | None] = {}
        self.most = most

    def walk(self, node: dict, word: str, i: int):
        """Terms spelled exactly by word[i:] from a node on."""
        while True:
            if "stem" in node:
                yield "beginning", *node["stem"]
            if i == len(word):
                if "word" in node:
                    yield "exact", *node["word"]
                return
            node = node.get(word[i])
            if node is None:
                return
            i += 1

    def matches(self, word: str):
        """Terms within one edit of a word: the automaton's states are a place
        in the word and whether the edit is spent; each step follows the trie's
        branches, so states no term can reach are never entered."""
        yield from self.walk(self.root, word, 0)
        node, i, n = self.root, 0, len(word)
        if n < FUZZY_FROM - 1:
            return
        while node is not None:
            spent = [(node, i + 1)] if i < n else []  # a letter too many
            for c, below in node.items():
                if len(c) == 1:
                    spent.append((below, i))  # a letter missing
                    if i < n and c != word[i]:
                        spent.append((below, i + 1))  # another letter
                    if i + 1 < n and c == word[i + 1] and (after := below.get(word[i])) and len(word[i]) == 1:
                        spent.append((after, i + 2))  # two letters swapped
            for start, at in spent:
                for _, t, w in self.walk(start, word, at):
                    if len(t) >= FUZZY_FROM:
                        yield "misspelled", t, w
            node = node.get(word[i]) if i < n else None
            i += 1

    def hit(self, word: str) -> tuple[str, float] | None:
        """How a word is a term, and the weight: exact before beginning before
        misspelled, the heaviest of each."""
        if word in self.kept:
            return self.kept[word]
        order = ("exact", "beginning", "misspelled")
        best = None
        for w in {word, word.translate(LOOKALIKE)}:
            for kind, _, weight in self.matches(w):
                k = order[2] if w != word else kind
                if best is None or (order.index(k), -weight) < (order.index(best[0]), -best[1]):
                    best = (k, weight)
        if len(self.kept) < self.most and len(word) < 40:
            self.kept[word] = best
        return best

    def features(self, text: str) -> tuple[list[float], list[tuple[int, int, str, bool]]]:
        """FEATURES of a text, and its hits as start, end, kind and quoted."""
        x = dict.fromkeys(FEATURES, 0.0)
        kept, hit = self.kept, self.hit
        low = SPELLED.sub(lambda m: m[0].translate(LOOKALIKE), text.lower())
        tokens = TOKEN.findall(low)
        found = [(i, h) for i, w in enumerate(tokens) if (h := kept[w] if w in kept else hit(w))]
        if not found:
            return [0.0] * len(FEATURES), []
        spans = [m.span() for m in TOKEN.finditer(low)]
        places, hits = [], []
        for i, (kind, weight) in found:
            a, b = spans[i]
            near = tokens[max(0, i - AROUND) : i]
            quoted = bool(low[a - 1 : a] in tuple(QUOTES) and a and low[b : b + 1] and low[b : b + 1] in QUOTES) or any(w in REPORTING for w in near)
            hits.append((a, b, kind, quoted))
            x["quoted" if quoted else kind] += weight
            if not quoted:
                places.append((i, weight))
        at, total = 0, 0.0
        for k, (i, w) in enumerate(places):
            total += w
            while places[at][0] <= i - WINDOW:
                total -= places[at][1]
                at += 1
            x["densest"] = max(x["densest"], total)
        x["share"] = 20.0 * len(places) / len(tokens)
        return [math.log1p(max(0.0, v)) for v in x.values()], hits


#: Stand-ins for letters inside a word, such as in "l@dder".
SPELLED = re.compile(r"(?<=[a-z])[@$!](?=[a-z])")


def contexts(rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """term and n: in how many different contexts (words before) each word and
    beginning of words stands in the texts of ``rows``; of ``only``, a written
    table, these terms.

    Copies of a document repeat its words in one context, so they don't count.
    """

    def run(batches):
        for b in batches:
            found: set[tuple[str, str]] = set()
            for text in b.column(0).to_pylist():
                before = ""
                for w in TOKEN.findall(text.lower()):
                    found.add((f"w:{w}", before))
                    found.update((f"s:{w[:k]}", before) for k in BEGINNINGS if len(w) > k)
                    before = w
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["term", "before"])

    pairs = rows.select("text").mapInArrow(run, "term string, before string")
    pairs = pairs if only is None else joined(pairs, only.select("term"), "term", "left_semi")
    return pairs.distinct().groupBy("term").agg(F.count("*").alias("n"))


def evidence(a: float, n: float, b: float, m: float) -> float:
    """Likelihood ratio statistic of a in n against b in m."""

    def part(k: float, of: float, p: float) -> float:
        return (k * math.log(k / (of * p)) if k else 0.0) + ((of - k) * math.log((of - k) / (of * (1 - p))) if k < of else 0.0)

    p = (a + b) / (n + m)
    return 2 * (part(a, n, p) + part(b, m, p)) if 0 < p < 1 else 0.0


class Model:
    def __init__(self, terms: Terms, weights: np.ndarray, bias: float):
        self.terms, self.weights, self.bias = terms, weights, bias

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, self.terms.features(text)[0])) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 50, decay: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, with a penalty on the weights;
    weights of hits can't fall below zero."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    pull = np.diag([decay] * x.shape[1] + [1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
        w = w + step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of labelled rows outside the held-out fifth, of which up
    to MOST_LABELLED, the smallest by hash of doc_id, are used. Of documents with
    one doc_id the least text is learned from, once for each of its labels."""
    d = pick(docs, ("doc_id", "bigint"), ("text", "string"))
    own = pick(labels, ("doc_id", "bigint"), ("toxic", "int")).where("toxic in (0, 1)")
    rows = own.where(~held_out("doc_id")).distinct().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "toxic").limit(MOST_LABELLED)
    return d.join(F.broadcast(rows.select("doc_id", "toxic")), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "toxic")


def held_out(column: str):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled rows. Counts of terms are made by Spark; the
    driver gets the terms that tell, of a sample of bounded size, and the
    features of that sample.

    Without toxic and other rows nothing is learned and every score is the
    share of toxic rows, or 0.
    """
    reach(docs.sparkSession)
    with scope():
        rows = written(sample(docs, labels), "labelled")
        n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
        pos, neg = n.get(1, 0), n.get(0, 0)
        if not pos or not neg:
            return Model(Terms({}, {}), np.zeros(len(FEATURES)), 30.0 if pos else -30.0)
        #: A term in k contexts of toxic texts has at most the evidence of one that no other text has.
        least = next((k for k in range(1, pos + 1) if evidence(k, pos, 0, neg) >= LEAST_EVIDENCE), pos + 1)
        toxic = written(contexts(rows.where("toxic = 1")).where(F.col("n") >= least), "terms")
        both = joined(toxic, written(contexts(rows.where("toxic = 0"), toxic).withColumnRenamed("n", "m"), "others"), "term", "left").fillna(0, ["m"])
        cut = [F.least(F.col(c), F.lit(of)).alias(c) for c, of in (("n", pos), ("m", neg))]
        tells = (F.col("n") / pos > 4 * F.col("m") / neg) & (F.col("n") >= LEAST_SHARE * (F.col("n") + F.col("m")))
        found = [(e, *r) for r in both.select("term", *cut).where(tells).collect() if (e := evidence(r["n"], pos, r["m"], neg)) >= LEAST_EVIDENCE]
        weight = {t: math.log(((n + 0.5) / (pos + 1)) / ((m + 0.5) / (neg + 1))) for _, t, n, m in found}
        words = {t[2:]: w for t, w in weight.items() if t[0] == "w"}
        stems = {t[2:]: w for t, w in weight.items() if t[0] == "s" and t[2:] not in words}
        #: A stem stands for others below it only if it tells more than one word.
        order = sorted(words)
        under = lambda x: bisect_left(order, x + chr(0x10FFFF)) - bisect_left(order, x)
        stems = {x: w for x, w in stems.items() if under(x) != 1 and not any(x[:k] in stems for k in BEGINNINGS if k < len(x))}
        terms = Terms(words, stems)
        sent = docs.sparkSession.sparkContext.broadcast(terms)
        arrow = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

        def measure(b):
            return b.column(1), [sent.value.features(t)[0] for t in b.column(0).to_pylist()]

        got = per_row(rows, "toxic int, x array<double>", measure, arrow).toPandas()
        return Model(terms, *fitted(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["toxic"].to_numpy(float)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text is a multiple of 5), score (0
    to 1) and predicted (1 from 0.5) of each row of ``docs``.

    Labels are learned from rows that aren't held out. Only texts are judged:
    null and empty ones have no hits. A null id counts as an empty text for
    held_out. Repeated rows are each scored, alike; extra columns aren't read;
    an empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    d = pick(docs, ("doc_id", "bigint"), ("text", "string"))

    def rows(b):
        s = [model.value.score(x or "") for x in b.column(2).to_pylist()]
        return b.column(0), b.column(1), s, [int(x >= 0.5) for x in s]

    return per_row(d.select("doc_id", held_out("doc_id").alias("held_out"), "text"), "doc_id bigint, held_out boolean, score double, predicted int", rows, arrow)
