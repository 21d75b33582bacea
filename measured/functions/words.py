"""Word search and patterns over plain text columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import reach
from . import stems


def tokens(text: Column) -> Column:
    """Lower-case words of a text, letters and digits of any script, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def english(text: Column) -> Column:
    """Stems of the words of a text, in their places; a stop word is empty. Each
    batch stems a word once."""
    reach(SparkSession.active())

    @F.pandas_udf("array<string>")
    def stemmed(rows):
        return rows.map(lambda ws: None if ws is None else ["" if w in stems.STOP else stems.stem(w) for w in ws])

    return stemmed(tokens(text))


@dataclass(frozen=True)
class Query:
    """A word, or a combination: 'and', 'or', 'not', 'phrase'; 'nothing' finds no
    row. In a phrase None is any word."""

    op: str
    of: tuple

    def __and__(self, other: Query) -> Query:
        return Query("and", (self, other))

    def __or__(self, other: Query) -> Query:
        return Query("or", (self, other))

    def __invert__(self) -> Query:
        return Query("not", (self,))


def word(w: str) -> Query:
    return Query("word", (w.lower(),))


def phrase(*words: str) -> Query:
    return Query("phrase", tuple(w.lower() for w in words))


NOTHING = Query("nothing", ())


def stemmed(q: Query) -> Query:
    """A query whose words are stems. Stop words fall away: a query of nothing
    else finds no row, and in a phrase any word stands for one."""
    if q.op == "word":
        return NOTHING if q.of[0] in stems.STOP else Query("word", (stems.stem(q.of[0]),))
    if q.op == "phrase":
        own = [None if w in stems.STOP else stems.stem(w) for w in q.of]
        while own and own[0] is None:
            own.pop(0)
        while own and own[-1] is None:
            own.pop()
        return Query("phrase" if len(own) > 1 else "word", tuple(own)) if own else NOTHING
    parts = [x for x in map(stemmed, q.of) if x != NOTHING]
    if not parts:
        return NOTHING
    return Query(q.op, tuple(parts)) if len(parts) == len(q.of) else parts[0]


def parse(text: str, stem: bool = False) -> Query:
    """Reads words, as stems if ``stem``, with &, |, !, <-> and parentheses. Weights and prefixes
    (word:A, word:*) are refused."""
    toks = re.findall(r"<->|[&|!()]|[^\s&|!()<]+", text)
    at = 0

    def peek() -> str | None:
        return toks[at] if at < len(toks) else None

    def take() -> str:
        nonlocal at
        at += 1
        return toks[at - 1]

    def single() -> Query:
        t = take()
        if t == "!":
            return ~single()
        if t == "(":
            q = either()
            if take() != ")":
                raise ValueError(f"no ) in {text!r}")
            return q
        if ":" in t:
            raise ValueError(f"weights and prefixes aren't supported: {t}")
        return word(t)

    def adjacent() -> Query:
        q = single()
        while peek() == "<->":
            take()
            n = single()
            if q.op not in ("word", "phrase") or n.op != "word":
                raise ValueError("only words can be adjacent")
            q = Query("phrase", q.of + n.of)
        return q

    def both() -> Query:
        q = adjacent()
        while peek() == "&":
            take()
            q = q & adjacent()
        return q

    def either() -> Query:
        q = both()
        while peek() == "|":
            take()
            q = q | both()
        return q

    q = either()
    if peek() is not None:
        raise ValueError(f"can't read {text!r} from {peek()!r}")
    return stemmed(q) if stem else q


def matches(words: Column, q: Query) -> Column:
    """Whether an array of words satisfies a query."""
    if q.op == "nothing":
        return F.lit(False)
    if q.op == "word":
        return F.array_contains(words, q.of[0])
    if q.op == "phrase":
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        if None in q.of:
            return joined.rlike(" " + " ".join("[^ ]*" if w is None else re.escape(w) for w in q.of) + " ")
        return joined.contains(" " + " ".join(q.of) + " ")
    if q.op == "not":
        return ~matches(words, q.of[0])
    a, b = (matches(words, x) for x in q.of)
    return a & b if q.op == "and" else a | b


def share(q: Query, of) -> float:
    """Share of rows a query holds, taking words as independent: AND and
    phrase multiply, OR adds less the product, NOT is the rest. ``of`` gives
    a word's share."""
    if q.op == "nothing":
        return 0.0
    if q.op in ("word", "phrase"):
        return math.prod(of(w) for w in q.of if w is not None)
    if q.op == "not":
        return 1.0 - share(q.of[0], of)
    a, b = (share(x, of) for x in q.of)
    return a * b if q.op == "and" else a + b - a * b


def caseless(pattern: str) -> bool:
    """Whether a pattern has no letter that has a case."""
    return pattern.lower() == pattern.upper()


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one
    after it."""
    def of(w: Column) -> Column:
        p = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(tokens(text), of)))


def required(pattern: str) -> list[str]:
    """Trigrams that every text matching a LIKE pattern must hold: those
    inside its constant stretches, padded where a stretch is a word's edge."""
    out: list[str] = []
    parts = re.split(r"(?<!\\)[%_]", pattern.lower())
    for i, part in enumerate(parts):
        for m in re.finditer(r"[^\W_]+", part):
            left = "  " if m.start() or i == 0 and not pattern.startswith(("%", "_")) else ""
            right = " " if m.end() < len(part) or i == len(parts) - 1 and not pattern.endswith(("%", "_")) else ""
            p = left + m[0] + right
            out += [p[k : k + 3] for k in range(len(p) - 2)]
    return list(dict.fromkeys(out))
