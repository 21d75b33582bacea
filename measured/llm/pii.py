"""Personal data: patterns propose spans, checksums confirm, context scores.

Base kinds are proposed by one pattern each, leftmost and non-overlapping:
email, ip, card (Luhn) and phone. An IBAN is added where its check digits hold
(mod 97), and a secret where a value that a name such as token announces looks
random by its entropy. Every span gets a score: that of its kind, raised by words nearby
that name the kind; scores order spans for redaction where two overlap.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, per_row, pick

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A value after a sign that assigns it.
VALUE = re.compile(r"[:=][ \t]{0,3}[\"'`]?([A-Za-z0-9+/_-]{16,})")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")

# Lengths of IBANs by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

# Score of a kind alone, and words nearby that raise it.
SCORE = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.6, "card_part": 0.5, "phone_part": 0.5}
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|adresse|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b", re.I),
    "secret": re.compile(r"\b(?:key|token|credential|auth|login|secret)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
}
AROUND, RAISE = 60, 0.25
# Names that announce a secret, at the end of what stands before the sign.
ANNOUNCED = re.compile(r"(?:token|secret|passwd|password|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|auth)[\"']?[ \t]{0,3}$", re.I)
#: Bits a character that a secret has at least.
RANDOM = 2.8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    """Matches of local@domain, leftmost first. The local part before an @ can
    only begin after the match before, or after the last other character."""
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and (text[start - 1] in LOCAL):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
            at = text.find("@", low)
        else:
            at = text.find("@", at + 1)


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[^0-9]+")


def cards(text: str):
    """Maximal runs of digits with single spaces or hyphens, those of 13 to 19
    digits that pass Luhn."""
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0]) if len(m[0]) <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str):
    for m in IBAN.finditer(text):
        size = IBAN_LENGTH.get(m[0][:2])
        if size is None:
            continue
        end, seen = m.start(), 0
        for c in m[0]:
            if seen == size:
                break
            seen += c != " "
            end += 1
        value = text[m.start() : end].replace(" ", "")
        if len(value) == size and not text[end : end + 1].isalnum() and mod97(value):
            yield m.start(), end


def entropy(x: str) -> float:
    """Bits a character, by how often each occurs."""
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())


def secrets(text: str):
    """Values of 16 characters or more, with digits and letters, that a name
    announces and whose characters are spread as at random."""
    for m in VALUE.finditer(text):
        x = m[1]
        if ANNOUNCED.search(text, max(0, m.start() - 24), m.start()) and DIGIT.search(x) and not x.isdigit() and entropy(x) >= RANDOM:
            yield m.span(1)


def apart(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def inside(text: str, spans: list[tuple[int, int]]):
    """Cards and phones hidden in a longer run of digits that fails as a whole,
    however long it is.

    A run is cut at its separators; the first and longest sequence of whole
    groups that passes Luhn with 13 to 19 digits is a card. Of a + run with
    too many digits, the longest beginning of whole groups with 9 to 15 is a
    phone. Spans that hold a base span are left alone.
    """

    def free(a: int, b: int) -> bool:
        i = bisect_right(ends, a)
        return i == len(starts) or b <= starts[i]

    taken = list(spans)
    starts, ends = apart(taken)
    for m in PHONE.finditer(text):
        n, end = 0, None
        for g in GROUP.finditer(text, *m.span()):
            n += g.end() - g.start()
            if n > 15:
                break
            end = g.end() if n >= 9 else None
        else:
            continue
        if end is not None and free(*m.span()):
            taken.append((m.start(), end))
            yield "phone_part", m.start(), end
    #: Runs and the cards of a run do not overlap, so only these spans count.
    starts, ends = apart(taken)
    for m in CARD.finditer(text):
        if len(m[0]) <= 19 and not free(*m.span()):
            continue
        groups = [g.span() for g in GROUP.finditer(text, *m.span())]
        upto = [0, *accumulate(b - a for a, b in groups)]
        i = 0
        while i < len(groups):
            for k in range(min(len(groups), i + 19), i, -1):
                a, b = groups[i][0], groups[k - 1][1]
                if 13 <= upto[k] - upto[i] <= 19 and free(a, b) and luhn(DIGITS.sub("", text[a:b])):
                    yield "card_part", a, b
                    i = k - 1
                    break
            i += 1


def found(text: str) -> list[tuple[str, int, int]]:
    """Spans of a text: base kinds as listed, then IBANs, then cards and
    phones inside longer runs, then secrets, each by start.

    Where a text has neither digit nor @ nothing can match.
    """
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)]
        out += [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
        out += [("iban", *s) for s in ibans(text)]
        out += inside(text, [s[1:] for s in out])
        out += [("secret", *s) for s in secrets(text)]
    return out


DIGIT = re.compile(r"[0-9]")
GROUP = re.compile(r"[0-9]+")


def scored(text: str, spans: list[tuple[str, int, int]]) -> list[float]:
    return [min(1.0, SCORE[k] + RAISE * bool(CONTEXT[k.removesuffix("_part")].search(text, max(0, a - AROUND), b + AROUND))) for k, a, b in spans]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap the
    best scored, then longest, then first names the whole stretch."""
    ranked = sorted(((a, b, s, k) for (k, a, b), s in zip(spans, scored(text, spans), strict=True)), key=lambda x: x[:2])
    out, at, i = [], 0, 0
    while i < len(ranked):
        a, b, *_ = ranked[i]
        group = [ranked[i]]
        i += 1
        while i < len(ranked) and ranked[i][0] < b:
            group.append(ranked[i])
            b = max(b, ranked[i][1])
            i += 1
        best = max(group, key=lambda x: (x[2], x[1] - x[0], -x[0]))
        out += [text[at:a], f"[{best[3].removesuffix('_part').upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) of each row.

    Offsets are code points, end exclusive. Null and empty texts have no
    spans; repeated rows and ids each give a row of their own; columns other
    than doc_id and text are not read; an empty table gives an empty table.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    arrow = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(kind))])

    def rows(b):
        out = []
        for x in b.column(1).to_pylist():
            s = found(x or "")
            out.append([{"kind": k, "start": a, "end": e, "score": c} for (k, a, e), c in zip(s, scored(x or "", s), strict=True)])
        return b.column(0), out

    return per_row(pick(docs, ("doc_id", "bigint"), ("text", "string")), "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>", rows, arrow)


def digests(docs: DataFrame, total: bool = False) -> DataFrame:
    """The spans of each row as counts, a digest of the base spans, text of all
    spans and, with ``total``, n_found, the number of all."""
    s = spans(docs)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_kind = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    base = of_kind(*KINDS)
    return s.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        *[F.size("spans").cast("bigint").alias("n_found")] * total,
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, and
    n_chars set to the new length where there is such a column.

    All other columns pass unchanged, extra and clashing ones too; null texts
    stay null, empty ones empty. Rows are redacted one by one, so repeated rows
    and ids do no harm; an empty table gives an empty table.
    """
    flat, c = numbered(docs)

    @F.pandas_udf("string")
    def clean(column):
        return column.map(lambda x: redact(x, s) if x and (s := found(x)) else x)

    n = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    t = docs.columns.index("text")
    out = flat.withColumn(f"_{t}", clean(c("text")))
    return (out.withColumn(f"_{n}", F.length(f"_{t}").cast(docs.schema.fields[n].dataType)) if n >= 0 else out).toDF(*docs.columns)
