"""Adaptive thresholds against exact quantiles, and what moves them."""

import collections
import math
import random

from measured.llm import quality

from . import cases


def plain_figures(text):
    w = cases.words(text)
    joined = "".join(w)
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    plain = [c for c in joined if c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or ord(c) > 127]
    counts = {
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_punctuation": len(joined) - len(plain),
        "n_capitals": sum("A" <= c <= "Z" for c in joined),
        "n_dup_lines": len(lines) - len(set(lines)),
        "word_chars": len(joined),
        "n_lines": len(lines),
        "n_words": len(w),
    }
    return counts, {m: counts[c] / counts[n] if counts[n] else 0.0 for m, (c, n) in quality.MEASURES.items()}


def at(values, share):
    s = sorted(values)
    return s[max(0, math.ceil(share * len(s)) - 1)]


def plain_limits(rows):
    """Fences and middling sizes of some rows' figures, by exact quantiles."""
    out = {f"typical_{x}": at([c[x] for c, _ in rows], 0.5) for x in quality.SIZES}
    for m, (_, size) in quality.MEASURES.items():
        q05, q25, q50 = (at([v[m] for _, v in rows], q) for q in (0.05, 0.25, 0.5))
        grow = min([math.log(q50 / q25), *([math.log(q25 / q05)] if q05 > 0 else [])]) if q25 > 0 else 0
        out[f"fence_{m}"] = q25 * math.exp(quality.REACH * max(grow, math.log(quality.GAMMA))) + quality.REACH / max(1, out[f"typical_{size}"])
    return len(rows), out


def plain_kept(rows, slack=1.0):
    """For each row whether it is kept; fences times ``slack``."""
    figures = [plain_figures(t) for _, t, *_ in rows]
    good = [c["n_words"] >= 10 and not quality.measured((t or "").encode())[4] * 100 > 20 * c["n_words"] for (c, _), (_, t, *_) in zip(figures, rows, strict=True)]
    of = collections.defaultdict(list)
    for f, ok, (_, _, lang, source, _) in zip(figures, good, rows, strict=True):
        if ok:
            of[lang, source].append(f)
            of[lang].append(f)
    made = {k: plain_limits(v) for k, v in of.items()}
    out = []
    for (counts, values), ok, (_, _, lang, source, _) in zip(figures, good, rows, strict=True):
        if ok:
            (n, own), (_, wide) = made[lang, source], made[lang]
            x = {k: (n * own[k] + quality.LEAST_ROWS * wide[k]) / (n + quality.LEAST_ROWS) for k in own}
            ok = not any(values[m] > slack * x[f"fence_{m}"] and counts[c] > slack * x[f"fence_{m}"] * x[f"typical_{size}"] for m, (c, size) in quality.MEASURES.items())
        out.append(ok)
    return out


def prose(r, n, odd=0.0, signs="#$", long=1):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9) * long)) + (r.choice(signs) if r.random() < odd else "") + r.choice(["", "", "", ".", ","]) + ("\n" if r.random() < 0.1 else "") for _ in range(n))


def test_verdicts_against_exact_quantiles(spark):
    r = random.Random(3)
    rows = []
    for source, lang, n, odd in (("plain", "en", 400, 0.002), ("code", "en", 300, 0.25), ("small", "en", 7, 0.0), ("plain", "de", 150, 0.0), (None, "de", 60, 0.05), ("junk", None, 90, 0.01)):
        for _ in range(n):
            rows.append((len(rows), prose(r, r.randint(15, 300), r.choice([odd] * 9 + [0.9]), long=1 if r.random() < 0.97 else 3), lang, source, 1))
    got = {x.doc_id: x.kept for x in quality.verdicts(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    tight, wide = plain_kept(rows, 1 / 1.25), plain_kept(rows, 1.25)
    sure = [(d, a) for (d, *_), a, b in zip(rows, tight, wide, strict=True) if a == b]
    assert len(sure) > 0.95 * len(rows) and 50 < sum(not a for _, a in sure) < 200
    assert all(got[d] == a for d, a in sure)


def test_a_source_of_another_style_moves_the_verdict(spark):
    r = random.Random(4)
    same = prose(r, 100, 0.3)
    for odd, kept in ((0.0, False), (0.3, True)):
        rows = [(i, prose(r, 100, odd), "en", "s", 1) for i in range(300)] + [(1000, same, "en", "s", 1)]
        got = {x.doc_id: x.kept for x in quality.verdicts(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
        assert got[1000] == kept and all(got[i] for i in range(300))


def test_one_sign_in_a_short_text_is_kept(spark):
    r = random.Random(5)
    rows = [(i, prose(r, 150), "en", "s", 1) for i in range(200)] + [(500, "a short text & ten words that are not junk at all", "en", "s", 1)]
    assert quality.verdicts(spark.createDataFrame(rows, cases.SCHEMA)).where("kept").count() == 201


def test_rows_alike_but_for_their_source_are_kept_by_their_own(spark):
    r = random.Random(6)
    same = prose(r, 100, 0.3)
    rows = [(i, prose(r, 100, odd), lang, s, 1) for i, (lang, s, odd) in enumerate([("en", "plain", 0.0)] * 300 + [("fr", "code", 0.3)] * 300)]
    both = [(5000, same, "en", "plain", 1), (5000, same, "fr", "code", 1), (5000, same, None, None, 1)]
    df = spark.createDataFrame(rows + both, cases.SCHEMA)
    left = quality.kept(df).where("doc_id = 5000").collect()
    assert quality.judged(df).where("kept").count() == quality.kept(df).count()
    assert {x.source for x in left} == {"code", None}


def test_quality_of_very_long_and_odd_texts(spark):
    rows = [(1, "word and other things " * 200_000, "en", "s", 1), (2, "x" * 3_000_000, "en", "s", 1), (3, "\n" * 100_000, "en", "s", 1), (4, " ".join(f"w{i}" for i in range(300_000)), "en", "s", 1), (4, None, None, None, None)]
    got = quality.verdicts(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert sorted((x.doc_id, x.n_words, x.base_failed) for x in got) == [(1, 800_000, True), (2, 1, True), (3, 0, True), (4, 0, True), (4, 300_000, False)]
