"""Each operator against a plain version on awkward rows, and on no rows."""

import collections
import random
import re
import textwrap

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from measured.llm import decontaminate, licenses, ngram_join, pieces, pii, quality, substrings, tokens, toxicity, warc
from measured.llm.components import components

from . import cases

MODEL, VOCAB = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "extra columns"])
def docs(spark, request):
    return cases.documents(spark, request.param)


@pytest.fixture(scope="module")
def bench(spark):
    t = [r[1] for r in cases.rows()]
    return spark.createDataFrame([(1, t[6]), (10, "a b c d"), (2, None), (3, ""), (4, t[3][:200]), (4, "one"), (None, t[30])], "item_id bigint, text string")


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def test_pii(docs):
    want = collections.Counter()
    for d, t, *_ in cases.rows():
        s = plain_pii(t or "")
        want[d, *[sum(x[0] == k for x in s) for k in pii.KINDS], cases.sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))] += 1
    assert cases.bag(pii.digests(docs).drop("spans")) == want


def test_pii_base_spans_by_chance():
    r = random.Random(2)
    for letters in ("ab.@-1+ é%", "0123456789. -", "0123.", "+0123456789 ().-a", "05 -"):
        for _ in range(2000):
            x = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert [s for s in pii.found(x) if s[0] in pii.KINDS] == plain_pii(x)


def test_pii_adds_spans_and_redacts(spark):
    x = "mail a@b.c x +1 (956) 555-2186 4041894974608795 GB82 WEST 1234 5698 7654 32"
    assert pii.redact(x, pii.found(x)) == "mail [EMAIL] x [PHONE] [CARD] [IBAN]"
    assert not pii.mod97("GB83WEST12345698765432") and pii.found("") == []
    df = spark.createDataFrame([(1, x, 9), (2, None, None)], "doc_id bigint, text string, n_chars bigint")
    assert [tuple(r) for r in pii.redacted(df).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] x [PHONE] [CARD] [IBAN]", 36), (2, None, None)]
    pii.found("1" * 300_000 + "@" + "1." * 100_000 + "+1" * 100_000)


def test_pii_in_long_runs():
    kinds = lambda x: collections.Counter(k for k, *_ in pii.found(x))
    assert kinds(" ".join(["4041894974608795"] * 30)) == {"card_part": 30}
    row = " ".join(["7"] * 600)
    assert ("card_part", 1200, 1216) in pii.found(row + " 4041894974608795 " + row)
    assert pii.found("+1 956 555 2186 " + "(" * 300 + "123456789")[0] == ("phone_part", 0, 15)
    x = " ".join(["4041894974608795"] * 30)
    assert pii.redact(x, pii.found(x)) == " ".join(["[CARD]"] * 30)
    pii.found(" ".join(["4041894974608795"] * 30_000) + "+" + "1 " * 200_000)


def test_token_counts(docs):
    t = tokenizers.Tokenizer.from_file(VOCAB)
    want = collections.Counter((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 20) for d, x, *_ in cases.rows())
    assert cases.bag(tokens.counted(docs, VOCAB, 20)) == want


def test_token_counts_by_chance_and_prefixes():
    t, c, r = tokenizers.Tokenizer.from_file(VOCAB), tokens.counter(VOCAB), random.Random(1)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    parts = ["a", "b", " ", "é", "日", "Σ", "\x00", "\t", "1", "the", "ing", "☃", "🎉", "́", "<|endoftext|>", "'s", "'ll", "\xa0", "\x85", "\x1c", "İ", "!!", "²", "Ⅷ"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        assert c.count(x) == count(x)
    for w in ("international", "thing", "a" * 50, "ünïcode"):
        assert c.prefixes(w) == [count(w[:i]) for i in range(len(w) + 1)]
    for budget in range(9):
        cut, n = c.cut("An international thing, she said: 42!", budget)
        assert n == count(cut) <= budget


def test_sentencepiece(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = collections.Counter()
    for d, x, *_ in cases.rows():
        ids = [*sp.encode(x or ""), sp.eos_id()]
        want[d, len(ids), cases.sha(" ".join(map(str, ids))), cases.sha(sp.decode(ids))] += 1
    assert cases.bag(pieces.digests(docs, MODEL)) == want


def test_sentencepiece_by_chance():
    sp, p, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.pieces(MODEL), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "▁", "\x00", "1", "the", "ing", "☃", "🎉", "<s>", "<0x41>", "    ", "了"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        ids = p.encode(x, end=False)
        assert ids == sp.encode(x) and p.decode(ids) == sp.decode(ids)
    for _ in range(1000):
        ids = [r.randrange(r.choice((270, 32000))) for _ in range(r.randint(1, 12))]
        assert p.decode(ids) == sp.decode(ids)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, 0, int("idiot" in (t or ""))) for i, t, *_ in cases.rows() if i is not None] + [(None, 0, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.scored(cases.empty(spark), labels).count() == 0
    assert toxicity.scored(docs, labels.limit(0)).count() == len(cases.rows())


def test_toxicity_terms():
    t = toxicity.Terms({"moron": 3.0, "idiot": 3.0}, {"lowei": 2.0})
    for w, kind in {"moron": "exact", "mor0n": "misspelled", "mron": "misspelled", "moroon": "misspelled", "omron": "misspelled", "idiit": "misspelled", "loweiung": "beginning"}.items():
        assert t.hit(w)[0] == kind, w
    assert t.hit("more") is None and t.hit("") is None
    quoted, plain = t.features('he said "moron"')[1][0], t.features("you moron")[1][0]
    assert quoted[3] and not plain[3]


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, was = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(was[j] + 1, d[-1] + 1, was[j - 1] + (x != y)))
    return d[-1]


def test_levenshtein_automaton_by_chance():
    r = random.Random(3)
    for _ in range(300):
        terms = {"".join(r.choice("abc") for _ in range(6)): 1.0 for _ in range(3)}
        t = toxicity.Terms(terms, {})
        w = "".join(r.choice("abc") for _ in range(r.randint(4, 7)))
        swaps = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        assert (t.hit(w) is not None) == (any(plain_distance(w, x) <= 1 for x in terms) or bool(swaps & set(terms)))


def test_toxicity_learns(spark, small):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scored(d, labels).collect()}
    told = [(got[r.doc_id], r.toxic) for r in labels.collect()]
    held = [(s.score, y) for s, y in told if s.held_out]
    pairs = [(a > b) + (a == b) / 2 for a, y in held for b, z in held if y > z]
    assert sum(pairs) / len(pairs) > 0.9
    assert sum(s.predicted for s, y in told if y == 0) <= 0.02 * len(told)


def test_licenses(docs, spark):
    got = [r for r in licenses.digests(docs).collect() if r.n_notices]
    assert {r.licenses for r in got} == {"MIT"} and len(got) == 1
    find = lambda x: [s[0] for _, _, b in licenses.blocks(x) if (s := licenses.scanned(b))]
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert find("Some words here.\n" + t + "\nmore words") == [name], t
    assert find("Licensed under the Apache License, version 2.0") == ["Apache-2.0"]
    assert find("the license of a driver was lost in the permission office") == []
    assert licenses.digests(cases.empty(spark)).count() == 0


def found_licenses(spark, *texts):
    got = licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")).collect()
    return [[(f.name, texts[r.doc_id][f.start : f.end]) for f in r.finds] for r in sorted(got)]


def test_licenses_finds_all_notices_of_a_line(spark):
    r = random.Random(12)
    prose = " ".join(r.choice(["the", "work", "of", "software", "copies", "any", "person", "license", "terms", "and", "this"]) for _ in range(300))
    two = "All rights reserved. Licensed under the Apache License, Version 2.0."
    got = found_licenses(spark, prose + " All rights reserved.", two, two + " " + prose + " " + two)
    names = ["All-rights-reserved", "Apache-2.0"]
    assert [[n for n, _ in x] for x in got] == [names[:1], names, names * 2]
    assert got[1] == [(names[0], "All rights reserved"), (names[1], "Licensed under the Apache License, Version 2.0")]


def test_licenses_finds_wrapped_notices(spark):
    want, texts = [], []
    for name, notices in licenses.TEMPLATES.items():
        for t in notices:
            for width in (12, 40, 72):
                for first in ("", "# ", " * "):
                    lines = textwrap.wrap(t, width, initial_indent=first, subsequent_indent=first, break_long_words=False, break_on_hyphens=False)
                    texts.append("int x = 1;\n\n" + "\n".join(lines) + "\n\nand other words\n")
                    want.append((name, "\n".join(lines)[len(first) :].rstrip(".")))
    got = found_licenses(spark, *texts)
    assert [x[0] for x in got] == want and all(len(x) == 1 for x in got)


def test_warc(spark):
    pages = [(1, "http://a.org/x?y#z", "<p>é</p>"), (2, "https://b.org", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "http://a.org/\r\nx", None), (3, "u", ""), (None, "http://c", "WARC/1.1\r\n\r\nContent-Length: 0\r\n\r\n"), (7, "http://d", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'k' as number", "1 as URL")
    got = warc.round_trip(df).collect()
    import base64
    import hashlib

    assert len(got) == len(pages)
    want = collections.Counter((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, _, h in pages)
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(1, 2), (2, 2), (3, 5)]
    assert sum(r.record_type == "response" for r in got) == 4
    assert warc.round_trip(df.limit(0)).count() == 0
    whole = warc.captures(warc.records(spark, warc.written_archives(df))).collect()
    assert len(whole) == len(pages) and all(r.request and r.metadata and r.request.peer == r.capture for r in whole)
    assert {bytes(r.response.payload).decode() for r in whole if r.response.type == "response"} == {h or "" for _, _, h in pages}


def plain_quality(text):
    w = cases.words(text)
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality(docs, spark):
    got = quality.verdicts(docs).collect()
    assert collections.Counter(tuple(r)[:-1] for r in got) == collections.Counter((d, *plain_quality(t)) for d, t, *_ in cases.rows())
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality.verdicts(cases.empty(spark)).count() == 0
    assert quality.kept(docs).count() == sum(r.kept for r in got)


def test_quality_thresholds(spark):
    clean = [(i, "some plain words that are all different number " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(f"v{i}x{j}***" for j in range(30)), "en", "s", 1) for i in range(30)]
    kept = {r.doc_id for r in quality.verdicts(spark.createDataFrame(clean + junk, cases.SCHEMA)).where("kept").collect()}
    assert kept == set(range(300))


def styled(i, n_junk, n, source, end="***"):
    """n rows of a source, of which the first n_junk have words with such ends."""
    return [(i + k, " ".join(f"v{i + k}x{j}{end if k < n_junk else ''}" for j in range(30)), "en", source, 1) for k in range(n)]


def test_quality_of_sources_with_much_junk(spark):
    rows, junk = [], set()
    for i, share in enumerate((30, 45, 60)):
        rows += styled(1000 * i, 2 * share, 200, f"s{share}")
        junk |= set(range(1000 * i, 1000 * i + 2 * share))
    got = quality.verdicts(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert not any(r.base_failed for r in got) and {r.doc_id for r in got if not r.kept} == junk


def test_quality_does_not_turn_at_a_number_of_rows(spark):
    rows = [x for i in range(4) for x in styled(1000 * i, 0, 300, f"plain{i}")]
    alike = [(9000, 98, "a"), (10000, 102, "b")]
    for at, n, source in alike:
        rows += [(d, t.replace("x", "*", 18), *_) for d, t, *_ in styled(at, 0, n, source)]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert all(got[at + k] for at, n, _ in alike for k in range(n))


def test_sketch_merges_like_counting(spark):
    df = quality.figures(cases.documents(spark)).withColumn("lang", quality.F.coalesce("lang", quality.F.lit("")))
    one = quality.merged(quality.sketches(df, "lang", "source"), "lang")
    assert cases.bag(one) == cases.bag(quality.sketches(df, "lang"))


def plain_substrings(rows, w):
    seen = collections.Counter()
    for _, t, *_ in rows:
        x = cases.words(t)
        seen.update(tuple(x[i : i + w]) for i in range(len(x) - w + 1))
    out = collections.Counter()
    for d, t, *_ in rows:
        x = cases.words(t)
        gone = {j for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for j in range(i, i + w)}
        out[d, len(x), len(gone), cases.sha(" ".join(v for j, v in enumerate(x) if j not in gone))] += 1
    return out


@pytest.mark.parametrize("w", [35, 14])
def test_substrings(docs, w):
    assert cases.bag(substrings.digests(docs, w)) == plain_substrings(cases.rows(), w)


def test_substrings_by_chance(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 90))), None, None, None) for i in range(60)]
    assert cases.bag(substrings.digests(spark.createDataFrame(rows, cases.SCHEMA), 15)) == plain_substrings(rows, 15)
    assert substrings.digests(cases.empty(spark)).count() == 0


def plain_join(rows):
    sets = []
    for d, t, *_ in rows:
        w = cases.words(cases.low(t))
        k = min(5, len(w))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 4 * len(a & b) >= 3 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), float("inf")), -1 if d is None else d)
    return collections.Counter((d, len(s), (None if low[find(i)] < 0 else low[find(i)]) if s else d) for i, (d, s) in enumerate(sets))


def test_ngram_join(docs, spark):
    assert cases.bag(ngram_join.digests(docs)) == plain_join(cases.rows())
    assert ngram_join.digests(cases.empty(spark)).count() == 0


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 4)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"x{r.randrange(9)}"
        rows.append((200 - i, " ".join(w[: r.randint(30, 60)]), None, None, None))
    assert cases.bag(ngram_join.digests(spark.createDataFrame(rows, cases.SCHEMA))) == plain_join(rows)


def test_deduplicated(spark, docs):
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in ngram_join.grouped(docs).where("n_shingles > 0").collect()}
    assert {r[0] for r in kept.collect() if cases.words(r[1])} >= groups - {None}


def test_deduplicated_keeps_one_row_of_each_component(spark):
    r = random.Random(11)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(None, a), (None, b), (None, c + " tail"), (4, c), (7, d), (7, e), *[(9, f)] * 40, *[(None, g)] * 40, (8, ""), (8, ""), (None, None)]
    got = ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert cases.bag(got) == collections.Counter([(None, a), (None, b), (None, c + " tail"), (7, d), (7, e), (9, f), (None, g), (8, ""), (8, ""), (None, None)])


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(90), r.randrange(90)) for _ in range(70)] + [(i, i + 1) for i in range(100, 160)]
    label = {}
    for a, b in pairs:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {x.node: x.label for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in label.items() if k in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_hits(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cases.low(t))
    owners = collections.defaultdict(set)
    for name, t in items:
        w = split(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            owners[tuple(w[i : i + k])].add("null" if name is None else str(name))
    out = collections.Counter()
    for d, t, *_ in rows:
        w, hit, names = split(t), set(), set()
        for k in {len(p) for p in owners}:
            for i in range(len(w) - k + 1):
                if (p := tuple(w[i : i + k])) in owners:
                    hit.update(range(i, i + k))
                    names |= owners[p]
        out[d, len(w), len(hit), len(names), cases.sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_decontamination(docs, bench, spark):
    got = cases.bag(decontaminate.digests(docs, bench))
    assert got == plain_hits(cases.rows(), [tuple(r) for r in bench.collect()])
    assert decontaminate.kept(docs, bench).count() == sum(n for r, n in got.items() if not r[-1])
    assert all(r[2] == 0 for r in cases.bag(decontaminate.digests(docs, bench.limit(0))))
    assert decontaminate.digests(cases.empty(spark), bench).count() == 0
