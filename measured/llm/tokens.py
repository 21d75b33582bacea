"""Exact token counts of a byte-pair vocabulary with word ends, at every prefix.

For a word, a table over its prefixes holds the last token of each prefix's
encoding and the number of its tokens: the encoding of a prefix without its
last token is the encoding of the shorter prefix, so one compatible token per
place is all that is looked for (the candidates are an Aho-Corasick
automaton's matches that end there). Sums over words give the count at every
prefix of a text, so truncation and budget questions need no second encoding.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, pick, texts

#: Characters of Unicode that count as white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves,
    the others for 256 and up, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Counter:
    """Counts for one tokenizers file of BPE with an end-of-word suffix.

    A text's normal form is the library's own. Words are cut by a pattern, and by
    the library itself where a text has a character that the pattern's classes,
    those of another release of Unicode, take for something else: each character
    is held against the library when it is first met. ``most`` bounds the words
    whose counts are kept, and the pairs of tokens.
    """

    def __init__(self, path: str, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = tokenizers.Tokenizer.from_file(path)
        self.shape, self.cutter = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.known, self.odd = set(map(chr, range(128))), set()
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        assert spec["normalizer"]["normalizers"][0]["type"] == "NFC" and model["type"] == "BPE" and self.end
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"[^\s", f"[^{WHITE}"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        vocab = model["vocab"]
        #: Tokens their own text encodes to: inside a word, and at its end.
        self.inside, self.final = ahocorasick.Automaton(), set()
        for t in vocab:
            text, last = (t[: -len(self.end)], True) if t.endswith(self.end) else (t, False)
            if text and (len(text) == 1 or self.merge(text, last) == [t]):
                if last:
                    self.final.add(text)
                else:
                    self.inside.add_word(text, len(text))
        self.inside.make_automaton()
        self.longest = max(map(len, self.final))
        self.fits: dict[tuple[str, str, bool], bool] = {}
        self.kept: dict[str, int] = {}
        self.most = most

    def merge(self, word: str, last: bool = True) -> list[str]:
        """Tokens of a word of byte letters, by merging in order of rank."""
        parts: list[str | None] = list(word)
        if last:
            parts[-1] += self.end
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            k = right[i]
            if parts[i] != a or k >= n or parts[k] != b:
                continue
            parts[i], parts[k] = a + b, None
            right[i] = right[k]
            if right[k] < n:
                left[right[k]] = i
            for x in (left[i], i):
                if 0 <= x and right[x] < n and (r := self.rank.get((parts[x], parts[right[x]]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[right[x]]))
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str, last: bool) -> bool:
        known = self.fits.get((a, b, last))
        if known is None:
            known = self.merge(a + b, last) == [a, b + self.end if last else b]
            if len(self.fits) < self.most:
                self.fits[a, b, last] = known
        return known

    def table(self, letters: str) -> tuple[list[str], list[int]]:
        """For each prefix of a word, not ending there: last token, count."""
        n = len(letters)
        last, count = [""] * (n + 1), [0] * (n + 1)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for end, size in self.inside.iter(letters):
            ends[end + 1].append(size)
        for i in range(1, n + 1):
            for size in ends[i]:
                token = letters[i - size : i]
                if size == i or self.compatible(last[i - size], token, False):
                    last[i], count[i] = token, count[i - size] + 1
                    break
        return last, count

    def closed(self, letters: str, table: tuple[list[str], list[int]], to: int) -> int:
        """Tokens of the word letters[:to], ended there."""
        last, count = table
        for size in range(min(to, self.longest), 0, -1):
            token = letters[to - size : to]
            if token in self.final and (size == to or self.compatible(last[to - size], token, True)):
                return count[to - size] + 1
        raise ValueError("no encoding")

    def spell(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode()])

    def word(self, word: str) -> int:
        """Tokens of one word."""
        known = self.kept.get(word)
        if known is None:
            letters = self.spell(word)
            known = 1 if letters in self.final else self.closed(letters, self.table(letters), len(letters))
            if len(self.kept) < self.most and len(word) < 64:
                self.kept[word] = known
        return known

    def prefixes(self, word: str) -> list[int]:
        """Tokens of every prefix of a word, by code points, from none to all."""
        letters = self.spell(word)
        table = self.table(letters)
        ends = accumulate((len(c.encode()) for c in word), initial=0)
        return [self.closed(letters, table, e) if e else 0 for e in ends]

    def cut_at(self, text: str) -> list[tuple[int, int]]:
        """Starts and ends of the words of a normal form, by the library."""
        return [span for _, span in self.cutter(text)]

    def plain_cut(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.split.finditer(text)]

    def strange(self, text: str) -> bool:
        """Whether the pattern takes a character of a text for something else
        than the library does."""
        for c in set(text) - self.known:
            probe = [f"{x}{c}{x}" for x in "a1!"]
            self.known.add(c)
            if any(self.cut_at(x) != self.plain_cut(x) for x in probe):
                self.odd.add(c)
        return bool(self.odd) and not self.odd.isdisjoint(text)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Starts and ends of the words of a normal form."""
        return self.cut_at(text) if not text.isascii() and self.strange(text) else self.plain_cut(text)

    def words(self, text: str) -> list[str]:
        """The words of a normal form."""
        return [text[a:b] for a, b in self.cut_at(text)] if not text.isascii() and self.strange(text) else self.split.findall(text)

    def named_sections(self, text: str):
        """A text's parts in order: each, and whether it is a special string."""
        at = 0
        for m in self.special.finditer(text) if "<|" in text else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if "<|" in text:
            return sum(1 if special else self.plain(s) for s, special in self.named_sections(text))
        return self.plain(text)

    def plain(self, text: str) -> int:
        known, word = self.kept.get, self.word
        return sum([known(w) or word(w) for w in self.words(self.shape(text))])

    def counts(self, text: str) -> tuple[str, list[int]]:
        """A text's normal form, and the tokens of every prefix of it, by code
        points, from none to all. A special string counts as one token, from
        its first character on, and keeps its spelling."""
        parts, out, done = [], [0], 0
        for s, special in self.named_sections(text):
            if special:
                done += 1
                out += [done] * len(s)
            else:
                s, at = self.shape(s), 0
                for a, b in self.spans(s):
                    out += [done] * (a - at)
                    inside = self.prefixes(s[a:b])
                    out += [done + n for n in inside[1:]]
                    done, at = done + inside[-1], b
                out += [done] * (len(s) - at)
            parts.append(s)
        return "".join(parts), out

    def fit(self, text: str, budget: int) -> tuple[int, int]:
        """Code points of a normal form's longest prefix with at most ``budget``
        tokens, and their number, from sums at the ends of words and, inside
        the word that passes the budget, from the table of its prefixes."""
        done, long = 0, 0
        for s, special in self.named_sections(text):
            if special:
                if done + 1 > budget:
                    return long, done
                done, long = done + 1, long + len(s)
                continue
            s = self.shape(s)
            spans = self.spans(s)
            sums = list(accumulate((self.word(s[a:b]) for a, b in spans), initial=0))
            k = bisect_right(sums, budget - done) - 1
            if k < len(spans):
                a, b = spans[k]
                inside = self.prefixes(s[a:b])
                i = max(i for i, c in enumerate(inside) if c <= budget - done - sums[k])
                return long + a + i, done + sums[k] + inside[i]
            done, long = done + sums[-1], long + len(s)
        return long, done

    def cut(self, text: str, budget: int) -> tuple[str, int]:
        """The prefix that fit() measures, and its tokens."""
        i, n = self.fit(text, budget)
        return "".join(s if special else self.shape(s) for s, special in self.named_sections(text))[:i], n


_made: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker and file."""
    if path not in _made:
        _made[path] = Counter(path)
    return _made[path]


def counted(docs: DataFrame, path: str, limit: int = 2048, fit: bool = False) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of
    each row of ``docs``; with ``fit`` also n_fit, the code points of the normal
    form's longest prefix within the limit.

    Null texts count as empty, with no tokens. Each row is counted by itself,
    so null or repeated ids, repeated rows and extra columns are of no matter;
    an empty table gives an empty table.
    """
    names = [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean"), *[("n_fit", "bigint")] * fit]
    arrow = pa.schema([(n, pa.bool_() if t == "boolean" else pa.int64()) for n, t in names])

    def rows(b):
        c = counter(path)
        all_ = texts(b.column(1))
        n = [c.count(x) for x in all_]
        fits = [[c.fit(x, limit)[0] if k > limit else len(c.shape(x)) for x, k in zip(all_, n, strict=True)]] if fit else []
        return b.column(0), [len(x.encode()) for x in all_], n, [x > limit for x in n], *fits

    return per_row(pick(docs, ("doc_id", "bigint"), ("text", "string")), ", ".join(f"{n} {t}" for n, t in names), rows, arrow)


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, normal (the form in which the vocabulary sees a text) and counts:
    the exact number of tokens of every prefix of it, by code points, from none
    to all. Written once, it answers any budget without an encoding.

    Null texts count as empty; rows are counted by themselves, so repeated rows
    and ids do no harm; an empty table gives an empty table.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("normal", pa.string()), ("counts", pa.list_(pa.int32()))])

    def rows(b):
        got = [counter(path).counts(x) for x in texts(b.column(1))]
        return b.column(0), [x for x, _ in got], [n for _, n in got]

    return per_row(pick(docs, ("doc_id", "bigint"), ("text", "string")), "doc_id bigint, normal string, counts array<int>", rows, arrow)


def truncated(prefixes: DataFrame, *budgets: int) -> DataFrame:
    """doc_id, budget, text (the longest prefix of the normal form within the
    budget) and n_tokens, for each row of prefix_counts() and each budget: looked
    up in the stored counts."""
    within = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.get("counts", i) <= F.col("budget"))
    at = F.array_max(within)
    each = prefixes.withColumn("budget", F.explode(F.array(*[F.lit(int(b)) for b in budgets]))).withColumn("at", at)
    return each.select("doc_id", "budget", F.expr("substring(normal, 1, at)").alias("text"), F.expr("counts[at]").cast("bigint").alias("n_tokens"))
