"""Exact SentencePiece (merge type) encoding by backtracking, and decoding.

An encoding by merges is the one sequence of tokens in which every adjacent
pair is compatible, that is, encoding the joined text of the pair gives the
pair back. The search takes the longest match of an Aho-Corasick automaton at
each place, steps back to the next shorter token where a pair does not fit,
and marks places from which no encoding was found in a bit field, so each is
tried once.
"""

from __future__ import annotations

import hashlib
import heapq

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import per_row, pick

SPACE = "▁"


def merge(text: str, score: dict[str, float]) -> list[str]:
    """Encoding by merging: of all adjacent parts whose union is a piece, the
    best-scored and then leftmost is joined, until none is left."""
    parts: list[str | None] = list(text)
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(-score[j], i, 2) for i in range(n - 1) if (j := text[i : i + 2]) in score]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        a = parts[i]
        if a is None or (k := right[i]) >= n or len(a) + len(parts[k]) != size:
            continue
        parts[i], parts[k] = (a := a + parts[k]), None
        right[i] = right[k]
        if right[k] < n:
            left[right[k]] = i
            if (j := a + parts[right[k]]) in score:
                heapq.heappush(heap, (-score[j], i, len(j)))
        if left[i] >= 0 and (j := parts[left[i]] + a) in score:
            heapq.heappush(heap, (-score[j], left[i], len(j)))
    return [p for p in parts if p is not None]


class Pieces:
    """Encoder and decoder for one model file.

    ``most`` bounds the encodings that are kept of parts met before.
    """

    def __init__(self, model: str, most: int = 200_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        self.names = [sp.id_to_piece(i) for i in ids]
        self.bytes_of = {i: int(self.names[i][3:5], 16) for i in ids if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        self.silent = {i for i in ids if sp.is_control(i)}
        self.unknown, self.end, self.begin = sp.unk_id(), sp.eos_id(), sp.bos_id()
        plain = [i for i in ids if i not in self.bytes_of and i not in self.silent and i != self.unknown and not sp.is_unused(i)]
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.id_of = {self.names[i]: i for i in plain}
        #: Only a piece that its own text encodes to can occur in an encoding.
        self.reached = {p for p in self.score if len(p) == 1 or merge(p, self.score) == [p]}
        self.trie = ahocorasick.Automaton()
        for p in self.reached:
            self.trie.add_word(p, len(p))
        self.trie.make_automaton()
        #: Neighbours inside some piece; a merge never joins any others.
        self.inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        #: No piece goes on with a space after anything but spaces.
        self.words = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.fits: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.most = most

    def compatible(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = a[-1] + b[0] not in self.inner or merge(a + b, self.score) == [a, b]
            if len(self.fits) < self.most:
                self.fits[a, b] = known
        return known

    def parse(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        n = len(text)
        if text in self.reached:
            return [text]
        longest = [0] * n
        for end, size in self.trie.iter(text):
            start = end + 1 - size
            if size > longest[start]:
                longest[start] = size
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        reached, fits = self.reached, self.fits
        at, size, before = 0, longest[0], ""
        while at < n:
            while size:
                piece, to = text[at : at + size], at + size
                if piece in reached and not failed[to >> 3] >> (to & 7) & 1:
                    if not before or fits.get((before, piece)) or self.compatible(before, piece):
                        break
                size -= 1
            if size:
                out.append(piece)
                at, before = to, piece
                size = longest[at] if at < n else 0
            else:
                if not out:
                    raise ValueError("no encoding")
                failed[at >> 3] |= 1 << (at & 7)
                size = len(out.pop())
                before = out[-1] if out else ""
                at -= size
                size -= 1
        return out

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a part between two safe cuts."""
        known = self.kept.get(text)
        if known is not None:
            return known
        out: list[int] = []
        start, inner = 0, self.inner
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inner]
        for i in [*cuts, len(text)]:
            run = text[start:i]
            if run in self.reached:
                out.append(self.id_of[run])
            elif len(run) == 1:
                out += [self.byte_id[b] for b in run.encode()] if self.byte_id else [self.unknown]
            else:
                out += [self.id_of[p] for p in self.parse(run)]
            start = i
        got = tuple(out)
        if len(self.kept) < self.most and len(text) < 64:
            self.kept[text] = got
        return got

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of a whole text, as the library gives them."""
        out: list[int] = []
        if text:
            known, part = self.kept.get, self.part
            shown = SPACE + text.replace(" ", SPACE)
            for x in self.cut(shown):
                out += known(x) or part(x)
        return [*out, self.end] if end else out

    def cut(self, text: str) -> list[str]:
        """Parts that no piece reaches across: a run of spaces and what
        follows it up to the next space."""
        if not self.words:
            return [text]
        parts = text.split(SPACE)
        if "" not in parts[1:]:
            return [SPACE + p for p in parts[1:]]
        out, spaces = [], 0
        for p in parts[1:]:
            spaces += 1
            if p:
                out.append(SPACE * spaces + p)
                spaces = 0
        if spaces:
            out.append(SPACE * spaces)
        return out

    def decode(self, ids) -> str:
        """Text of ids: control ids are silent, the first space is dropped,
        bytes are joined and shown as U+FFFD where they are no UTF-8."""
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(unfold(bytes(raw)))
                raw.clear()
                first = False
            if i in self.silent:
                continue
            p = self.names[i] if i != self.unknown else " ⁇ "
            if first and p[0] == SPACE:
                p = p[1:]
            first = False
            out.append(p)
        if raw:
            out.append(unfold(bytes(raw)))
        return "".join(out).replace(SPACE, " ")


def unfold(raw: bytes) -> str:
    """UTF-8 bytes as text, each byte that is no part of a character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + unfold(raw[e.start + 1 :])


_made: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One encoder per worker and model file."""
    if model not in _made:
        _made[model] = Pieces(model)
    return _made[model]


def encoded(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) of each row of ``docs``.

    Null texts count as empty: ids hold the end id alone, decoded is empty.
    Each row is encoded by itself, so repeated ids, ties, null ids and extra
    columns are of no matter; an empty table gives an empty table. Work is
    linear in the text but for places where the search steps back, and there
    each place fails once at most.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def rows(b):
        p = pieces(model)
        ids = [p.encode(x or "", end) for x in b.column(1).to_pylist()]
        return b.column(0), ids, [p.decode(x) for x in ids]

    return per_row(pick(docs, ("doc_id", "bigint"), ("text", "string")), "doc_id bigint, ids array<int>, decoded string", rows, arrow)


def digests(docs: DataFrame, model: str, end: bool = True, ids: bool = False) -> DataFrame:
    """encoded() with its lists as digests: n_tokens (all ids), ids_sha256 of
    the decimal ids joined by a space, decoded_sha256 of the decoded text; with
    ``ids`` the list of ids stays too.

    Digests are taken where the ids are; without ``ids`` no list leaves the
    Python worker.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *[("ids", pa.list_(pa.int32()))] * ids])

    def rows(b):
        p = pieces(model)
        sha = hashlib.sha256
        names = [str(i) for i in range(len(p.names))]
        n, a, d, all_ = [], [], [], []
        for x in b.column(1).to_pylist():
            got = p.encode(x or "", end)
            n.append(len(got))
            a.append(sha(" ".join([names[i] for i in got]).encode()).hexdigest())
            d.append(sha(p.decode(got).encode()).hexdigest())
            if ids:
                all_.append(pa.array(got, pa.int32()))
        return b.column(0), n, a, d, *[[x.to_numpy() for x in all_]] * ids

    return per_row(pick(docs, ("doc_id", "bigint"), ("text", "string")), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, rows, arrow)
