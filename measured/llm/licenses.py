"""License notices, found by wording and confirmed by conditional compression.

Blocks are the paragraphs of a text that hold a word of such notices, so a notice
may go on from line to line and begin before that word. In a block, a stretch that holds enough of a template's words, in any order, is aligned with it
word by word; one whose wording differs little, and not in a licence's name or
version, is compressed alone and with the
template as a raw zstandard dictionary, and is a find if that saves anything. Of
finds that overlap the one with most of its words stays, and all others.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, pick

# Wording of notices, by name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "All-rights-reserved": ["All rights reserved."],
}

# Words that name a licence. They, and words with a digit, must be
# those of the notice, no more and no fewer.
NAMES = frozenset("affero agpl apache artistic attribution attribution-noncommercial attribution-noderivatives attribution-sharealike boost bsd by-nc by-nc-nd by-nc-sa by-nd by-sa cc eclipse epl gnu gpl isc lesser lgpl mit mozilla mpl noncommercial noderivatives sharealike".split())


def naming(words) -> bool:
    """Whether one of some words names a licence or its version."""
    return any(w in NAMES or any(c.isdigit() for c in w) for w in words)


CANDIDATE = re.compile(r"licen[sc]|rights\W+reserved|permission|copyright|redistribut|public\W+domain|creative\W+commons|free\W+software", re.I)
PARAGRAPHS = re.compile(r"\n[^\S\n]*\n")
WORDS = re.compile(r"\w+(?:[.-]\w+)*")
#: Least share of a template's words that a find has.
LEAST_EQUAL = 0.85


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


class Template:
    """A notice's words, how often it has each, how many of them a find needs,
    and a compressor that knows it."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.count = Counter(self.words)
        self.need = math.ceil(LEAST_EQUAL * len(self.words))
        #: Words of a stretch: those of the notice, and half as many that differ, 2 at least.
        self.most = len(self.words) + max(2, len(self.words) // 2)
        raw = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False)

    def starts(self, own: list[str]):
        """Places of ``own`` from which ``most`` words hold ``need`` of the
        notice's, each counted as often as the notice has it."""
        at = [i for i, w in enumerate(own) if w in self.count]
        have, n, end = Counter(), 0, 0
        for i in at:
            while end < len(at) and at[end] < i + self.most:
                w = own[at[end]]
                have[w] += 1
                n += have[w] <= self.count[w]
                end += 1
            if n >= self.need:
                yield i
            n -= have[own[i]] <= self.count[own[i]]
            have[own[i]] -= 1


@lru_cache(maxsize=1)
def templates() -> list[Template]:
    return [Template(name, t) for name, texts in TEMPLATES.items() for t in texts]


@lru_cache(maxsize=50_000)
def aligned(number: int, own: tuple[str, ...]) -> tuple | None:
    """First and last place of the notice's words in ``own``, rank, size saved,
    number of differences and their wording, or None if too much differs or
    the notice doesn't help to compress the stretch."""
    t = templates()[number]
    m = SequenceMatcher(None, t.words, own, autojunk=False)
    same = [x for x in m.get_matching_blocks() if x.size]
    equal = sum(x.size for x in same)
    if equal < t.need:
        return None
    a, b = same[0].b, same[-1].b + same[-1].size
    #: Words before and after the notice are no difference.
    ops = [o for o in m.get_opcodes() if o[0] != "equal" and not (o[0] == "insert" and o[1] in (0, len(t.words)))]
    for _, i, j, k, l in ops:
        k, l = (max(k, l - j) if i == 0 else k), (min(l, k + j - i) if j == len(t.words) else l)
        if naming(t.words[i:j]) or naming(own[k:l]):
            return None
    raw = " ".join(own[a:b]).encode()
    alone = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw))
    saved = alone - len(t.compressor.compress(raw))
    if saved <= 0:
        return None
    text = "; ".join(f"{' '.join(t.words[i:j])}>{' '.join(own[k:l])}" for _, i, j, k, l in ops)
    return a, b, (2 * equal - len(t.words) - (b - a - equal), saved / len(" ".join(t.words))), saved / alone, len(ops), text


def notices(block: str) -> list[tuple[str, str, float, int, int, int]]:
    """name, words that differ, size saved, number of differences, start and
    end of all notices in a block that do not overlap, by place."""
    spans = [m.span() for m in WORDS.finditer(block)]
    own = [block[a:b].lower() for a, b in spans]
    known = Counter(own)
    got = []
    for number, t in enumerate(templates()):
        if sum(min(n, known[w]) for w, n in t.count.items()) < t.need:
            continue
        for i in t.starts(own):
            for size in (len(t.words), t.most):
                if x := aligned(number, tuple(own[i : i + size])):
                    got.append((x[2], -number, -i, i + x[0], i + x[1], x))
    starts, ends, out = [], [], []
    for _, number, _, a, b, x in sorted(got, reverse=True):
        k = bisect_right(ends, a)
        if k == len(starts) or b <= starts[k]:
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((templates()[-number].name, x[5], x[3], x[4], spans[a][0], spans[b - 1][1]))
    return sorted(out, key=lambda x: x[4])


def scanned(block: str) -> tuple[str, str, float, int] | None:
    """name, words that differ, size saved and number of differences of the
    first notice in a block, or None."""
    return next((x[:4] for x in notices(block)), None)


def blocks(text: str):
    """Start, end and text of candidate blocks: a paragraph, which ends at an
    empty line, with a candidate word."""
    if not CANDIDATE.search(text):
        return
    at = 0
    for end, after in [*(m.span() for m in PARAGRAPHS.finditer(text)), (len(text), None)]:
        if CANDIDATE.search(text, at, end):
            yield at, end, text[at:end]
        at = after


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and finds (array of name, start, end, saved, differences, wording)
    of each row of ``docs``, one for each notice, by place: from its first word
    to its last.

    Null and empty texts have none. Rows are scanned by themselves, so null or
    repeated ids and repeated rows do no harm; other columns aren't read; an
    empty table gives an empty table.
    """
    find = pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("differences", pa.int64()), ("wording", pa.string())])
    arrow = pa.schema([("doc_id", pa.int64()), ("finds", pa.list_(find))])

    def rows(b):
        out = []
        for x in b.column(1).to_pylist():
            got = [(a, *s) for a, _, t in blocks(x or "") for s in notices(t)]
            out.append([{"name": n, "start": a + i, "end": a + j, "saved": c, "differences": d, "wording": w} for a, n, w, c, d, i, j in got])
        return b.column(0), out

    return per_row(pick(docs, ("doc_id", "bigint"), ("text", "string")), "doc_id bigint, finds array<struct<name:string,start:bigint,end:bigint,saved:double,differences:bigint,wording:string>>", rows, arrow)


def digests(docs: DataFrame) -> DataFrame:
    """scan() with n_notices and the names found, sorted, each once."""
    names = F.array_sort(F.array_distinct(F.transform("finds", lambda x: x["name"])))
    return scan(docs).select("doc_id", F.size("finds").cast("bigint").alias("n_notices"), F.array_join(names, ",").alias("licenses"), F.array_join(F.transform("finds", lambda x: F.concat_ws(":", x["name"], x["start"], x["end"], x["differences"])), ",").alias("finds"))
