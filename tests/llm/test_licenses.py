"""Names and versions that are near a notice's but not its own; long texts."""

import time

from measured.llm import licenses

from . import cases

GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def names(text):
    return [x[0] for _, _, b in licenses.blocks(text) for x in licenses.notices(b)]


def test_neighbours_are_told_apart():
    of = {("General Public License", "3"): "GPL-3.0", ("General Public License", "2"): "GPL-2.0", ("Lesser General Public License", "3"): "LGPL-3.0", ("Lesser General Public License", "2.1"): "LGPL-2.1", ("Affero General Public License", "3"): "AGPL-3.0"}
    for (words, version), name in of.items():
        assert names(GNU.format(words, version)) == [name]
        assert names(f"This work is licensed under the GNU {words}, version {version}.") == [name]
    for one, name in {"MIT": "MIT", "BSD 2-Clause": "BSD-2-Clause", "BSD 3-Clause": "BSD-3-Clause"}.items():
        assert names(f"Released under the {one} License.") == [name]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and names("Licensed under CC BY-SA 4.0.") == ["CC-BY-SA-4.0"]


def test_other_names_and_versions_are_no_find():
    for x in (
        "Licensed under the Apache License, Version 1.1.",
        "Released under the Boost License.",
        "Released under the BSD 4-Clause License.",
        "Licensed under CC BY 3.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This work is licensed under the GNU General Public License, version 1.",
        GNU.format("General Public License", "4"),
        "Dedicated to the public domain under CC0 2.0.",
    ):
        assert names(x) == [], x


def plain_names(text):
    """Templates whose words stand in a text one after another."""
    own = [w.lower() for w in licenses.WORDS.findall(text)]
    out = []
    for name, notices in licenses.TEMPLATES.items():
        for t in notices:
            w = licenses.words_of(t)
            out += [(i, -len(w), name) for i in range(len(own)) if own[i : i + len(w)] == w]
    taken, got = set(), []
    for i, n, name in sorted(out, key=lambda x: (x[1], x[0])):
        if taken.isdisjoint(range(i, i - n)):
            taken |= set(range(i, i - n))
            got.append((i, name))
    return [n for _, n in sorted(got)]


def test_exact_notices_against_a_plain_search(spark, small):
    plain = spark.read.parquet(f"{small}/documents.parquet")
    docs = plain.selectExpr("*", "1 as finds", "'x' as TEXT")
    texts = {r[0]: r[1] or "" for r in plain.select("doc_id", "text").collect()}
    got = {r.doc_id: [f.name for f in r.finds] for r in licenses.scan(docs).collect()}
    assert got == {d: plain_names(x) for d, x in texts.items()} and any(got.values())


def test_full_text_and_long_texts(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(licenses.TEMPLATES["MIT"][2:])
    bsd = licenses.TEMPLATES["BSD"][0] + "\n\n3. " + licenses.TEMPLATES["BSD-3-Clause"][1]
    assert names(mit) == ["MIT", "MIT"] and names(bsd) == ["BSD", "BSD-3-Clause"]
    began = time.process_time()
    assert names("license " * 100_000) == [] and names(("word " * 50 + "license\n") * 5_000) == []
    assert names("word " * 200_000 + "Released under the MIT License.") == ["MIT"]
    assert time.process_time() - began < 30
    df = spark.createDataFrame([(1, None), (None, ""), (1, None)], "doc_id bigint, text string")
    assert [r.n_notices for r in licenses.digests(df).collect()] == [0, 0, 0] and licenses.digests(cases.empty(spark)).count() == 0
