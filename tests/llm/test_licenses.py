import re
import time

import pyarrow as pa
import pytest

from lodestone.llm import licenses as L
from lodestone.session import table


@pytest.mark.parametrize(
    ("expression", "rpn", "ok"),
    [
        ("MIT", ["MIT"], True),
        ("GPL-3.0-only", ["GPL-3.0-only"], False),
        ("MIT OR GPL-2.0", ["MIT", "GPL-2.0", "or"], True),
        ("MIT AND GPL-2.0", ["MIT", "GPL-2.0", "and"], False),
        ("MIT OR Apache-2.0 AND GPL-2.0", ["MIT", "Apache-2.0", "GPL-2.0", "and", "or"], True),
        ("(MIT OR Apache-2.0) AND GPL-2.0", ["MIT", "Apache-2.0", "or", "GPL-2.0", "and"], False),
        ("Apache-2.0 WITH LLVM-exception", ["Apache-2.0", "LLVM-exception", "with"], True),
        ("mit or gpl-2.0+", ["mit", "gpl-2.0+", "or"], True),
        ("((MIT))", ["MIT"], True),
    ],
)
def test_expressions(expression, rpn, ok):
    assert L.parse(expression) == rpn
    assert L.evaluate(rpn) is ok


@pytest.mark.parametrize("bad", ["", "()", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT Apache-2.0", "MIT AND OR BSD", "a$b", "MIT (BSD)", "(MIT OR GPL-2.0) WITH Foo", "MIT WITH (Foo)", "MIT WITH"])
def test_invalid_expressions(bad):
    assert L.parse(bad) is None


def brute(text):
    """The findings by regular expressions over the whole text."""
    out = set()
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", low.replace(",", ""))
    longest = "|".join(re.escape(p) + r"(?![a-z0-9\x80-\U0010ffff])" for p in sorted(L.NOTICES, key=len, reverse=True))
    version = r"(?P<v>(?: as published by the free software foundation)?[;:]? ?(?:either )?(?:version |ver\.? ?|v\.? ?)?(?P<n>[0-9]{1,2}(?:\.[0-9]{1,2})?)(?![0-9a-z]))?"
    for m in re.finditer(rf"(?<![a-z0-9\x80-\U0010ffff])(?=(?P<p>{longest}){version})", flat):
        name, versioned = L.NOTICES[m["p"]]
        if versioned and m["v"]:
            name += "-" + m["n"] + ("" if "." in m["n"] else ".0")
        out.add((name, (name,), name in L.PERMISSIVE))
    for m in re.finditer(r"(?i)(?<![A-Za-z0-9\x80-\U0010ffff])spdx-license-identifier:((?:(?!(?<![A-Za-z0-9\x80-\U0010ffff])spdx-license-identifier:)[^\n\r])*)", text or ""):
        e = re.split(r"\*/|-->|#\}", m[1])[0].strip()
        rpn = L.parse(e)
        out.add((e, tuple(sorted(set(L.names(rpn)))), L.evaluate(rpn)) if rpn else (e, ("INVALID",), False))
    return sorted(out)


TEXTS = [
    "/* SPDX-License-Identifier: MIT OR GPL-2.0 */\ncode", "spdx-license-identifier: (Apache-2.0 WITH LLVM-exception)\r\nx", "SPDX-License-Identifier:", "# SPDX-License-Identifier: MIT BSD",
    "Released under the\n MIT   License. All rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy", "unreleased under the mit licenses", "Licensed under the Apache License, Version 2.0", "nothing", "", None,
    "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT", "é all rights reserved", "SPDX-License-Identifier: GPL-2.0-only AND (MIT OR BSD-3-Clause) -->",
]


@pytest.mark.parametrize(
    ("text", "names", "verdict"),
    [
        ("Licensed under the BSDX licence", [], "none"),
        ("This program is free software: you can redistribute it under the terms of the GNU General Public License as published by\n the Free Software Foundation; either version 2 of the License", ["GPL-2.0"], "restricted"),
        ("Creative Commons Attribution 4.0 International", ["CC-BY-4.0"], "permissive"),
        ("a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 licence", ["CC-BY-NC-SA-3.0"], "restricted"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\")", ["Apache-2.0"], "permissive"),
        ("Apache License\n Version 2.0, January 2004", ["Apache-2.0"], "permissive"),
        ("licensed under the GPL v3", ["GPL-3.0"], "restricted"),
        ("the GNU General Public License in general", ["GPL"], "restricted"),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], "restricted"),
        ("Mozilla Public License, v. 2.0.", ["MPL-2.0"], "restricted"),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0) WITH Foo", ["INVALID"], "restricted"),
        ("allowing all rights reserved", ["PROPRIETARY"], "restricted"),
        ("all rights reservedly", [], "none"),
    ],
)
def test_notices(spark, text, names, verdict):
    found = L.findings(pa.array([text]), L._automaton())[0]
    assert [x for _, ls, _ in found for x in ls] == names
    assert ("none" if not found else "permissive" if all(ok for _, _, ok in found) else "restricted") == verdict
    assert found == brute(text)


def test_many_tags_take_time_in_proportion():
    col = pa.array(["SPDX-License-Identifier: MIT\n" * 180_000, "SPDX-License-Identifier: MIT OR GPL-2.0 " * 130_000])  # 5 MB each, many lines and one
    began = time.time()
    got = L.findings(col, L._automaton())
    assert time.time() - began < 40
    assert [f[0][0] for f in got] == ["MIT", "MIT OR GPL-2.0"]


def test_scan_equals_regular_expressions():
    got = L.findings(pa.array(TEXTS), L._automaton())
    for t, g in zip(TEXTS, got):
        assert g == brute(t), t


def test_documents_equal_regular_expressions(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.scan(docs).collect():
        f = brute(texts[r.doc_id])
        assert r.expressions == [e for e, _, _ in f]
        assert r.licenses == sorted({x for _, ls, _ in f for x in ls})
        assert r.verdict == ("none" if not f else "permissive" if all(ok for _, _, ok in f) else "restricted")


def test_edges(edge_docs, no_docs):
    got = L.scan(edge_docs)
    assert got.count() == edge_docs.count() and set(got.columns) == set(edge_docs.columns) - {"text"} | {"licenses", "expressions", "verdict"}
    assert {r.verdict for r in got.collect()} == {"none"}
    assert L.scan(no_docs).count() == 0
