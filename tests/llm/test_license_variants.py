import random
import time
from collections import Counter

import pytest

from quillgraph.llm import licenses

GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
SHORT = "This work is licensed under the GNU {}, version {}."
CC = "This work is licensed under a Creative Commons Attribution{} {} International License."
CASES = [
    *[(name, form.format(words, v)) for form in (GNU, SHORT) for name, words, v in (
        ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
        ("LGPL-2.0", "Library General Public License", "2"), ("AGPL-3.0", "Affero General Public License", "3"), (None, "General Public License", "9"))],
    *[(f"CC-BY{short}-4.0", CC.format(long, "4.0")) for short, long in (
        ("", ""), ("-NC", "-NonCommercial"), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))],
    *[(f"CC-BY{x}-4.0", f"Licensed under CC BY{x} 4.0.") for x in ("", "-NC", "-SA", "-ND", "-NC-SA", "-NC-ND")],
    (None, CC.format("", "3.0")),
    (None, CC.format("-NonCommercial", "2.5")),
    ("BSD-2-Clause", licenses._BSD),
    ("BSD-3-Clause", licenses._BSD + licenses._ENDORSE),
    ("BSD-3-Clause", licenses._BSD + licenses._ENDORSE.replace("copyright holder", "Example Company")),
    ("BSD-4-Clause", licenses._BSD + licenses._ADVERTISING + licenses._ENDORSE.replace("copyright holder", "University")),
]


@pytest.mark.parametrize("name,text", CASES)
def test_variants_against_their_neighbours(name, text):
    for around in ("{}", "Some words. {} And more of them."):
        assert [m[2] for m in licenses.scanner().scan(around.format(text))] == ([name] if name else [])


PORTS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported"}
KINDS = (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
MORE = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation."),
    (None, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 9 as published by the Free Software Foundation."),
    *[(f"CC-BY{short}-{v}", f"This work is licensed under a Creative Commons Attribution{long} {v} {port} License.") for v, port in PORTS.items() for short, long in KINDS],
    *[(f"CC-BY{short}-{v}", f"Licensed under CC BY{short} {v}.") for v in PORTS for short, _ in KINDS],
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nPreamble\n\nThe GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\nThis version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."
        "\n\n\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
]


@pytest.mark.parametrize("name,text", MORE)
def test_more_variants(name, text):
    for around in ("{}", "Some words. {} And more of them."):
        assert [m[2] for m in licenses.scanner().scan(around.format(text))] == ([name] if name else [])


@pytest.mark.parametrize("name", licenses.SPDX)
def test_identifiers(name):
    want = [name.removesuffix("-only").removesuffix("-or-later")]
    for text in (f"SPDX-License-Identifier: {name}", f"// SPDX-License-Identifier: {name}\nint main;", f"/* SPDX-License-Identifier: {name} */\n#include"):
        assert [m[2] for m in licenses.scanner().scan(text)] == want


def test_other_identifiers():
    for text in ("SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: ISC-Veillard and more", "SPDX-License-Identifier: Foo", "the SPDX-License-Identifier: line"):
        assert licenses.scanner().scan(text) == []
    assert [m[2] for m in licenses.scanner().scan("code; // SPDX-License-Identifier: MIT and a remark")] == ["MIT"]


def test_query_is_the_scanner(spark, odd_docs):
    """One row a row, nulls and repeated rows too; the best match is the highest, then the first."""
    texts = [t for _, t in MORE] + ["Released under the MIT License.\nSPDX-License-Identifier: ISC", "nothing here"]
    docs = odd_docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(100 + n, t, "license") for n, t in enumerate([*texts, texts[0]])], "doc_id long, text string, key string"))
    found = licenses.scan_licenses(docs).collect()
    want = []
    for r in docs.collect():
        m = licenses.scanner().scan(r.text or "")
        best = sorted(m, key=lambda x: (-x[3], x[0]))[:1]
        want.append((str(r.doc_id), len(m), best[0][2] if best else None, [tuple(x) for x in m]))
    assert sorted(((str(r.doc_id), r.n_matches, r.license, [tuple(x) for x in r.matches]) for r in found), key=str) == sorted(want, key=str)


def brute_scan(text, templates, least):
    """The rule of ``scan`` with every stretch counted anew; no distinguishing words or versions."""
    words = licenses._WORD.findall(text.lower())
    pairs = list(zip(words, words[1:]))
    found = []
    for t, (_, wording) in enumerate(templates):
        w = licenses._WORD.findall(wording.lower())
        own = Counter(zip(w, w[1:]))
        for a in range(len(pairs)):
            best = None
            for b in range(a, len(pairs)):
                if pairs[a] in own and pairs[b] in own:
                    dice = 2 * (Counter(pairs[a : b + 1]) & own).total() / (b - a + 1 + own.total())
                    if dice >= least and (best is None or (dice, b - a + 1) > best):
                        best = (dice, b - a + 1)
            if best:
                found.append((-best[0], -best[1], a, t))
    out, taken = [], set()
    for dice, size, a, t in sorted(found):
        spot = range(a, a - size + 1)
        if taken.isdisjoint(spot):
            taken.update(spot)
            out.append((a, 1 - size, templates[t][0], -dice))
    return sorted(out)


def test_scan_is_the_brute_force(monkeypatch):
    rng = random.Random(3)
    templates = [("A", "red green blue red green red blue blue"), ("B", "green blue green red pink grey"), ("C", "pink pink pink red blue grey green pink")]
    for block in (licenses.BLOCK, 3):
        monkeypatch.setattr(licenses, "BLOCK", block)
        for least in (0.6, 0.8):
            scan = licenses.Scanner(templates, least).scan
            for _ in range(150):
                parts = [rng.choice([*(t for _, t in templates), "red", "green", "blue", "pink", "grey", "other words"]) for _ in range(rng.randrange(12))]
                text = " ".join(parts)
                assert scan(text) == brute_scan(text, templates, least), text


def test_short_wordings_stand_alone():
    scan = licenses.scanner().scan
    assert scan("In this story all rights reserved for the king are lost.") == []
    for text in ("All rights reserved.", "All rights reserved", "A line\nAll rights reserved\nand more", "Copyright 2020. All Rights Reserved!"):
        assert [m[2] for m in scan(text)] == ["proprietary"]


def test_repeated_licence_in_a_long_text():
    """Megabytes of one licence take memory and time in proportion."""
    name, text = licenses.TEMPLATES[1]
    began = time.perf_counter()
    assert [m[2] for m in licenses.scanner().scan(f"{text} " * 4000)] == [name] * 4000  # 2 MB
    assert time.perf_counter() - began < 60
