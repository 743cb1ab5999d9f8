"""License scans: stretches of a text against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from fractions import Fraction
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.common import documents

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
_ADVERTISING = " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_ENDORSE = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)

_GNU_ONLY = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} version {} as published by the Free Software Foundation."
_GNU_OF = "This {} is free software; you can redistribute it and/or modify it under the terms of version {} of the GNU {} as published by the Free Software Foundation."
_GNU_BODY = (
    "GNU {} Version {} Copyright (C) {} Free Software Foundation, Inc. "
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "
)
_FREE = "Preamble The GNU {} is a free, copyleft license for software and other kinds of works"
_TAKE_AWAY = "Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public {} intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."
_CC_KINDS = {"BY": "", "BY-SA": "-ShareAlike", "BY-NC": "-NonCommercial", "BY-ND": "-NoDerivatives", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}
_CC_PORTS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported"}

#: Names by which texts give their licence after SPDX-License-Identifier.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", *(f"CC-{kind}-{v}" for kind in _CC_KINDS for v in (*_CC_PORTS, "4.0")),
)

#: How licences' own texts begin.
BODIES = (
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "
        "Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ),
    ("GPL-3.0", _GNU_BODY.format("GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007") + _FREE.format("General Public License") + "."),
    ("GPL-2.0", _GNU_BODY.format("GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991") + _TAKE_AWAY.format("License is")),
    ("AGPL-3.0", _GNU_BODY.format("AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007") + _FREE.format("Affero General Public License") + ", specifically designed to ensure cooperation with the community in the case of network server software."),
    ("LGPL-2.1", _GNU_BODY.format("LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", "1991, 1999") + _TAKE_AWAY.format("Licenses are")),
    ("LGPL-2.0", _GNU_BODY.format("LIBRARY GENERAL PUBLIC LICENSE", "2, June 1991", "1991") + _TAKE_AWAY.format("Licenses are")),
    (
        "LGPL-3.0",
        _GNU_BODY.format("LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007")
        + "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    (
        "MPL-2.0",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. "
        "1.2. Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.",
    ),
    *(
        (
            f"CC-{kind}-4.0",
            f"Creative Commons Attribution{words} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
            f"Creative Commons Attribution{words} 4.0 International Public License (Public License).",
        )
        for kind, words in _CC_KINDS.items()
    ),
)

#: Wordings by which texts state their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _ENDORSE),
    ("BSD-4-Clause", _BSD + _ADVERTISING + _ENDORSE),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
        "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("program", "General Public License", "2")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("library", "Lesser General Public License", "3")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.0", _GNU.format("library", "Library General Public License", "2")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("proprietary", "All rights reserved."),
    *((f"{x}GPL-{v}", form.format(what, *((v.removesuffix(".0"), f"{y}General Public License") if form is _GNU_OF else (f"{y}General Public License", v.removesuffix(".0")))))
      for form in (_GNU_ONLY, _GNU_OF) for x, y, what, v in (("", "", "program", "2.0"), ("", "", "program", "3.0"), ("L", "Lesser ", "library", "2.1"), ("L", "Lesser ", "library", "3.0"), ("A", "Affero ", "program", "3.0"))),
    *((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.") for v in _CC_PORTS for kind in _CC_KINDS),
    *((f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons Attribution{words} {v} {port} License.") for v, port in _CC_PORTS.items() for kind, words in _CC_KINDS.items()),
    *((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in SPDX),
    *BODIES,
)
#: The least Dice coefficient that counts as a match.
LEAST = 0.8
#: Wordings of fewer bigrams count only where they are a whole sentence or line.
ALONE = 4
#: Starts of stretches that are looked at together.
BLOCK = 1 << 16

#: Words, or two in a row, that tell licences of like wording apart: a stretch must have the same ones as the template.
MARKS = {
    ("lesser",): "lesser", ("library", "general"): "library", ("affero",): "affero",
    ("noncommercial",): "nc", ("nc",): "nc", ("non", "commercial"): "nc", ("sharealike",): "sa", ("sa",): "sa", ("share", "alike"): "sa",
    ("noderivatives",): "nd", ("noderivs",): "nd", ("nd",): "nd", ("no", "derivatives"): "nd", ("no", "derivs"): "nd", ("endorse",): "endorse", ("advertising",): "advertising",
    ("unported",): "unported", ("generic",): "generic",
}
#: Words that a version follows.
VERSIONED = {"version", "v", "license", "by", "cc0", "attribution", "nc", "sa", "nd", "noncommercial", "commercial", "sharealike", "alike", "noderivatives", "noderivs", "derivatives", "derivs"}
#: Licences whose wording starts longer ones, which win where both match.
LONGER = {"0BSD": {"ISC"}, "BSD-2-Clause": {"BSD-3-Clause", "BSD-4-Clause"}, "BSD-3-Clause": {"BSD-4-Clause"}}

_WORD = re.compile("[a-z0-9]+")
_NUMBER = re.compile("v?([0-9]+)")
_STOP = re.compile("[.!?\\n]")


def marks_of(words: list[str]) -> set[str]:
    return {m for k in (1, 2) for x in zip(*(words[n:] for n in range(k))) if (m := MARKS.get(x))}


def version_of(words: list[str]) -> tuple[str, ...]:
    """The first version, without zeros at its end; empty without one."""
    for at, word in enumerate(words):
        number = _NUMBER.fullmatch(word)
        if number and (word[0] == "v" or at and words[at - 1] in VERSIONED):
            out = [number[1]]
            while at + len(out) < len(words) and words[at + len(out)].isdigit():
                out.append(words[at + len(out)])
            while out and out[-1] == "0":
                out.pop()
            return tuple(out)
    return ()


class Template:
    """A wording of a licence: its bigrams, the sizes of stretches that can match it, its distinguishing words and version."""

    def __init__(self, name: str, text: str, least: float):
        self.name = name
        words = _WORD.findall(text.lower())
        self.grams = Counter(zip(words, words[1:]))
        self.size = self.grams.total()
        # Dice is at most 2 * min / (a + b), so only stretches of these sizes can reach ``least``
        least = Fraction(least).limit_denominator(1000)
        self.low, self.high = ceil(self.size * least / (2 - least)), int(self.size * (2 - least) / least)
        # and a stretch that does shares this many bigrams
        self.need = max(1, ceil(least * (self.low + self.size) / 2))
        # an identifier is held whole, and one that goes on behind a hyphen is another one
        # so short a wording also occurs within sentences that state no licence: it must be one by itself
        self.words, self.named = words, words[:3] == ["spdx", "license", "identifier"]
        self.alone = self.size < ALONE and not self.named
        self.marks, self.version = marks_of(words), version_of(words)

    def agrees(self, words: list[str], first: int, own: int) -> bool:
        """If a stretch has the template's distinguishing words and version; a version that goes on behind it counts too."""
        end = first + own + 1
        stretch = words[first:end]
        if self.named:
            return stretch == self.words
        if marks_of(stretch) != self.marks:
            return False
        return not self.version or version_of(stretch + words[end : end + 1] if stretch[-1][-1].isdigit() and words[end : end + 1] and words[end].isdigit() else stretch) == self.version

    def best(self, at: np.ndarray, before: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, shared bigrams) of the best stretch from each start that reaches ``least``.

        at: places of the template's bigrams; before: for each, the place in at
        of the same bigram as many occurrences back as the template has it, or
        -1. Within a stretch from i, at[j] counts as shared if before[j] < i. All
        starts are taken one bigram further at a time, a block of them at once.
        """
        out = []
        if len(at) < self.need or (at[self.need - 1 :] - at[: len(at) - self.need + 1]).min() >= self.high:
            return (np.zeros(0, np.int64),) * 3
        for low in range(0, len(at), BLOCK):
            i = np.arange(low, min(low + BLOCK, len(at)))
            # a start whose next ``need`` places reach beyond the longest stretch has no match
            last = i + self.need - 1
            i = i[(last < len(at)) & (at[np.minimum(last, len(at) - 1)] - at[i] < self.high)]
            shared = np.zeros(len(i), np.int64)
            top, top_own, top_shared = np.zeros(len(i)), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            live, step = np.arange(len(i)), 0
            while len(live):
                j = i[live] + step
                live = live[j < len(at)]
                j = i[live] + step
                own = at[j] - at[i[live]] + 1
                live, j, own = live[own <= self.high], j[own <= self.high], own[own <= self.high]
                shared[live] += before[j] < i[live]
                dice = 2 * shared[live] / (own + self.size)
                better = (own >= self.low) & (dice >= least) & (dice >= top[live])  # of equal ones the longer
                hit = live[better]
                top[hit], top_own[hit], top_shared[hit] = dice[better], own[better], shared[hit]
                step += 1
            good = top_own > 0
            out.append((at[i[good]], top_own[good], top_shared[good]))
        return tuple(np.concatenate(x) for x in zip(*out))


class Scanner:
    """Templates by their bigrams."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.least = least
        self.templates = [Template(name, text, least) for name, text in templates]
        self.having: dict[tuple[str, str], list[int]] = {}
        for n, template in enumerate(self.templates):
            for g in template.grams:
                self.having.setdefault(g, []).append(n)
        self.known = set(self.having)

    def _extended(self, x: tuple, longer: list[tuple], agrees) -> bool:
        """If a match of a longer licence, whose wording starts as x's does, overlaps x."""
        names = LONGER.get(self.templates[x[3]].name)
        if not names or not longer:
            return False
        most = max(t.high for t in self.templates if t.name in names)
        near = longer[bisect_left(longer, (x[2] - most,)) : bisect_right(longer, (x[2] - x[1] + 1,))]
        return any(self.templates[y[3]].name in names and x[2] <= y[2] - y[1] and agrees(y) for _, y in near)

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """Matches as (first word, number of words, licence, Dice), not overlapping, in order.

        For each template, stretches begin and end with a bigram that it has. Of
        those from one start, of a size that the bounds leave, the one of the
        highest coefficient counts, of equals the longest, if its distinguishing
        words and version are the template's. Of all these the best is a match,
        then the next that doesn't overlap it; ties go to the longer, then the
        earlier, then the first template. Memory is in proportion to the text,
        time to that and a template's length.
        """
        low = text.lower()
        words = _WORD.findall(low)
        if self.known.isdisjoint(zip(words, words[1:])):
            return []
        places: dict[int, list[int]] = {}
        for at, pair in enumerate(zip(words, words[1:])):
            for t in self.having.get(pair, ()):
                places.setdefault(t, []).append(at)
        found = []
        for t, spots in places.items():
            template = self.templates[t]
            if len(spots) < template.need:
                continue
            seen: dict[tuple[str, str], list[int]] = {}
            before = np.full(len(spots), -1)
            for n, at in enumerate(spots):
                same = seen.setdefault((words[at], words[at + 1]), [])
                if len(same) >= (k := template.grams[words[at], words[at + 1]]):
                    before[n] = same[-k]
                same.append(n)
            for first, own, shared in zip(*(x.tolist() for x in template.best(np.array(spots), before, self.least))):
                found.append((-2 * shared / (own + template.size), -own, first, t))
        agreed: dict[tuple, bool] = {}
        spans: list[tuple[int, int]] = []

        def agrees(x: tuple) -> bool:
            if x not in agreed:
                template = self.templates[x[3]]
                agreed[x] = template.agrees(words, x[2], -x[1]) and (not template.alone or whole(x[2], x[2] - x[1])) and not (template.named and behind(x[2] - x[1]) == "-")
            return agreed[x]

        def behind(last: int) -> str:
            if not spans:
                spans.extend(m.span() for m in _WORD.finditer(low))
            return low[spans[last][1] : spans[last + 1][0] if last + 1 < len(spans) else len(low)]

        def whole(first: int, last: int) -> bool:
            after = behind(last)
            before = low[spans[first - 1][1] if first else 0 : spans[first][0]]
            return (not first or _STOP.search(before) is not None) and (last + 1 == len(spans) or _STOP.search(after) is not None)

        after = {name for names in LONGER.values() for name in names}
        longer = sorted((x[2], x) for x in found if self.templates[x[3]].name in after)
        chosen: list[tuple[int, int, str, float]] = []
        taken = bytearray(len(words))
        for dice, own, first, t in sorted(found):
            end = first - own + 1  # words, one more than bigrams
            x = (dice, own, first, t)
            if taken.find(1, first, end) < 0 and agrees(x) and not self._extended(x, longer, agrees):
                taken[first:end] = b"\1" * (end - first)
                chosen.append((first, 1 - own, self.templates[t].name, -dice))
        return sorted(chosen)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, license, dice, matches for every row of docs(doc_id, text).

    matches: array of (first_word, n_words, license, dice) in order; license and
    dice are those of the best one (the first of equals), null without any. Words
    are runs of a-z and 0-9 in lower case. A null or empty text has none. Each
    row gives one row; no shuffle, one Arrow batch in memory.
    """
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))

    def run(batches):
        scan = scanner().scan
        for batch in batches:
            all_found = [scan(t) if t else [] for t in batch.column("text").to_pylist()]
            best = [min(f, key=lambda x: (-x[3], x[0])) if f else (None,) * 4 for f in all_found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(f) for f in all_found], pa.int64()),
                    pa.array([b[2] for b in best], pa.string()),
                    pa.array([b[3] for b in best], pa.float64()),
                    pa.array([[dict(zip(("first_word", "n_words", "license", "dice"), x)) for x in f] for f in all_found], kind),
                ],
                ["doc_id", "n_matches", "license", "dice", "matches"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, n_matches long, license string, dice double, matches array<struct<first_word: long, n_words: long, license: string, dice: double>>")
