"""License notices by conditional compression.

A block of a text that has a cue word of licences is compressed alone and with
each licence's wordings as a zstandard raw dictionary. A licence whose words the
block repeats makes it much smaller; licences are ranked by that reduction. The
winners are then compared word by word with the block, which tells licences apart
that differ in one word or a version, and gives the exact differences.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame

from acreledger.llm.common import fields, map_column

# Names of licences and, for some, the standard text of their notice.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License, Version 2", "Apache 2.0 License", "Apache 2 License", "Apache-2.0", "Apache v2", "Apache 2"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "CC-BY-4.0": [],
    "CC-BY-NC-4.0": [],
    "CC-BY-ND-4.0": [],
    "CC-BY-SA-4.0": [],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal License", "CC0-1.0"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "ISC": ["ISC License", "ISC"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License", "MIT"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL v2.0", "MPL-2.0", "MPL 2"],
}
for _id, _title, _version in (("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3")):
    _versions = [_version] if "." in _version else [_version, _version + ".0"]
    for _short in (_id.split("-")[0], "GNU " + _id.split("-")[0], "GNU " + _title):
        NAMES[_id] += [f"{_short} {_mark}{_v}" for _v in _versions for _mark in ("v", "version ", "")]
for _id, _title in (("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"), ("CC-BY-SA-4.0", "Attribution-ShareAlike")):
    NAMES[_id] += [_id, "Creative Commons " + _id[3:]] + [f"Creative Commons {_title} 4.0{_end}" for _end in (" International License", " International", " License", "")]
FORMS = [
    "Licensed under the {}", "Licensed under {}", "Licensed under a {}", "Released under the {}", "Released under {}", "This work is licensed under the {}", "This work is licensed under {}", "Distributed under the {}", "Distributed under {}",
    "Available under the {}", "Available under {}", "Published under the {}", "Published under {}", "Under the terms of the {}", "Under the terms of {}", "Under the terms and conditions of the {}", "Covered by the {}", "Governed by the {}",
    "Uses the {}", "License: {}", "SPDX-License-Identifier: {}"]
TEXTS = {
    "Apache-2.0": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CREATIVE = "This work is licensed under the Creative Commons {} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
for _id, _kind, _version in (("AGPL-3.0", "Affero ", "3"), ("LGPL-3.0", "Lesser ", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("GPL-3.0", "", "3"), ("GPL-2.0", "", "2")):
    TEXTS[_id] = [*TEXTS.get(_id, [GNU.format("program", _kind, _version)]), GNU.format("library", _kind, _version)]
for _id, _kind in (("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"), ("CC-BY-SA-4.0", "Attribution-ShareAlike")):
    TEXTS[_id] = [CREATIVE.format(_kind, _id[3:-4].lower())]
TEXTS["CC0-1.0"] = ["To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.", "has waived all copyright and related or neighboring rights to"]
TEXTS["BSD-2-Clause"] = [BSD.format(*n) + AS_IS for n in (("1. ", "2. "), ("", ""))]
TEXTS["BSD-3-Clause"] += [BSD.format(*n) + n[2] + TEXTS["BSD-3-Clause"][0] for n in (("1. ", "2. ", "3. "), ("", "", ""))]
#: Words that tell licences apart; they may not differ from a wording.
TELLING = frozenset("affero lesser library noncommercial noderivatives sharealike nc nd sa".split())
CUES = ("licen", "copyright", "permission", "redistribut", "free software", "warrant", "spdx", "released under", "distributed under", "available under", "published under", "under the terms", "covered by", "governed by", "uses")

#: Winners of the ranking reduce a block by this share of the best reduction, and by this least; words of a wording that may differ.
NEAR, LEAST_REDUCTION, TOLERANCE = 0.6, 0.02, 0.1
#: A block of fewer characters in all gains nothing from compression; all licences are compared with it.
SMALLEST = 32
#: Wordings of fewer words must stand as they are.
SHORT = 16
LEVEL = 3
TABLE_ENTRIES = 20_000
#: Words of the windows that are ranked from each place where a wording may start, besides the longest.
WINDOWS = (2, 3, 4, 5, 8, 16, 40)
#: Words of a wording that are looked up at once.
ANCHOR = 3
# Fixed value: words that lead from one licence's name to another's.
LINKS = frozenset("or and the under either".split())
#: A short name that a version follows at once is a word of its own.
WORDS = re.compile(r"(?<![^\W_])(?:[al]?gpl|mpl|apache|bsd)(?=v?\d)|[^\W_]+(?:[.'’][^\W_]+)*", re.IGNORECASE)
SPELLINGS = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def wordings(license_id: str) -> list[str]:
    """Every known notice of a licence: its names in the usual forms, and standard texts."""
    return [f.format(n) for n in NAMES[license_id] for f in FORMS] + TEXTS.get(license_id, [])


def words(text: str) -> list[str]:
    return [spelled(w) for w in WORDS.findall(text)]


def spelled(word: str) -> str:
    low = word.lower()
    return SPELLINGS.get(low, low)


def differences(wording: list[str], block: list[str]) -> list[str] | None:
    """Words that a block, read from its start, lacks (-) or adds (+) against a wording; None if too many or telling ones.

    Short wordings, which hold little but a licence's name, must be there as they
    are. A number, a word with a digit or one that tells licences apart must never differ.
    """
    most = int(TOLERANCE * len(wording)) if len(wording) >= SHORT else 0
    if block[: len(wording)] == wording:
        return []
    if most == 0:
        return None
    part = block[: len(wording) + most]
    if len(set(wording).difference(part)) > 2 * most:
        return None  # each of them is a difference
    matcher = difflib.SequenceMatcher(None, wording, part, autojunk=False)
    out: list[str] = []
    for kind, a, b, c, d in matcher.get_opcodes():
        if kind != "equal":
            tail = kind == "insert" and a == len(wording)  # what follows the notice
            out += [f"-{w}" for w in wording[a:b]] + ([] if tail else [f"+{w}" for w in part[c:d]])
    if len(out) > 2 * most or any(ch.isdigit() for w in out for ch in w) or not TELLING.isdisjoint(w[1:] for w in out):
        return None
    return out


class Scanner:
    """Finds notices in texts; made once in each task."""

    def __init__(self) -> None:
        self.wordings = {i: sorted(((words(w), w) for w in wordings(i)), key=lambda x: (-len(x[0]), x[1])) for i in sorted(NAMES)}
        self.brief = {tuple(w): i for i, ws in self.wordings.items() for w, _ in ws if len(w) < SHORT}
        self.brief_sizes = sorted({len(w) for w in self.brief}, reverse=True)
        self.full = {i: [w for w, _ in ws if len(w) >= SHORT] for i, ws in self.wordings.items()}
        self.longest = max(len(w) for ws in self.wordings.values() for w, _ in ws)
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given = {}
        for i in sorted(NAMES):
            # texts, then every form and every name once: a small dictionary, or short notices are lost in it
            content = "\n".join(TEXTS.get(i, []) + [f.format(NAMES[i][0]) for f in FORMS] + NAMES[i]).lower().encode()
            self.given[i] = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.found: dict[str, tuple | None] = {}
        self.anchors: dict[tuple[str, ...], set[int]] = {}
        for wording in (w for ws in self.wordings.values() for w, _ in ws):
            # differences can't touch all of these: they are more than may differ, and none overlaps another
            last = 2 * int(TOLERANCE * len(wording)) if len(wording) >= SHORT else 0
            for at in range(0, max(0, min(ANCHOR * last, len(wording) - ANCHOR)) + 1, ANCHOR):
                self.anchors.setdefault(tuple(wording[at : at + ANCHOR]), set()).add(at)
        self.anchor_sizes = sorted({len(a) for a in self.anchors})
        self.names = {tuple(words(n)): i for i, ns in NAMES.items() for n in ns}
        self.longest_name = max(map(len, self.names))

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """Licences by how much their wordings as a dictionary reduce the compressed block, the greatest reduction first."""
        data = block.lower().encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, i) for i, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def confirmed(self, block: list[str], ids: list[str]) -> tuple[str, int, list[str]] | None:
        """(licence, words, differences) of the longest wording, with the fewest differences, that the block starts with."""
        best = None
        for n in self.brief_sizes:
            i = self.brief.get(tuple(block[:n]))
            if i in ids and len(block) >= n:
                best = (-n, 0, i), (i, n, [])
                break
        for i in ids:
            for wording in self.full[i]:
                found = differences(wording, block)
                if found is not None:
                    rank = (-len(wording), len(found), i)
                    if best is None or rank < best[0]:
                        best = rank, (i, len(wording), found)
        return best[1] if best else None

    def notice(self, block: str) -> tuple[str, int, list[str]] | None:
        """The notice that a block starts with, of the licences that win the ranking of a window from its start."""
        if re.match(r"licen[cs]e\b(?!\s*[:=])", block, re.IGNORECASE):
            return None  # what the word names stands behind a colon
        if block not in self.found:
            if len(self.found) >= TABLE_ENTRIES:
                self.found.clear()
            ends = [m.end() for m in WORDS.finditer(block)]
            ids: set[str] = set()
            for n in (*(n for n in WINDOWS if n < len(ends)), len(ends)):
                ranks = self.ranked(block[: ends[n - 1]])
                tiny = n == len(ends) and ends[-1] < SMALLEST
                least = -1 if tiny else max(LEAST_REDUCTION, NEAR * ranks[0][0])
                ids |= {i for r, i in ranks if r >= least}
            self.found[block] = self.confirmed(words(block), sorted(ids))
        return self.found[block]

    def starts(self, found: list[str]) -> list[int]:
        """Word places at which a wording may start: some of its words stand as far behind as in the wording."""
        out = set()
        for size in self.anchor_sizes:
            for i, key in enumerate(zip(*(found[k:] for k in range(size)), strict=False)):
                out |= {i - at for at in self.anchors.get(key, ()) if i >= at}
        return sorted(out)

    def spans(self, text: str) -> tuple[list[re.Match], list[str]]:
        """The words of a text with their places; none without a cue."""
        low = text.lower()
        spans = list(WORDS.finditer(text)) if any(c in low for c in CUES) else []
        return spans, [spelled(m[0]) for m in spans]

    def blocks(self, text: str | None) -> Iterator[tuple[int, str]]:
        """(place, block): from each word at which a wording may start, as many words as the longest wording can take up."""
        spans, found = self.spans(text or "")
        for i in self.starts(found):
            yield spans[i].start(), self.block(text, spans, i)

    def block(self, text: str, spans: list[re.Match], i: int) -> str:
        last = min(len(spans), i + int(self.longest * (1 + TOLERANCE)) + 1) - 1
        return text[spans[i].start() : spans[last].end()]

    def more_names(self, spans: list[re.Match], found: list[str], text: str, at: int) -> Iterator[tuple[str, int, int]]:
        """(licence, first word, words) of names that follow a notice by ``or``, ``and`` or a stroke."""
        while True:
            first = at
            while first < len(found) and found[first] in LINKS:
                first += 1
            if first >= len(found) or at == 0:
                return
            gap = text[spans[at - 1].end() : spans[first].start()]
            if not {"or", "and"} & set(found[at:first]) and gap.strip() not in ("/", "|"):
                return
            if re.search(r"[.!?;:]\s|\n\s*\n", gap):
                return
            n = next((n for n in range(self.longest_name, 0, -1) if tuple(found[first : first + n]) in self.names), 0)
            if not n:
                return
            yield self.names[tuple(found[first : first + n])], first, n
            at = first + n

    def scan(self, text: str | None) -> list[dict]:
        """Notices of a whole text: licence, place, words and differences; of those that overlap the longest, with the fewest differences."""
        spans, found = self.spans(text or "")
        place = {m.start(): i for i, m in enumerate(spans)}
        all_ = []
        for begin, block in self.blocks(text):
            if notice := self.notice(block):
                all_.append((place[begin], notice))
                # words before a notice that lacks its first ones are none of it
                ahead = next((n for n, w in enumerate(notice[2]) if w[0] == "-"), len(notice[2]))
                if ahead and (closer := self.notice(self.block(text, spans, place[begin] + ahead))):
                    all_.append((place[begin] + ahead, closer))
        all_.sort(key=lambda x: (-x[1][1], len(x[1][2]), x[0]))
        chosen: list[tuple[int, tuple]] = []
        taken = bytearray(len(spans))
        for i, notice in all_:
            end = i + notice[1]
            if any(taken[i:end]):
                continue
            taken[i:end] = b"\1" * (min(end, len(spans)) - i)
            chosen.append((i, notice))
            if notice[1] < SHORT:
                for license_id, first, n in self.more_names(spans, found, text, end):
                    if not any(taken[first : first + n]):
                        taken[first : first + n] = b"\1" * n
                        chosen.append((first, (license_id, n, [])))
        return [{"license": x[0], "place": spans[i].start(), "words": x[1], "differences": x[2]} for i, x in sorted(chosen)]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append notices: array of (license, place, words, differences), in order of place.

    place: characters before the notice. Null and empty texts, and texts without
    a cue, have none. Equal ranks go to the licence first by name. Input columns
    named like the result are replaced; texts are read whole.
    """

    def job():
        scanner = Scanner()
        return lambda values: [(scanner.scan(v),) for v in values]

    return map_column(docs, text, fields("notices array<struct<license: string, place: long, words: long, differences: array<string>>>"), job)
