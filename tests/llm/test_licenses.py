import pytest

from acreledger.llm import licenses, queries
from acreledger.llm.licenses import NAMES, Scanner, scan

SCANNER = Scanner()


def usual(license_id):
    """Every form with the first name, every name in the first form, and the texts."""
    forms = [f.format(licenses.NAMES[license_id][0]) for f in licenses.FORMS]
    return forms + [licenses.FORMS[0].format(n) for n in licenses.NAMES[license_id][1:]] + licenses.TEXTS.get(license_id, [])


def brute(text):
    """Each sentence against each wording, without compression."""
    out, done = [], -1
    for begin, block in SCANNER.blocks(text):
        if begin < done:
            continue
        found = SCANNER.confirmed(licenses.words(block), sorted(NAMES))
        if found:
            ends = [m.end() for m in licenses.WORDS.finditer(block)]
            done = begin + ends[min(found[1], len(ends)) - 1]
            out.append((found[0], begin))
    return out


@pytest.mark.parametrize("license_id", sorted(NAMES))
def test_every_wording_is_found_in_a_text(license_id):
    for wording in usual(license_id):
        text = f"Some words before it.\nand more {'x' * 50}\n{wording}. Then more words follow here\nand there."
        assert [n["license"] for n in SCANNER.scan(text)] == [license_id], wording
        assert [x[0] for x in brute(text)] == [license_id]


def test_wording_differences():
    mit = licenses.TEXTS["MIT"][0]
    changed = mit.replace("free of charge", "without charge").replace(" merge,", "")
    found = SCANNER.scan(f"x\n{changed}\ny")
    assert [n["license"] for n in found] == ["MIT"] and set(found[0]["differences"]) == {"-free", "-of", "+without", "-merge"}
    wrapped = mit.replace(" ", "\n", 30)
    assert [n["license"] for n in SCANNER.scan(wrapped)] == ["MIT"]
    gpl = licenses.TEXTS["GPL-3.0"][0]
    assert [n["license"] for n in SCANNER.scan(gpl.replace("version 3", "version 2"))] == ["GPL-2.0"]
    assert SCANNER.scan(gpl.replace("version 3", "version 9")) == []
    assert [n["license"] for w in ("License: AGPL v3", "Uses the LGPL 2.1", "License: ISC") for n in SCANNER.scan(w)] == ["AGPL-3.0", "LGPL-2.1", "ISC"]
    assert SCANNER.scan("Released under the terms of our license, ask us.") == [] == SCANNER.scan("We talk about the MIT License") == SCANNER.scan(None) == SCANNER.scan("")


def test_two_notices_and_their_places():
    text = "Intro. Released under the MIT License. Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."
    assert [(n["license"], text[n["place"] :][:8]) for n in SCANNER.scan(text)] == [("MIT", "Released"), ("CC-BY-NC-4.0", "Licensed"), ("Apache-2.0", "Licensed")]


def test_frame(spark):
    rows = [(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (None, None, "y"), (2, "", None), (3, "license " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Notices string")
    assert sorted(len(r.notices) for r in scan(df).collect()) == [0, 0, 0, 1, 1]
    assert scan(df.limit(0)).count() == 0


def test_query_as_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: brute(r.text) for r in docs}
    got = queries.QUERIES["op10_license_scans"](spark, sf).collect()
    assert {r.doc_id: (r.n_notices, r.licenses) for r in got} == {k: (len(v), ",".join(sorted({x[0] for x in v}))) for k, v in want.items()}
    assert sum(r.n_notices for r in got) > 10


def search(text):
    """Every word place against every wording, without anchors or compression."""
    found = licenses.words(text)
    return {c[0] for i in range(len(found)) if (c := SCANNER.confirmed(found[i:], sorted(NAMES)))}


@pytest.mark.parametrize("license_id", sorted(NAMES))
def test_wordings_inside_sentences(license_id):
    for wording in usual(license_id):
        text = f"Copyright (c) 2024 Some People and others who wrote the program in the years before and it is {wording} and so on as everybody who reads it knows well enough"
        assert {n["license"] for n in SCANNER.scan(text)} == {license_id} == search(text), wording
        assert [text[n["place"] :].startswith(wording[:5]) for n in SCANNER.scan(text)] == [True]


@pytest.mark.parametrize(("text", "want"), [
    ("This project is licensed under the MIT License", ["MIT"]),
    ("Copyright (c) 2024 X, licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
    ("The code is released under the MIT License", ["MIT"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0", ["MIT", "BSD-3-Clause", "GPL-2.0"]),
    ("dual licensed under the MIT License and the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("Licensed under MIT/Apache-2.0", ["MIT", "Apache-2.0"]),
    ("Licensed under the MIT License. And MIT is a school", ["MIT"]),
    ("This project uses the MIT license.", ["MIT"]),
    ("License: MIT", ["MIT"]),
    ("licensed under the GNU GPL v3", ["GPL-3.0"]),
    ("This software is licensed under GPLv3", ["GPL-3.0"]),
    ("Available under the terms of the Apache 2.0 license", ["Apache-2.0"]),
    ("Content is available under CC-BY-SA 4.0", ["CC-BY-SA-4.0"]),
    ("Licence: GPLv2 or LGPLv2.1", ["GPL-2.0", "LGPL-2.1"]),
    ("The licence MIT students like, and a license ISC knows", []),
    ("It is licenced under a Creative Commons Attribution-NonCommercial 4.0 International Licence.", ["CC-BY-NC-4.0"]),
    ("licensed under GPLv9", []),
])
def test_notices_inside_sentences_and_dual_licences(text, want):
    assert [n["license"] for n in SCANNER.scan(text)] == want


def test_changed_notice_inside_a_sentence():
    mit = licenses.TEXTS["MIT"][0].replace("Permission is hereby", "Permission hereby").replace(" merge,", "")
    found = SCANNER.scan(f"We say that {mit} and so on")
    assert [(n["license"], set(n["differences"])) for n in found] == [("MIT", {"-is", "-merge"})]


def test_every_licence_has_a_notice_text():
    assert set(licenses.TEXTS) == set(NAMES)


def test_headers_that_differ_in_a_word():
    header = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for kind, version, want in (("Affero", "3", ["AGPL-3.0"]), ("Lesser", "3", ["LGPL-3.0"]), ("Lesser", "2.1", ["LGPL-2.1"]), ("Library", "2", []), ("Affero", "2", []), ("", "2", ["GPL-2.0"]), ("", "3", ["GPL-3.0"])):
        for thing in ("program", "library"):
            assert [n["license"] for n in SCANNER.scan(f"It says: {header.format(thing, kind, version)} You should")] == want, (kind, version, thing)
    mixed = licenses.TEXTS["CC-BY-SA-4.0"][0].replace("ShareAlike", "NonCommercial-ShareAlike").replace("by-sa", "by-nc-sa")
    assert SCANNER.scan(mixed) == []


def test_bsd_texts():
    two, three = licenses.TEXTS["BSD-2-Clause"][0], licenses.TEXTS["BSD-3-Clause"][1]
    assert [n["license"] for n in SCANNER.scan(two.replace(" 2.", "\n   2."))] == ["BSD-2-Clause"]
    assert [n["license"] for n in SCANNER.scan(three.replace("the copyright holder nor", "Foo Inc nor"))] == ["BSD-3-Clause"]
    assert [n["license"] for n in SCANNER.scan("Permitted. " + two.split("THIS")[0] + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software.")] == []
