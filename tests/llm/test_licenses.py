from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagesift.llm import license_scan as L
from pagesift.llm.license_scan import NOTICES, scan_licenses, size_bounds
from tests.llm.data import DOCS, documents


def grams(text):
    w = re.findall("[a-z0-9]+", text.translate(str.maketrans(L._UPPER, L._LOWER)))
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def segments(text):
    lines = text.split("\n")
    paragraphs = [p for p in re.split(r"\n[ \t\r]*\n[ \t\r\n]*", text) if "\n" in p]
    found = lines + paragraphs
    for wholes, stop in ((lines, r"[.;:!?][ \t]+"), (paragraphs, r"[.;:!?][ \t\r\n]+")):
        for whole in wholes:
            parts = [x for x in re.split(stop, whole) if re.search("[A-Za-z0-9]", x)]
            found += [x for x in parts if len(parts) > 1 and (wholes is lines or "\n" in x.strip(" \t\r\n"))]
    return found


def brute(rows, threshold):
    out = {}
    for doc_id, text in rows:
        for s in segments(text) if text is not None else []:
            a, scored = grams(s), []
            for name, notice in NOTICES:
                b = grams(notice)
                family, marks = L.family_of(name)
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= threshold:
                    other = a & set(marks) != b & set(marks)
                    scored.append((other, -dice, family if other else name))
            if scored:
                _, low, name = min(scored)
                n, dice = out.get((doc_id, name), (0, 0.0))
                out[doc_id, name] = (n + 1, max(dice, -low))
    return out


def notice(name, at=0):
    return [text for n, text in NOTICES if n == name][at]


def wrapped(text, width=60):
    return "\n".join(re.findall(rf".{{1,{width}}}(?:\s|$)", text))


GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def test_equals_brute_force(spark):
    mit, bsd = notice("MIT", 2), notice("BSD-3-Clause", 1)
    texts = [
        "prose\nReleased under the MIT License.\nmore", "LICENSED under the apache license -- version 2.0!", "This work is licensed under the GNU General Public License, version 2.",
        "intro\n\n" + wrapped(mit) + "\n\noutro", None, "", "word", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "Licensed by me under no licence at all", "the the the the", mit * 50,
        "It is mine. Released under the MIT License. Have fun! ", wrapped("Some words first. " + GPL.format("GNU General Public License", "3") + " And some after."), wrapped(bsd), bsd,
        "\n" + wrapped(notice("ISC")) + ".  \nx", "\r\n".join(["Licensed under CC BY-SA 2.5.", "", "a. b", "c"]), " . ; \n . ",
    ]
    rows = list(enumerate(texts))
    for threshold in (0.75, 0.5):
        got = {(r.doc_id, r.license): (r.n_segments, r.dice) for r in scan_licenses(documents(spark, texts), threshold=threshold).collect()}
        assert got == brute(rows, threshold)
    assert {(3, "MIT"), (11, "MIT"), (12, "GPL-3.0"), (13, "BSD-3-Clause"), (14, "BSD-3-Clause")} <= got.keys()


def test_versions_and_variants_are_told_apart(spark):
    cases = [
        (GPL.format("GNU General Public License", "2"), "GPL-2.0"),
        (GPL.format("GNU General Public License", "3"), "GPL-3.0"),
        (GPL.format("GNU Affero General Public License", "3"), "AGPL-3.0"),
        (GPL.format("GNU Lesser General Public License", "2.1").replace("program", "library"), "LGPL-2.1"),
        (GPL.format("GNU Lesser General Public License", "3"), "LGPL-3.0"),
        (GPL.format("GNU Affero General Public License", "2"), "GNU"),  # there is none
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
        ("This work is licensed under a Creative Commons Attribution 9.0 International License.", "CC"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        (notice("Apache-2.0", 1).replace("2.0", "1.1"), "Apache"),
        ("Licensed under the Apache License, Version 1.1.", None),  # too few words in common
        ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
        (notice("BSD-3-Clause", 1).replace("3.", "All advertising materials must display an acknowledgement. 4."), "BSD"),
        (notice("BSD"), "BSD"),
    ]
    got = {r.doc_id: r.license for r in scan_licenses(documents(spark, [t for t, _ in cases])).collect()}
    assert [got.get(i) for i in range(len(cases))] == [name for _, name in cases]


def test_every_notice_is_found_as_its_own(spark):
    got = {(r.doc_id, r.license) for r in scan_licenses(documents(spark, [text for _, text in NOTICES])).where("dice = 1").collect()}
    assert {(i, name) for i, (name, _) in enumerate(NOTICES)} <= got


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_size_bounds_and_keys_never_prune_a_match(threshold):
    for n in range(1, 40):
        low, high = size_bounds(n, threshold)
        assert [a for a in range(1, 200) if 2 * min(a, n) / (a + n) >= threshold] == list(range(low, high + 1))
        template = [f"{i:03d} x" for i in range(n)]
        keys = set(L.key_bigrams(template, threshold))
        # the most that a set can share without a key, alone or with others beside
        rest = n - len(keys)
        assert not any(2 * rest / (a + n) >= threshold for a in range(max(1, rest), 200))


def test_equal_dice_goes_to_the_first_name_and_long_texts_are_whole(spark):
    notices = [("B-1", "one two three four five"), ("A-1", "one two three four five"), ("C-1", "six seven eight nine ten")]
    texts = ["One two; three four five", "w " * 300_000 + ".\nsix seven eight nine ten.\n" + "prose here. " * 20_000]
    got = {(r.doc_id, r.license, r.n_segments) for r in scan_licenses(documents(spark, texts), notices).collect()}
    assert got == {(0, "A-1", 1), (1, "C-1", 1)}


def test_plan_has_no_python(spark):
    plan = scan_licenses(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_repeats_clashes_and_empty(spark):
    text = "Released under the MIT License."
    docs = documents(spark, [(None, text), (2, text), (2, text)]).withColumns({"license": F.lit(1), "best": F.lit(2)})
    assert sorted((r.doc_id or 0, r.n_segments) for r in scan_licenses(docs).collect()) == [(0, 1), (2, 2)]
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
