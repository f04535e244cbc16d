"""Licenses in other list forms, with stray numbers, by SPDX lines, and on edge rows."""

import pytest

from fleetstats.llm import licenses

READY = licenses.Templates(licenses.ALL, marks=True)
BSD = (licenses._BSD.replace("1. ", "{0} ").replace("2. ", "{1} "), licenses._BSD_NAMES.replace("3. ", "{2} "))


def names(text):
    return [r[0] for r in READY.find(text)]


@pytest.mark.parametrize("marks", [("*", "*", "*"), ("-", "-", "-"), ("•", "•", "•"), ("a.", "b.", "c."), ("a)", "b)", "c)"), ("(1)", "(2)", "(3)"),
                                   ("(i)", "(ii)", "(iii)"), ("1)", "2)", "3)"), ("1.", "2.", "3.")])
def test_conditions_in_every_list_form(marks):
    assert names(BSD[0].format(*marks)) == ["BSD-2-Clause"]
    assert names("Copyright 2020 A.\n" + (BSD[0] + BSD[1]).format(*marks)) == ["BSD-3-Clause"]


def test_stray_numbers_change_nothing():
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    text = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300)
    for n in ("7", "1999", "42."):
        words = text.split()
        found = READY.find(" ".join(words[:40] + [n] + words[40:]))
        assert [f[0] for f in found] == ["MIT"] and found[0][1] > 0.95
    assert names("3 " + mit + " 4") == ["MIT"]


@pytest.mark.parametrize("text,want", [
    ("Licensed under the Apache License 2.0", ["Apache-2.0"]), ("code\n# SPDX-License-Identifier: MIT\ncode", ["MIT"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]), ("// SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0"]),
    ("SPDX-License-Identifier: LGPL-2.1+", ["LGPL-2.1"]), ("SPDX-License-Identifier: CC-BY-SA-4.0", ["CC-BY-SA-4.0"]),
    ("SPDX-License-Identifier: Unknown-9", []), ("the MIT of 2.0 and the license 3", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
])
def test_short_forms_name_one_license(text, want):
    assert names(text) == want


def test_every_template_names_its_own_license():
    for name, text in licenses.ALL:
        assert names(text)[:1] == [name] or name in names(text), (name, names(text), text[:60])


def test_edge_rows(spark):
    notice = "Released under the MIT License."
    data = [(1, None), (2, ""), (None, notice), (3, notice), (3, notice), (4, "word " * 200_000 + notice), (5, "1. 2. 3. a. b. c. * - (1)")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS license", "2 AS dice")
    got = sorted(((r.id, r.license, r.dice) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(None, "MIT", 1.0), (3, "MIT", 1.0), (3, "MIT", 1.0), (4, "MIT", 1.0)], key=str)
    assert licenses.scan(df.limit(0)).count() == 0
