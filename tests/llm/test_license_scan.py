"""Notices of the given tables and published short forms and headers."""

import re

import pytest

from rivermeld.llm.license_scan import HINT, NAMES, RULES, SENTENCES, recognised
from rivermeld.llm.shared import table

GNU = ("/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU %s Public License as\n"
       " * published by the Free Software Foundation, either version 3 of the\n * License, or (at your option) any later version.\n */\nint x;")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_notices_that_end_given_documents_are_known(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    last = docs.selectExpr("regexp_extract(rtrim(text), '(?:^|\\\\n|[.!?][ ])([^\\\\n]*?[.]?)$', 1) AS s").where("s RLIKE '(?i)licen[sc]e'")
    found = {re.sub("[^a-z0-9]+", " ", re.split(r"(?<=[.!?])\s+", r["s"])[-1].lower()).strip() for r in last.distinct().collect()}
    assert found and found <= set(SENTENCES)


def test_names_and_headers(spark, docs):
    cases = [
        ("Text.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"), ("Released under CC0.", "CC0-1.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
        ("Licensed under CC BY-NC.", "CC-BY-NC"), ("Released under the GNU Affero General Public License v3.0.", "AGPL-3.0"),
        ("Licensed under the LGPL-3.0-or-later.", "LGPL-3.0"), ("Released under the GNU General Public License, version 2.", "GPL-2.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("Released under the Unlicense.", "Unlicense"),
        ("Licensed under the Eclipse Public License 2.0", "EPL-2.0"), ("Released under the zlib license.", "Zlib"), ("Licensed under BSL-1.0.", "BSL-1.0"),
        ("This is free and unencumbered software released into the\npublic domain.", "Unlicense"), ("All rights\nreserved.", "proprietary"),
        (GNU % "Affero General", "AGPL-3.0"), (GNU % "Lesser General", "LGPL-3.0"), (GNU % "General", "GPL-3.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"), ("The tax licence is under review.", ""),
        ("Licensed under the Apache License, Version 2.0\nint x;\n\n" + GNU % "General" + "\nLicensed under CC BY 4.0\n", "Apache-2.0,CC-BY-4.0,GPL-3.0"),
    ]
    got = {r["doc_id"]: r["licenses"] for r in recognised(docs([(k, t) for k, (t, _) in enumerate(cases)])).collect()}
    assert [got[k] for k in range(len(cases))] == [x for _, x in cases]


def test_every_sentence_is_hinted_and_every_rule_can_hold():
    assert all(re.search(HINT, s) for s in SENTENCES)
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for s in SENTENCES)
    assert {i for _, r in RULES for i in r} <= set(SENTENCES.values())
    assert len({i for i, _, _ in NAMES}) == len(NAMES)
