import re

import pytest

from duecheck.llm import license_rules, license_scan, queries

RULES = license_rules.rules()
TEXTS = [
    None, "", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "cc\n-- By, cc by by cc",
    "This work is licensed under the GNU General Public License, version 3.", "ALL RIGHTS  RESERVED. all-rights\nreserved",
    "GNU Lesser General\n Public License v2.1 and the general public library", "é" * 70_000 + " all rights reserved " + "x " * 40_000,
    "// SPDX-License-Identifier: MIT\n/* SPDX-License-Identifier: GPL-2.0-or-later */ mit license, MIT License", "accby cc bya occ by",
    "https://creativecommons.org/licenses/by-sa/4.0/ Creative Commons Attribution-ShareAlike 4.0", "Copyright (c) 2019 Jane. No licence.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy, MIT license", "Kcc by General Pubİc License",
    "placed in the public domain; released under the Foo Bar license. 🙂 The Unlicense", "plain words only", "cc0 1.0 CC0",
]


def plain(text):
    """The same result word by word and rule by rule."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, base = [], set()
    for label, phrase in {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}.items():
        phrase = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        places += at
        base |= {label} if at else set()
    spans = [(m.start(), m.end(), r) for r in RULES for m in re.finditer(r.pattern, text, re.ASCII)]

    def beaten(d):
        for s, e, r in spans:
            if d[2].priority == 5 and r.priority < 5 and s < d[1] and d[0] < e:
                return True
            if s <= d[0] and e >= d[1]:
                longer = e - s > d[1] - d[0]
                if (longer and r.priority <= d[2].priority) or (not longer and (r.priority, r.order) < (d[2].priority, d[2].order)):
                    return True
        return False

    alive = [d for d in spans if not beaten(d)]
    labels = base | {d[2].label for d in alive}
    score = max([0.5 if base else 0.0] + [d[2].weight for d in alive])
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def digests(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    return {r.doc_id: tuple(r)[1:] for r in license_scan.digest(license_scan.scan(docs)).collect()}


def test_against_plain_scan(spark):
    got = digests(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == plain(t), t
    assert got[2][5] == "cc-by,cc-by-nc-4.0"
    assert got[3][5] == "apache-2.0" and got[5][5] == "gpl,gpl-3.0"


def test_hundreds_of_rules():
    assert len(RULES) > 250 and len({(r.label, r.pattern) for r in RULES}) == len(RULES)


@pytest.mark.parametrize("rule", [r for r in RULES if ".{" not in r.pattern], ids=lambda r: f"{r.order}-{r.label}")
def test_matches_hold_their_keywords_and_an_anchor(rule):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=15, deadline=None)
    @given(st.from_regex(re.compile(rule.pattern, re.ASCII), fullmatch=True))
    def check(text):
        assert all(k in text for k in rule.keywords), (text, rule)
        near = any(a in text for a in license_rules.ANCHORS) or re.search(r"cc[^a-z0-9\x80-\U0010ffff]+by", text)
        assert near or ("general" in text and "public" in text), (text, rule)

    check()


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.queries()["op2_license_scan"](spark, folder).collect()
    assert len(rows) == len(texts) and sum(r.labels != "" for r in rows) > 5
    assert all(tuple(r)[1:] == plain(texts[r.doc_id]) for r in rows)


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "cc by")], "doc_id long, text string")
    assert [r.n_base for r in license_scan.digest(license_scan.scan(docs)).collect()] == [1, 1, 1]
    assert license_scan.digest(license_scan.scan(docs.limit(0))).collect() == []


NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated"
     " documentation files (the \"Software\"), to deal\nin the Software without restriction"),
    ("gpl-2.0+", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either"
     " version 2 of the License, or\n(at your option) any later version."),
    ("gpl-3.0+", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either"
     " version 3 of the License, or\n(at your option) any later version."),
    ("mpl-2.0", "obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2.0", "available at http://www.eclipse.org/legal/epl-2.0"),
    ("reserved", "Alle Rechte\nvorbehalten."),
    ("reserved", "Todos los derechos reservados."),
    ("perl", "you can redistribute it and/or modify\nit under the same terms as Perl itself."),
    ("proprietary", "This file is confidential and proprietary.\nAll rights belong to Foo."),
    ("unknown", "Released under the Foo Bar\nlicense"),
]


def test_standard_notices_over_line_ends(spark):
    got = digests(spark, [t for _, t in NOTICES])
    for i, (label, text) in enumerate(NOTICES):
        assert label in got[i][5].split(","), (label, got[i])
        assert got[i] == plain(text)
