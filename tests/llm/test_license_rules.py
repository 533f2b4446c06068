"""License labels against a plain word-by-word scan."""

import re

from casewright.llm import license_rules as lr

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None,
    "",
    "The MIT License. mit-license, MIT\nLICENSE mit license mit license",
    "Licensed under the Apache License, Version 2.0.",
    "GNU Lesser General Public License v2.1 or later",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "permit licenses summit license éMIT license",
    "words only " * 20_000,
    "a license " * 5_000 + "general  public\tlicense",
    "BSD 3-Clause License; Mozilla Public License Version 2.0; all rights reserved",
]


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in lr.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    places.sort()
    return len(words), places


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, labels int")


def test_against_plain_scan(spark):
    rows = {r["doc_id"]: r for r in lr.scanned(frame(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n, places = plain(text)
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places)), i
        assert r["first_word"] == (places[0][0] if places else None)
        assert r["last_word"] == (places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_suppression_and_labels(spark):
    rows = {r["doc_id"]: r for r in lr.scanned(frame(spark, TEXTS)).collect()}
    assert rows[3]["labels"] == "apache" and rows[3]["score"] == 1.0 and rows[3]["n_matches"] == 1
    # The base phrase counts although its rule is suppressed by the longer name.
    assert rows[4]["labels"] == "gpl,lgpl" and rows[4]["n_matches"] == 1
    assert rows[6]["labels"] == "cc-by-nc"
    assert rows[10]["labels"] == "bsd,mpl,proprietary"


def test_table_and_empty(spark):
    assert lr.check_rules() >= 200
    assert lr.scanned(frame(spark, [])).count() == 0


def test_each_name_alone_and_wrapped(spark):
    """Every name has its label, also in capitals, over two lines, or with marks between its words."""
    names = [(label, re.sub(r"\[(.)[^]]*\]", r"\1", n)) for label, group in lr.LICENSES for n in group]
    cases = [(label, n.replace(" ", gap)) for label, n in names for gap in (" ", "\n", "-", ") (", "_")]
    cases += [(label, n.upper()) for label, n in names]
    rows = {r["doc_id"]: r for r in lr.scanned(frame(spark, [t for _, t in cases])).collect()}
    missed = [c for i, c in enumerate(cases) if c[0] not in rows[i]["labels"].split(",") or not rows[i]["n_matches"]]
    assert not missed


def test_short_identifiers(spark):
    tags = {
        "MIT": "mit", "Apache-2.0": "apache", "GPL-2.0-only": "gpl", "LGPL-2.1-or-later": "lgpl", "BSD-3-Clause": "bsd",
        "CC-BY-SA-4.0": "cc-by-sa", "BSL-1.0": "boost", "BUSL-1.1": "bsl", "CC0-1.0": "cc0", "MulanPSL-2.0": "mulan",
    }
    rows = {r["doc_id"]: r for r in lr.scanned(frame(spark, [f"// SPDX-License-Identifier: {t}\nint x;" for t in tags])).collect()}
    assert [rows[i]["labels"] for i in range(len(tags))] == list(tags.values())
    assert {r["score"] for r in rows.values()} == {0.9}
