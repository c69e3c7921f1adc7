from __future__ import annotations

import random
import re

import pytest
from llm_fixtures import documents, odd_documents  # noqa: F401

from fleetlens.llm import licenses


def base(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += own
        if own:
            labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(documents):
    draw = random.Random(2)
    bits = ["MIT", "mit", "License", "apache", "General", "PUBLIC", "licensé", "gnu", "x9", "é", "lesser", "permit"]
    texts = ["".join(draw.choice(bits) + draw.choice((" ", "-", "\n", ", ", "", "  ", "\u0085", "\x00")) for _ in range(draw.randint(0, 40))) for _ in range(600)]
    texts += [None, "", "mit", "MIT License" * 3, "mit license mit license", "the GNU Lesser General Public License"]
    rows = licenses.license_scan(documents(texts, clash=True)).collect()
    for text, r in zip(texts, rows):
        assert tuple(r)[1:6] == base(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(("expression", "want"), [
    ("mit", "mit"), ("mit or apache-2.0", "mit apache"), ("(mit or gpl-2.0-only with classpath-exception-2.0) and bsd-3-clause", "mit bsd,gpl bsd"),
    ("mit and (apache-2.0 or isc) */", "mit,apache mit,isc"), ("lgpl-2.1+ or agpl-3.0", "lgpl agpl"), ("mit is a licence", "mit"),
])
def test_expressions(expression, want):
    ways = licenses.evaluate(licenses.parse(expression))
    if expression.startswith("(mit or"):
        assert set(ways) == {frozenset({"mit", "bsd"}), frozenset({"gpl", "bsd"})}
    else:
        assert {",".join(sorted(w)) for w in ways} == {",".join(sorted(x.split(","))) for x in want.split()}


def test_operators_bind_in_order():
    assert licenses.parse("a or b and c with d or e") == ["a", "b", "c", "d", "with", "and", "or", "e", "or"]


@pytest.mark.parametrize("expression", ["", "and mit", "mit or", "(mit", "mit and (gpl-2.0", "()", "mit or or isc"])
def test_broken_expressions_give_no_label(expression):
    assert licenses.expression_labels(expression) == set()


def test_labels_of_the_method(documents):
    texts = [
        "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Linux-syscall-note) AND BSD-2-Clause\nint x;", "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining", "All rights reserved.", "a story about a license to kill",
        "the GNU Lesser General Public License",
    ]
    rows = licenses.license_scan(documents(texts)).collect()
    assert [r["labels"] for r in rows] == ["bsd,gpl,mit", "cc-by-nc", "mit", "proprietary", "", "gpl,lgpl"]
    assert [r["score"] for r in rows] == [1.0, 0.9, 0.9, 0.5, 0.0, 0.9]


def test_choices_are_what_expressions_evaluate_to(documents):
    texts = [
        "SPDX-License-Identifier: MIT OR GPL-2.0-only", "SPDX-License-Identifier: MIT AND GPL-2.0-only", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\n"
        "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: MIT OR (MIT AND GPL-2.0)", "SPDX-License-Identifier: (MIT", "mit license", "SPDX-License-Identifier: LicenseRef-x",
    ]
    rows = licenses.license_scan(documents(texts)).collect()
    assert [r["choices"] for r in rows] == ["gpl|mit", "gpl+mit", "apache+bsd|bsd+mit;isc", "mit", "", "", ""]
    assert [r["labels"] for r in rows][:2] == ["gpl,mit", "gpl,mit"]


def test_odd_rows(odd_documents):
    rows = licenses.license_scan(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r["n_base"] == 0 and r["first_word"] is None for r in rows)
    assert {r["doc_id"]: r["n_words"] for r in rows}[9] == 3
    assert licenses.license_scan(odd_documents.limit(0)).count() == 0
