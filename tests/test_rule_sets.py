from __future__ import annotations

from conftest import tuples

from fleetlens.operators import rule_sets


def test_rules_are_read_from_their_texts(spark):
    make = lambda *texts: spark.createDataFrame([("r", t) for t in texts], "repo string, text string")
    code = make('class A:\n    kind = "one"\n    rules = [\n        {"pattern": r"a\\s+b", "reason": "x"},\n        {\'pattern\': "c"},\n    ]\n', "kind = 'two'\nrules = []", "no rules")
    assert tuples(rule_sets.adapter_rules(code)) == [("r", "one", "a\\s+b"), ("r", "one", "c")]
    fall = make('X = {\n  "one": [\n    {"pattern": r"a\\s+b"},\n  ],\n  "three": [  # more\n    {"pattern": r"[x]"},\n  ],\n}')
    assert tuples(rule_sets.fallback_rules(fall)) == [("r", "one", "a\\s+b"), ("r", "three", "[x]")]
    book = make("---\r\nkind: one\r\nauth: |\r\n  - not: this\r\ndestructive_patterns:\r\n  # note\r\n  - 'a\\s+b'\r\n\r\n  - \"c\"\r\n  - it's\r\n  - 'it''s'\r\nrequires: [x]\r\nother:\r\n  - no\r\n---\r\n  - no\r\n", "destructive_patterns:\n  - x", "---\nkind: two\n---\n")
    assert tuples(rule_sets.playbook_rules(book)) == [("r", "one", "a\\s+b"), ("r", "one", "c"), ("r", "one", "it's")]


def test_parity_of_stated_sets(spark):
    rows = lambda *r: spark.createDataFrame([("r", *x) for x in r], "repo string, kind string, pattern string")
    code, book, fall = rows(("k", "a"), ("k", "b"), ("m", "z")), rows(("k", "a"), ("k", "c"), ("other", "q")), rows(("k", "a"), ("k", "b"), ("m", "z"), ("spare", "s"))
    assert tuples(rule_sets.rule_set_parity(code, playbook=book, fallback=fall)) == [
        ("r", "k", "b", "playbook", "code"), ("r", "k", "c", "playbook", "playbook"), ("r", "m", "z", "playbook", "code"),
    ]
    assert rule_sets.rule_set_parity(code, playbook=code, fallback=fall).count() == 0
