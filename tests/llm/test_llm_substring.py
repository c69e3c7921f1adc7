from __future__ import annotations

import hashlib
import random
import re

import pytest
from llm_fixtures import documents, invented, odd_documents  # noqa: F401

from fleetlens.llm import substring


def brute(rows, window):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [2, 4, 20])
def test_against_brute_force(documents, window):
    draw = random.Random(window)
    passages = [x.split() for x in invented(6, seed=5, words=90)]
    texts = []
    for text in invented(60, seed=window, words=80, vocabulary=12 if window < 20 else 300):
        words = text.split()
        for _ in range(draw.randint(0, 3)):
            p, at = draw.choice(passages), draw.randint(0, len(words))
            a = draw.randint(0, len(p) - 1)
            words[at:at] = p[a : a + draw.randint(1, 60)]
        texts.append(draw.choice((" ", "\n", " \t ")).join(words))
    texts += texts[:5] + ["la " * 100, "la lo " * 60, "", None, "x"] + [" ".join(texts[7].split()[3:50])] * 3
    df = documents(texts).repartition(5)
    got = sorted(map(tuple, substring.repeated_substrings(df, window).collect()))
    assert got == brute(list(enumerate(texts)), window)


def test_odd_rows(odd_documents):
    rows = [tuple(r) for r in substring.repeated_substrings(odd_documents, keep_text=True).collect()]
    assert len(rows) == odd_documents.count()
    by_id = {r[0]: r for r in rows}
    assert by_id[1][1:3] == (0, 0) and by_id[2][1:3] == (0, 0)
    assert by_id[5][2] == 0 and by_id[6][2] == by_id[6][1] > 0 and by_id[6][4] == ""
    assert by_id[None][2] == 0  # nothing is earlier or later than a row without an id
    assert sum(r[0] == 5 for r in rows) == 2
    assert substring.repeated_substrings(odd_documents.limit(0)).count() == 0


def test_odd_windows_are_refused(odd_documents):
    with pytest.raises(ValueError):
        substring.repeated_substrings(odd_documents, 5)
