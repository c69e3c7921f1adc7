from __future__ import annotations

import random
import re

import pytest
from llm_fixtures import documents, invented, odd_documents  # noqa: F401

from fleetlens.llm import jaccard
from fleetlens.llm.components import connected_components


def sets_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, percent=75):
    sets = [sets_of(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def edited(text, draw, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(documents):
    draw = random.Random(4)
    line = "this line stands in every second text of the lot"
    texts = [t + (f"\n{line}" if i % 2 else "") for i, t in enumerate(invented(60, seed=1, words=70))]
    for base in texts[:20]:
        texts += [edited(base, draw, s) for s in (0.01, 0.02, 0.03, 0.05)] + [base.upper()]
    crowd = invented(1, seed=8, words=160)[0]
    texts += [edited(crowd, draw, 0.01) for _ in range(60)]
    chain = invented(1, seed=11, words=120)[0].split()
    texts += [" ".join(chain[i * 4 : i * 4 + 45]) for i in range(12)]
    texts += ["a b", "A b", "a", "", None, line, line + " x", "é É"]
    got = sorted(map(tuple, jaccard.jaccard_join(documents(texts, clash=True).repartition(4)).collect()))
    assert got == brute(texts)


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_other_bounds(documents, percent):
    draw = random.Random(percent)
    texts = invented(10, seed=2, words=50)
    texts += [edited(t, draw, s) for t in texts for s in (0.02, 0.05, 0.1)]
    got = sorted(map(tuple, jaccard.jaccard_join(documents(texts), percent).collect()))
    assert got == brute(texts, percent)


def test_result_does_not_depend_on_late_grams_or_stars(documents, monkeypatch):
    draw = random.Random(7)
    texts = invented(15, seed=6, words=50)
    texts += [edited(t, draw, 0.02) for t in texts for _ in range(4)]
    want = brute(texts)
    for late, star in ((0, 0), (1 << 17, 10**6), (5, 2)):
        monkeypatch.setattr(jaccard, "LATE", late)
        monkeypatch.setattr(jaccard, "STAR", star)
        assert sorted(map(tuple, jaccard.jaccard_join(documents(texts)).collect())) == want


def test_odd_rows(odd_documents):
    rows = [tuple(r) for r in jaccard.jaccard_join(odd_documents).collect()]
    assert len(rows) == odd_documents.count()
    found = {r[0]: r[1:] for r in rows}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[5][1] == found[6][1] == 5 and found[None][1] is None and found[-8] == (1, -8)
    assert jaccard.jaccard_join(odd_documents.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(70)]
    edges += [(7, 7), (None, 3), (5, None), (2, 1), (1, 2)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = sorted(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == sorted((i, root(i)) for i in parent)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
