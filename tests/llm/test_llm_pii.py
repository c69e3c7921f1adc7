from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from llm_fixtures import documents, invented, odd_documents  # noqa: F401

from fleetlens.llm import boosting, pii


def naive(text):
    """The given patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@pytest.mark.parametrize("letters", ["a1@.-_+ (", "14.5 -", "+12 ().-", "a@b.cé_%", "0123456789 -+"])
def test_base_against_given_patterns(letters):
    draw = random.Random(letters)
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == naive(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000 + "@", "a@" * 100_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "ab1" * 70_000, "1 " * 100_000):
        start = time.perf_counter()
        pii.base_spans(text)
        pii.candidates(text)
        assert time.perf_counter() - start < 5


PLAIN = "call +1 (212) 555-0142 or mail jo.doe@mail.example.org from 10.0.0.7 with 4111 1111 1111 1111 now"


def test_rows_and_redaction(documents):
    texts = [PLAIN, "é 👍 a@b.co", None, "", "nothing here"]
    rows = pii.find_personal_data(documents(texts)).collect()
    assert [tuple(r)[1:5] for r in rows] == [(1, 1, 1, 1), (1, 0, 0, 0), (0,) * 4, (0,) * 4, (0,) * 4]
    want = ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(naive(PLAIN), key=lambda s: (pii.ALL.index(s[0]), s[1])))
    assert rows[0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert rows[0]["spans"].startswith(want) and rows[1]["spans"] == "email:4:10"
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(documents(texts, clash=True)).collect()}
    assert clean[0] == "call [PHONE] or mail [EMAIL] from [IP] with [CARD] now"
    assert clean[2] is None and clean[4] == "nothing here"
    assert pii.redact_text("+4111111111111111", [("card", 1, 17), ("phone", 0, 17)]) == "[PHONE]"


def secrets_corpus(n=240):
    draw = random.Random(5)
    hexes = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))
    texts = invented(n, seed=4)
    for i in range(n):
        extra = [f'token = "{hexes(40)}"', f"build {hexes(6)}{i} of 2024-05-06 at 12345678", f"part{i}-of-the-long-product-line-{i}", PLAIN][i % 4]
        texts[i] += f" {extra} " + texts[(i + 1) % n]
    return texts


def test_trees_add_secrets_and_leave_clean_text(documents):
    texts = secrets_corpus()
    model = pii.fit_selector(documents(texts))
    assert model.trees is not None and model.limits["secret"] < 1
    fresh = ['the api key: "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432" was leaked', *invented(40, seed=77), "room 101, page 20, 1999 and 2004, 3.14"]
    rows = pii.find_personal_data(documents(fresh), model).collect()
    assert [f["kind"] for f in rows[0]["found"]] == ["secret"] and rows[0]["spans"].startswith("secret:14:")
    assert all(r["spans"] == "" for r in rows[1:])
    # Base spans stay, and what is added touches none of them.
    for text, row in zip(texts, pii.find_personal_data(documents(texts), model).collect()):
        base = {(k, b, e) for k, b, e in naive(text)}
        found = {(f["kind"], f["start"], f["end"]) for f in row["found"]}
        assert base <= found
        assert not any(b < e2 and b2 < e for _, b, e in base for _, b2, e2 in found - base)


def test_fit_is_the_same_for_any_layout(documents):
    texts = secrets_corpus(120)
    a, b = (pii.fit_selector(documents(texts).repartition(n)) for n in (1, 7))
    assert a.limits == b.limits and np.array_equal(a.trees.leaf, b.trees.leaf)


def test_boosting_learns_an_interaction():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_threshold():
    score, y = np.array([0.9, 0.8, 0.8, 0.7, 0.1]), np.array([1, 1, 0, 1, 0.0])
    assert boosting.threshold(score, y, 0.75, 1) == 0.7
    assert boosting.threshold(score, y, 0.9, 1) == 0.9
    assert boosting.threshold(score, y, 0.9, 2) == float("inf")
    assert boosting.threshold(score[:0], y[:0], 0.9, 0) == float("inf")


def test_odd_rows(odd_documents):
    rows = pii.find_personal_data(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r["spans"] == "" for r in rows)
    assert sorted(map(str, pii.redact(odd_documents).collect())) == sorted(map(str, odd_documents.collect()))
    assert pii.find_personal_data(odd_documents.limit(0)).count() == 0


def test_long_secrets_are_found_whole(documents):
    model = pii.fit_selector(documents(secrets_corpus()))
    draw = random.Random(8)
    for n in (513, 1600, 20_000):
        body = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
        text = f'private key = "{body}" was leaked'
        assert ("secret", 15, 15 + n) in pii.candidates(text)
        assert [s[:3] for s in model.select(text, pii.base_spans(text))] == [("secret", 15, 15 + n)]


def test_candidates_of_any_length():
    name, host, digits = "x" * 300, "h" * 400 + ".org", "7" * 900
    assert [t for t in pii.candidates(f"to {name} (at) {host}.") if t[0] == "email"] == [("email", 3, 3 + 300 + 6 + 404)]
    assert [s[1:] for s in pii.candidates(f"no {digits} there") if s[0] == "card"] == [(3, 903)]
    text = "a@b@cc " + "@" * 50_000 + " y" * 50_000 + "1 " * 50_000
    assert ("email", 2, 6) in pii.candidates(text)


def test_few_documents_get_limits_too(documents):
    """The same rule for few candidates as for many: nothing has to occur a number of times."""
    for n in (24, 240):
        model = pii.fit_selector(documents(secrets_corpus(n)))
        text = 'the api key: "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432" was leaked'
        assert [s[0] for s in model.select(text, [])] == ["secret"], n


def test_sample_is_that_of_the_smallest_hashes(spark, documents):
    """However the share of documents grows, the sample is the one that sorting all candidates would give."""
    texts = secrets_corpus(400)
    whole = pii.fit_selector(documents(texts), sample=60)
    again = pii.fit_selector(documents(texts[:200]).unionByName(documents(texts).where("doc_id >= 200")), sample=60)
    assert whole.limits == again.limits and np.array_equal(whole.trees.leaf, again.trees.leaf)


def test_trees_add_what_the_base_patterns_miss(documents):
    draw = random.Random(6)
    number = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    texts = invented(600, seed=12)
    for i in range(len(texts)):
        extra = [
            f"call +1 ({number(3)}) {number(3)}-{number(4)} or mail {draw.choice(texts[0].split())}.{i}@mail.example.org now",
            f"tel: +49 {number(3)} {number(7)} and {texts[i].split()[0]}@host{i} on 2024-05-{i % 20 + 10}",
            f"order {number(8)} of 2023-11-{i % 20 + 10} in build {number(10)}, part {number(3)}-{number(6)}",
        ][i % 3]
        texts[i] += f" {extra} " + texts[(i + 1) % len(texts)]
    model = pii.fit_selector(documents(texts))
    fresh = ["please call (212) 555-0142 today", "write to jo (at) example.org today", "tel 030 5550142 is ours", "order 73519284 of 2022-07-19 in build 9081726354", "see user@host9 there"]
    found = [[(k, t[b:e]) for k, b, e, _ in model.select(t, pii.base_spans(t))] for t in fresh]
    assert found[:3] == [[("phone", "(212) 555-0142")], [("email", "jo (at) example.org")], [("phone", "030 5550142")]]
    assert found[3:] == [[], []]


def test_no_candidate_is_left_out_of_the_fit(documents):
    """Fits on the driver and in tasks see the same candidates, and select the same."""
    texts = secrets_corpus()
    here, tasks = pii.fit_selector(documents(texts)), pii.fit_selector(documents(texts), sample=60)
    assert abs(here.trees.start - tasks.trees.start) < 1e-12
    fresh = ['the api key: "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432" was leaked', *invented(40, seed=77), "room 101, page 20, 1999 and 2004, 3.14"]
    spans = lambda model: [[s[:3] for s in model.select(t, [])] for t in fresh]
    assert spans(here) == spans(tasks) and len(spans(tasks)[0]) == 1
    assert set(tasks.limits) == set(pii.ALL) and min(tasks.limits.values()) >= pii.LEAST
    assert boosting.threshold_of([(0.9, 2, 2), (0.7, 2, 1), (0.2, 1, 0)], 0.75) == 0.7
    assert boosting.threshold_of([(0.9, 2, 0)], 0.75) == float("inf")
