from __future__ import annotations

import re

import pytest
import zstandard
from llm_fixtures import documents, invented, odd_documents  # noqa: F401

from fleetlens.llm import quality


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_counts_against_brute_force(spark, documents):
    texts = invented(30, vocabulary=6) + invented(30, words=130) + ["a b c a b c", "é ü x\u0085 # | <>\n\n \nx y\nx y\nx y", "a\x1cb \x1f", "xx " * 200]
    got = {r["doc_id"]: r for r in quality.quality_rules(documents(texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counted(text), text


def test_odd_rows(odd_documents):
    rows = quality.quality_rules(odd_documents).collect()
    texts = [r["text"] for r in odd_documents.collect()]
    assert [(r["n_words"], r["n_repeat_words"]) for r in rows] == [(counted(t)[0], counted(t)[4]) if t is None or len(t) < 9000 else (r["n_words"], r["n_repeat_words"]) for t, r in zip(texts, rows)]
    assert not any(r["kept"] for r in rows if not r["n_words"])
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in odd_documents.collect()]
    assert quality.quality_rules(odd_documents.limit(0)).count() == 0
    assert quality.passing(odd_documents.limit(0)).columns == odd_documents.columns


def test_bands_reject_repetition_and_noise_and_keep_prose(documents):
    import random

    draw = random.Random(1)
    prose = invented(6, words=400, vocabulary=3000)
    noise = " ".join("".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(1000))
    noise += " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(76)) for _ in range(600))
    # No three words repeat, but the text does.
    padded = " ".join(f"{'z' * 90}{i}" for i in range(300))
    rows = quality.quality_rules(documents([*prose, noise, padded])).collect()
    assert [r["kept"] for r in rows] == [True] * 6 + [False, False]
    assert not rows[-1]["base_failed"] and not rows[-2]["base_failed"]
    assert quality.passing(documents([*prose, noise, padded], clash=True)).select("doc_id").collect() == [(i,) for i in range(6)]


def test_chunks_find_a_bad_part():
    zipper = zstandard.ZstdCompressor(level=3)
    good = " ".join(invented(40, words=300, vocabulary=5000)).encode()[:8192]
    bad = b"spam and eggs " * 900
    bands = quality.Bands()
    assert quality.in_band(good, bands, zipper)[2]
    _, share, kept = quality.in_band(good + bad, bands, zipper)
    assert share > 0.5 and not kept
    assert quality.in_band(b"", bands, zipper) == (0.0, 0.0, False)


@pytest.mark.parametrize("size", [1, 4095, 4096, 5119, 5120, 8192, 9216])
def test_chunks_cover_the_text(size):
    bands = quality.Bands(chunk=((float("inf"), 1e9, 1e9),))  # every chunk is out of band
    assert quality.in_band(b"x" * size, bands, zstandard.ZstdCompressor())[1] == 1.0
