from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import documents, invented, odd_documents  # noqa: F401
from tokenizers import Tokenizer

from fleetlens.llm import packing


def ids_of(texts):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, ids, window):
    """Every id in one piece, pieces gapless in sequences of at most the window."""
    spans, sequences = {}, {}
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in enumerate(ids):
        at = 0
        for start, length in sorted(spans[i]):
            assert start == at
            at += length
        assert at == len(x)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sum(map(len, ids)) / (window * len(sequences))


def test_pieces_against_the_tokenizer(documents):
    texts = invented(150, words=900) + invented(80, seed=1, words=40) + ["", None, "a", "<|endoftext|> <|endoftext|>x", "é👍 \u0085\x00\n\n  x  ", "z" * 30_000, " " * 3000, "don't 12345 I'LL\t\t\n ab"]
    rows = packing.pack_documents(documents(texts, clash=True).repartition(4)).collect()
    assert check(rows, ids_of(texts), 2048) > 0.95
    assert sorted(map(tuple, packing.pack_documents(documents(texts).repartition(3)).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in rows)


@pytest.mark.parametrize("window", [16, 64, 500])
def test_other_windows(documents, window):
    texts = invented(120, words=120)
    assert check(packing.pack_documents(documents(texts), window).collect(), ids_of(texts), window) > 0.9


def test_rows_of_one_text(documents):
    texts = ["one and the same text"] * 300
    assert check(packing.pack_documents(documents(texts)).collect(), ids_of(texts), 2048) > 0.7


def test_plan_uses_each_piece_once_and_fills_windows():
    draw = np.random.default_rng(2)
    counts = Counter(int(min(2048, x)) + 1 for x in draw.lognormal(6, 1, 40_000) if x < 2047)
    plan = packing.plan_packing(counts, 2048)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 2048 and times > 0
        for k in lengths:
            used[k] += times
    assert used == counts
    pads = 2048 * sum(t for _, t in plan) / sum(k * n for k, n in counts.items())
    assert pads < 1.005 and len(plan) < 20_000
    assert packing.plan_packing({}, 2048) == []


def test_least_squares_finds_the_exact_counts():
    columns = packing.combinations([2, 3, 5, 8], 10)
    assert (2, 8) in columns and (5, 5) in columns and (2, 3, 5) in columns
    truth = np.arange(1.0, len(columns) + 1)
    counts = Counter()
    for c, x in zip(columns, truth):
        for k in c:
            counts[k] += int(x)
    x = packing.solve(columns, counts, sweeps=4000)
    used = Counter()
    for c, v in zip(columns, x):
        for k in c:
            used[k] += v
    assert all(x >= 0) and all(abs(used[k] - counts[k]) < 0.05 for k in counts)


def test_odd_rows(odd_documents):
    rows = packing.pack_documents(odd_documents).collect()
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack_documents(odd_documents.limit(0)).count() == 0


def test_added_tokens_as_the_tokenizer_loads_them(spark, tmp_path):
    import corpus_pipeline
    from fleetlens.llm import queries

    texts = ["<|endoftext|> <|endoftext|>x", "one \n <|endoftext|>\n\n two  <|endoftext|>", "<|endoftext|", None, "a<|endoftext|><|endoftext|>é👍", "word " * 3000 + "<|endoftext|>" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*e.ids, 1] for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert 50256 in ids[0]
    check(queries.op7_packing(spark, str(tmp_path)).collect(), ids, 2048)
    check(corpus_pipeline.pack(spark, df, str(tmp_path)).collect(), ids, 2048)
