from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from llm_fixtures import documents, invented, odd_documents  # noqa: F401
from pyspark.sql import functions as F

from fleetlens.llm import language


def grams(text):
    """Codes by hand: words of letters in lower case, a blank after each, blanks before the first."""
    out, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            out.append(word)
            word = ""
    line = "".join(w + " " for w in out)
    return [("   " + line)[i : i + 4] for i in range(len(line))]


def decoded(code):
    return "".join(chr(int(code >> np.uint64(16 * k)) & 0xFFFF) for k in (3, 2, 1, 0)).replace("\x01", " ")


def test_grams_by_hand():
    texts = ["Ab c, d1é", "", None, "12 3", "x", " Ünï-X ", "end"]
    code, own, letters = language.grams_of(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [decoded(c) for c in code[own == i]] == grams(t or ""), t
        assert letters[i] == sum(map(str.isalpha, t or ""))


def test_probabilities_of_a_seen_context_sum_to_one():
    code, _, _ = language.grams_of(pa.array(invented(30), pa.string()))
    keys, n = np.unique(code, return_counts=True)
    model = language.train([("x", keys, n)])
    alphabet = np.unique(code & np.uint64(0xFFFF))
    # One more symbol stands for all that was never seen: it gets the floor of the lowest order.
    for context in (code >> np.uint64(16))[[5, 50, 500]]:
        all_ = np.append((context << np.uint64(16)) | alphabet, (context << np.uint64(16)) | np.uint64(0x4E00))
        assert abs(np.exp(model.log_probability(all_).astype(float)).sum() - 1) < 1e-3
    assert np.isfinite(model.log_probability(np.array([0x4E014E024E034E04], np.uint64))).all()


def test_kneser_ney_by_hand():
    """Two bigram types after one context, counted in the lowest orders by what they follow."""
    code, _, _ = language.grams_of(pa.array(["ab ab ac"], pa.string()))
    keys, n = np.unique(code, return_counts=True)
    model = language.train([("x", keys, n)])
    # Unigrams: a follows " ", b and c follow a, " " follows b and c: 5 bigram types.
    at = {decoded(k)[-1]: p for k, p in zip(model.grams[1], np.exp(model.logs[1][:, 0].astype(float)))}
    d, total, types, floor = 0.6, 5, 4, 1 / 5  # three symbols follow one other, one follows two: d = 3 / (3 + 2)
    assert abs(at["a"] - ((1 - d) / total + d * types / total * floor)) < 1e-6
    assert abs(at[" "] - ((2 - d) / total + d * types / total * floor)) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify_languages(docs).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["true"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) / len(rows) < 0.02


def test_held_out_rows_teach_nothing(documents):
    texts = invented(60, words=30)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(60)]
    df = documents(texts)
    other = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = (sorted(map(tuple, language.identify_languages(x).collect())) for x in (df, other))
    assert a == b and [r[1] for r in a] == held


def test_odd_rows(odd_documents):
    rows = language.identify_languages(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    found = {r["doc_id"]: r for r in rows}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3))
    assert found[5]["lang_pred"] in ("a", "b") and found[None]["held_out"] is False
    none = language.identify_languages(odd_documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and all(r["rejected"] for r in none)
    assert language.identify_languages(odd_documents.limit(0)).count() == 0


def test_limits_come_from_documents_that_were_not_counted(documents):
    """Of held-out documents about as many are rejected as the quantile says, not many times more."""
    texts = invented(1500, words=40, vocabulary=3000)
    rows = language.identify_languages(documents(texts).withColumn("lang", F.lit("made")), quantile=0.95).collect()
    held = [r for r in rows if r["held_out"]]
    assert 0.01 <= sum(r["rejected"] for r in held) / len(held) <= 0.12


def test_a_language_with_one_document_is_learned(documents):
    texts = invented(40, words=30)
    for i in range(40):
        df = documents(texts).withColumn("lang", F.when(F.col("doc_id") == i, "rare").otherwise("made")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
        if i % 10 == 0 and df.where("lang = 'rare'").count():
            own = [r for r in language.identify_languages(df).collect() if r["doc_id"] == i]
            assert own[0]["lang_pred"] == "rare" and not own[0]["rejected"]


def test_rejection_of_strange_text(documents):
    texts = invented(300, words=60) + ["qqq xzx wvq zzxw qwx " * 6]
    rows = {r["doc_id"]: r for r in language.identify_languages(documents(texts).withColumn("lang", F.when(F.col("doc_id") < 300, F.lit("made")))).collect()}
    assert rows[300]["rejected"] and sum(r["rejected"] for i, r in rows.items() if i < 300) <= 3
