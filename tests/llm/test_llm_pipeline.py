"""Each stage on its own input against what its operator's brute force says, and the check SQL of the queries."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from check_queries import compare, connect
from test_llm_jaccard import brute as linked
from test_llm_packing import check, ids_of
from test_llm_pii import naive
from test_llm_quality import counted
from llm_fixtures import odd_documents  # noqa: F401

from fleetlens.llm import mixing
from fleetlens.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "packing",
    ]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    given = docs.collect()
    by_name = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    good = by_name["quality rules"](spark, docs, SF_DIR)
    rows = good.collect()
    assert good.columns == columns
    base = [r for r in given if not counted(r["text"])[5]]
    assert set(rows) <= set(base) and len(rows) >= 0.97 * len(base)

    one = by_name["n-gram Jaccard join"](spark, good, SF_DIR)
    rows = sorted(rows, key=lambda r: r["doc_id"])
    want = {rows[i]["doc_id"] for i, _, c in linked([r["text"] for r in rows]) if i == c}
    kept = one.collect()
    assert one.columns == columns and {r["doc_id"] for r in kept} == want and len(kept) == len(want) < len(rows)

    clean = by_name["PII"](spark, one, SF_DIR)
    rows = clean.collect()
    assert clean.columns == columns and len(rows) == len(kept)
    texts = {r["doc_id"]: r["text"] for r in kept}
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and not naive(r["text"])
        if not naive(texts[r["doc_id"]]) and not any(map(str.isdigit, texts[r["doc_id"]])):
            assert r["text"] == texts[r["doc_id"]]

    mixed = by_name["mixing sources to target weights"](spark, clean, SF_DIR)
    taken = Counter(mixed.collect())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(clean).collect()}
    assert mixed.columns == columns and dict(taken) == {r: copies[r["doc_id"]] for r in rows if copies[r["doc_id"]]}

    held = by_name["packing"](spark, clean, SF_DIR).collect()
    ids = dict(zip([r["doc_id"] for r in rows], ids_of([r["text"] for r in rows])))
    assert {r["doc_id"] for r in held} == set(ids)
    order = {d: i for i, d in enumerate(ids)}
    check([{**r.asDict(), "doc_id": order[r["doc_id"]]} for r in held], list(ids.values()), 2048)


def odd_columns():
    return {
        "_turn": F.lit(1), "_first": F.lit("x"), "first": F.lit(1), "row": F.lit("r"), "column_0": F.lit(0), "a.b": F.lit(2.5), "t`ick": F.lit(3),
        "m": F.create_map(F.lit("k"), F.col("doc_id")), "v": F.parse_json(F.lit('{"a": [1, "x"]}')), "bytes": F.lit(b"\x00\xff"),
        "nothing": F.lit(None).cast("array<map<string,int>>"),
    }


def test_stages_take_columns_of_any_name_and_type(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id % 4 = 0")
    twice = docs.where("doc_id % 8 = 0").withColumn("source", F.lit("again"))
    docs = docs.unionByName(twice).select("*", *[value.alias(name) for name, value in odd_columns().items()])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert {(r["m"]["k"], r["a.b"], r["_turn"]) for r in rows} == {(r["doc_id"], 2.5, 1) for r in rows}
        if name == "n-gram Jaccard join":
            assert len({r["doc_id"] for r in rows}) == len(rows)
            assert sorted(map(str, rows)) == sorted(map(str, stage(spark, docs.repartition(3), SF_DIR).collect()))


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    ends = Counter(r["doc_id"] for r in rows if r["start"] + r["length"] == r["doc_tokens"])
    assert rows and max(ends.values()) <= 3
    assert max(r["offset"] + r["length"] for r in rows) <= 2048


def test_stages_take_odd_rows(spark, odd_documents):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_documents, odd_documents.limit(0)):
            out = stage(spark, docs, SF_DIR)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if name in ("PII", "packing") and docs is odd_documents:
                assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
            if name == "n-gram Jaccard join" and docs is odd_documents:
                assert sorted((r["doc_id"] for r in rows), key=str) == sorted((1, 2, 3, 4, 5, 7, -8, 9, 10, None), key=str)


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_check_sql(spark, db, name):
    problem, _ = compare(spark, db, SF_DIR, name)
    assert not problem, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_each_document(spark, name):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    rows = QUERIES[name](spark, SF_DIR)
    if "vec_id" in rows.columns:
        n = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    assert rows.select(rows.columns[0]).distinct().count() == n
