from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, index string, x array<string>, n boolean"


def table(spark, rows):
    """Vectors under columns that clash with the operator's own names."""
    return spark.createDataFrame([(i, v, 0, "a", ["b"], True) for i, v in rows], SCHEMA)


def brute(rows, components=32):
    """{row number: (deviation, whitened up to sign)}, explained, of vectors of one length."""
    fit = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fit], object)
    n, total = len(fit), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, total)] for row in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [i for i, _ in fit], deviation, centred @ vectors / np.sqrt(values), values / np.trace(covariance)


def check(spark, rows, got, components=32):
    ids, deviation, whitened, explained = brute(rows, components)
    got = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    k = len(explained)
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c + 1) for i in ids for c in range(k)]
    assert [r["deviation"] for r in got] == [int(d) for d in deviation for _ in range(k)]
    assert {r["n"] for r in got} == {len(ids)} and len({r["identity_error"] for r in got}) == 1
    own = np.array([r["whitened"] for r in got]).reshape(len(ids), k)
    signs = np.sign((own * whitened).sum(axis=0))
    assert np.allclose(own, whitened * signs, rtol=1e-6, atol=1e-6)
    assert np.allclose([r["explained"] for r in got[:k]], explained, rtol=1e-9)
    error = np.abs(np.cov(own.T, bias=True) - np.eye(k)).max()
    assert got[0]["identity_error"] == pytest.approx(error, abs=1e-9) and error < 1e-6


@pytest.mark.parametrize(("n", "size", "files"), [(3000, 40, 7), (1300, 260, 3), (90, 5, 4)])
def test_against_brute_force(spark, n, size, files):
    draw = np.random.default_rng(size)
    spread = draw.standard_normal((n, size)) * np.linspace(0.5, 3, size) + draw.standard_normal(size) * 20
    rows = [(i, np.float32(v @ np.eye(size)).tolist()) for i, v in enumerate(spread)]
    got = whitening.digest(whitening.whiten(table(spark, rows).repartition(files))).collect()
    check(spark, rows, got, min(32, size))


def test_odd_vectors_are_left_out_and_repeated_rows_count(spark):
    draw = np.random.default_rng(0)
    fine = [(i, np.float32(draw.standard_normal(4)).tolist()) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [3e38, 0.0, 0.0, 0.0]), (105, [])]
    got = whitening.digest(whitening.whiten(table(spark, fine + odd))).collect()
    check(spark, fine, got, 4)
    again = whitening.digest(whitening.whiten(table(spark, [*fine, *fine, (None, fine[0][1])]))).collect()
    assert len(again) == 4 * 121 and {r["n"] for r in again} == {121}
    first = [r for r in again if r["vec_id"] in (None, fine[0][0]) and r["component"] == 1]
    assert len(first) == 3 and len({(r["deviation"], r["whitened"]) for r in first}) == 1


def test_vectors_that_do_not_differ_and_empty_tables(spark):
    assert whitening.digest(whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(9)]))).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    line = [(i, [float(i), 5.0, 2.0 * i]) for i in range(10)]  # one direction only
    got = whitening.digest(whitening.whiten(table(spark, line))).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10 and got[0]["explained"] == pytest.approx(1)


def test_lengths_are_whitened_apart(spark):
    draw = np.random.default_rng(3)
    rows = [(i, np.float32(draw.standard_normal(3 + i % 2)).tolist()) for i in range(100)]
    got = whitening.digest(whitening.whiten(table(spark, rows))).collect()
    for odd in (0, 1):
        check(spark, [r for r in rows if r[0] % 2 == odd], [r for r in got if r["vec_id"] % 2 == odd], 3 + odd)


def test_deviation_is_exact_or_null(spark):
    big = [(0, [2.0**40, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])]
    wide = spark.createDataFrame([(i, v) for i, v in big], "vec_id long, embedding array<double>")
    n, x = 3, [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in big]
    total = [sum(c) for c in zip(*x)]
    want = [sum((n * c - s) ** 2 for c, s in zip(row, total)) for row in x]
    rows = whitening.whiten(wide).select("vec_id", "deviation").orderBy("vec_id").collect()
    assert [r["deviation"] for r in rows] == [w if w < 2**63 else None for w in want]


def test_rows_do_not_pass_through_python(spark):
    """Rows become blocks, products and rows again in the JVM."""
    found = whitening.whiten(table(spark, [(i, [float(i), float(i * i)]) for i in range(20)])).where(F.col("vec_id") > 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
