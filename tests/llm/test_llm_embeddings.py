from __future__ import annotations

import math

import numpy as np
import pytest

from fleetlens.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine):
    fit = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    n = {r[0]: 0 for r in rows}
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(fit):
        for b in fit[:k]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = sorted((root(a[0]), root(b[0])))
                    parent[q] = p
    return sorted((i, n[i], root(i), i == root(i)) for i in n)


@pytest.mark.parametrize("cosine", [0.9, 0.98])
def test_against_brute_force(spark, cosine):
    draw = np.random.default_rng(1)
    rows, centres = [], draw.standard_normal((15, 24))
    for i in range(260):
        v = centres[i % 15] + draw.standard_normal(24) * draw.choice([0.0, 0.05, 0.14, 0.3, 3.0])
        rows.append((i, np.float32(v).tolist(), int(i % 2), "x"))
    rows += [(300 + i, rows[3][1], 1, None) for i in range(30)] + [(400, [float(x) * 2 for x in rows[3][1]], 1, None)]
    got = sorted(map(tuple, embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), cosine).collect()))
    assert got == brute(rows, cosine)


def test_odd_rows(spark):
    rows = [
        (1, None, 1, ""), (2, [0.0, 0.0], 1, ""), (3, [1.0, None], 1, ""), (4, [float("nan"), 1.0], 1, ""), (5, [float("inf"), 1.0], 1, ""),
        (6, [1.0, 1.0], None, ""), (7, [1.0, 1.0], 1, ""), (8, [3.0, 3.0], 1, ""), (9, [1.0, 1.0, 0.0], 1, ""), (10, [], 1, ""), (11, [1e38, 1e38], 1, ""),
        (12, [1e-38, 1e-38], 1, ""), (13, [1.0, 1.0], 2, ""),
    ]
    got = sorted(map(tuple, embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows, 0.98)
    alone = embeddings.near_vectors(spark.createDataFrame([(None, [1.0, 1.0], 1, ""), (1, [1.0, 1.0], 1, "")], SCHEMA)).collect()
    assert sorted(map(tuple, alone), key=str) == [(1, 0, 1, True), (None, 0, None, False)]
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_hold_the_miss_bound():
    for largest in (1, 1000, 10**6, 10**9):
        bits, tables = embeddings.tables_for(largest, 0.98, 1e-6)
        alike = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - alike) ** tables <= 1e-6 and 8 <= bits <= 30
