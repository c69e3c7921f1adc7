from __future__ import annotations

import random
from itertools import product

import pytest
from llm_fixtures import CLASHING, documents, invented, odd_documents  # noqa: F401
from pyspark.sql import functions as F

from fleetlens.llm import mixing


def test_targets_by_hand():
    assert mixing.share_targets([100, 100, 100], [1, 1, 1]) == [100, 100, 100]
    # The second would get 200 of 300 by weight, but stops at 3 times its size.
    assert mixing.share_targets([250, 50, 0], [1, 2, 3]) == [150, 150, 0]
    assert mixing.share_targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.share_targets([], []) == []
    shares = mixing.share_targets([10, 1000, 5, 70], [5, 1, 9, 3])
    assert abs(sum(shares) - 1085) < 1e-6 and shares[0] == 30 and shares[2] == 15


def cost(flow, capacity):
    return sum(c * x for f in flow for c, x in zip(mixing.COPY_COSTS, f))


def test_flow_is_cheapest_of_all(spark):
    draw = random.Random(1)
    for _ in range(40):
        capacity = [draw.randint(1, 4) for _ in range(3)]
        members = [draw.sample(range(2), draw.randint(1, 2)) for _ in range(3)]
        quotas = [draw.randint(0, 8) for _ in range(2)]
        flow = mixing.route(capacity, members, quotas)
        assert all(0 <= x <= c for f, c in zip(flow, capacity) for x in f)
        sent = sum(map(sum, flow))
        best = {}
        for amounts in product(*(range(3 * c + 1) for c in capacity)):
            # Each pattern splits its amount among its sources within the quotas.
            room = [0, 0, 0]  # only 0, only 1, either
            for a, m in zip(amounts, members):
                room[2 if len(m) == 2 else m[0]] += a
            if room[0] <= quotas[0] and room[1] <= quotas[1] and sum(room) <= sum(quotas):
                own = sum(sum(k * x for k, x in zip(mixing.COPY_COSTS, (min(a, c), min(max(a - c, 0), c), max(a - 2 * c, 0)))) for a, c in zip(amounts, capacity))
                best[sum(amounts)] = min(best.get(sum(amounts), 10**9), own)
        assert sent == max(best) and cost(flow, capacity) == best[sent]


def test_mix_comes_near_its_targets(documents):
    texts = [t for k in (40, 120, 20) for t in invented(80, seed=k, words=k)]
    df = documents(texts).withColumn("source", F.when(F.col("doc_id") < 200, "big").when(F.col("doc_id") < 204, "ä").when(F.col("doc_id") < 220, F.lit(None)).otherwise("Z"))
    rows = mixing.mix_sources(df).collect()
    names = {r["doc_id"]: r["source"] for r in df.collect()}
    sizes = {r["doc_id"]: len(texts[r["doc_id"]].split()) for r in rows}
    order = ["Z", "big", "ä", None]
    own = [sum(sizes[i] for i in sizes if names[i] == s) for s in order]
    targets = mixing.share_targets(own, [1, 2, 3, 1])
    taken = dict.fromkeys(order, 0)
    for r in rows:
        k = order.index(names[r["doc_id"]])
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == own[k] and r["target"] == pytest.approx(targets[k])
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[names[r["doc_id"]]] += r["taken"]
    for s, target in zip(order, targets):
        assert abs(taken[s] - target) <= 0.02 * target + 20
    again = sorted(map(tuple, mixing.mix_sources(df.repartition(6)).collect()))
    assert again == sorted(map(tuple, rows))
    held = mixing.mixed_documents(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in held} == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_overlapping_sources(documents):
    df = documents(invented(120, words=50)).withColumn(
        "sources", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit(None)))
    )
    rows = mixing.mix_sources(df, "sources", many=True).collect()
    assert len(rows) == 120 and all(0 <= r["copies"] <= 3 for r in rows)
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.05)


def test_flows_of_single_sources_fill_copies_one_after_the_other():
    draw = random.Random(2)
    capacity = [draw.randint(0, 50) for _ in range(60)]
    quotas = [draw.randint(0, 3 * c) for c in capacity]
    flow = mixing.route(capacity, [[i] for i in range(60)], quotas)
    assert flow == [[min(max(q - k * c, 0), c) for k in range(3)] for c, q in zip(capacity, quotas)]


def test_groups_of_linked_sources_are_routed_as_well_as_all_at_once(spark):
    """Two chains of overlapping sources, a pair with a null name, and single sources beside them."""
    draw = random.Random(4)
    chains = [["a"], ["a", "b"], ["b", "c"], ["c"], ["x", "y"], ["y"], ["z", None], ["single"], ["other"], ["empty"]]
    sizes = [0 if c == ["empty"] else draw.randint(50, 400) for c in chains]
    names = sorted({n for c in chains for n in c if n}) + [None]
    quotas = [draw.randint(0, 500) for _ in names]
    key = {n: spark.createDataFrame([(n,)], "n string").select(F.to_json(F.array("n"))).first()[0] for n in names}
    patterns = spark.createDataFrame([(str(i), c, z) for i, (c, z) in enumerate(zip(chains, sizes))], "pattern string, names array<string>, size long")
    sources = spark.createDataFrame([(key[n], n, float(q)) for n, q in zip(names, quotas)], "own string, name string, target double")
    got = {int(r["pattern"]): r["flow"] for r in mixing._flows(patterns, sources).collect()}
    flow = [got[i] for i in range(len(chains))]
    whole = mixing.route(sizes, [[names.index(n) for n in c] for c in chains], quotas)
    assert all(0 <= x <= c for f, c in zip(flow, sizes) for x in f)
    assert sum(map(sum, flow)) == sum(map(sum, whole)) and cost(flow, sizes) == cost(whole, sizes)


def test_every_row_goes_through_the_flow(documents, monkeypatch):
    """The mix of single sources is the flow's: with flows of nothing, nothing is taken."""
    df = documents(invented(30, words=20))
    assert sum(r["copies"] for r in mixing.mix_sources(df).collect()) > 0
    real = mixing._flows
    monkeypatch.setattr(mixing, "_flows", lambda *given: real(*given).withColumn("flow", F.transform("flow", lambda _: F.lit(0).cast("long"))))
    assert sum(r["copies"] for r in mixing.mix_sources(df).collect()) == 0


def test_odd_rows(odd_documents):
    rows = mixing.mix_sources(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r["taken"] == 0 for r in rows if not r["size"])
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns and set(CLASHING) <= set(mixed.columns)
    assert mixed.agg(F.count("*")).first()[0] == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(odd_documents.limit(0)).count() == 0


def test_any_number_of_sources(spark):
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.format_string("s%05d", "id").alias("source"))
    rows = mixing.mix_sources(df).collect()
    sizes = [i % 7 + 1 for i in range(n)]
    targets = mixing.share_targets(sizes, [i % 3 + 1 for i in range(n)])
    assert len(rows) == n and all(r["size"] == r["source_size"] == sizes[r["doc_id"]] and r["target"] == pytest.approx(targets[r["doc_id"]]) for r in rows)


def test_many_overlapping_sources_are_routed_in_time():
    draw = random.Random(3)
    members = [sorted(draw.sample(range(300), draw.randint(1, 3))) for _ in range(6000)]
    capacity = [draw.randint(1, 1000) for _ in members]
    quotas = [sum(capacity) // 300] * 300
    flow = mixing.route(capacity, members, quotas)
    assert all(0 <= x <= c for f, c in zip(flow, capacity) for x in f) and sum(map(sum, flow)) == sum(quotas)


def test_a_long_text_at_the_cut_leaves_room_for_many_short_ones(spark):
    for seed in range(2):
        rows = [(i, "w " * (9000 if i % 360 == 0 else 10 + i % 50), "b") for i in range(1800)] + [(5000 + i, "v " * 40, "a") for i in range(500)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.mix_sources(df, seed=seed, weights=(2, 3)).collect()
        for source, ids in (("a", range(5000, 5500)), ("b", range(1800))):
            own = [r for r in got if r["doc_id"] in ids]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40


def test_rows_without_an_own_id_are_taken_singly(spark):
    rows = [(None if i % 2 else 7, f"{'w ' * 9} {i}", "a") for i in range(400)] + [(i, "v v v v v v v v v v", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, weights=(1, 3)).collect()
    own = [r for r in got if r["target"] == 2000]
    assert len(own) == 400 and abs(sum(r["taken"] for r in own) - 2000) <= 10
    assert mixing.mixed_documents(df, weights=(1, 3)).where("source = 'a'").count() == 200


def test_equal_rows_never_overfill(spark):
    rows = [(None, "w " * 10, "a")] * 300 + [(i, "x " * 10, "a") for i in range(100)] + [(i, "v " * 10, "b") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, weights=(1, 11)).collect()
    assert sum(r["taken"] for r in got if r["source_size"] == 4000) <= next(r["target"] for r in got if r["source_size"] == 4000)
