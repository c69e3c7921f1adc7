"""Joins and steps that keep their shape whatever the size estimates say."""

from __future__ import annotations

import json
import re

from conftest import tuples
from pyspark.sql import functions as F

from fleetlens.functions.skew import row_join, settled_lookup
from fleetlens.operators import extract, graph, runs, secrets
from fleetlens.plans import drift_run, estate
from fleetlens.sources import policy


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_never_sent_to_all_tasks(spark):
    left, right = spark.range(20).withColumn("k", F.col("id") % 3), spark.createDataFrame([(1, "a"), (1, "b"), (5, "c")], "k long, v string")
    joined = row_join(left, right, ["k"])
    assert "BroadcastHashJoin" not in _plan(joined) and "SortMergeJoin" in _plan(joined)
    assert tuples(joined.groupBy("k").count()) == [(0, 7), (1, 14), (2, 6)]


def test_a_lookup_is_sent_by_its_counted_rows(spark):
    facts, lookup = spark.range(9).withColumn("k", F.col("id") % 3), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, v string")
    for few, sent in ((3, True), (2, False)):
        joined = facts.join(settled_lookup(lookup, few=few).select("k", "v"), "k")
        assert ("BroadcastHashJoin" in _plan(joined)) is sent
        assert tuples(joined.groupBy("v").count()) == [("a", 3), ("b", 3), ("c", 3)]


def test_only_configurations_of_the_rows_are_kept(spark, config):
    confs = config({"repo": "a"}, {"repo": "b"}, {"repo": "b"}, {"repo": "c"})
    rows = spark.createDataFrame([("b",), ("b",), ("c",), (None,)], "repo string")
    assert tuples(policy.config_of(confs, rows), "repo") == [("b",), ("b",), ("c",)]


def _definitions(spark):
    side = lambda k, s, name: ("r", k, s, "prod", f"p/{k}_L.json", f"{k}_L", "json", json.dumps({"name": name, "t": {"u": 1}}))
    rows = [side("j-1", "repo", "x"), side("j-1", "live", "y"), side("j-2", "repo", "x"), side("j-2", "live", "x"), side("j-3", "live", "x")]
    return spark.createDataFrame(rows, "repo string, job_key string, side string, env string, path string, stem string, ext string, raw string")


def test_drift_sends_no_rows_of_definitions_to_the_driver(spark, config):
    conf = config({"platform": {"kind": "databricks", "job_def_dirs": {"prod": "p"}}}, *({"repo": f"other{i}"} for i in range(5)))
    found = drift_run.definition_drift(_definitions(spark), conf)
    assert "BroadcastHashJoin" not in _plan(found)
    assert tuples(found, "job_key", "path", "kind", "repo_val", "live_val") == [("j-1", "name", "changed", '"x"', '"y"')]
    summary = drift_run.drift_summary(_definitions(spark), conf, policy.platform_dim(spark))
    assert [(r["job_key"], r["drift"], r["changed"]) for r in summary.orderBy("job_key").collect()] == [("j-1", True, ["name"]), ("j-2", False, [])]


def test_files_of_a_folder_meet_once_and_unsorted(spark, files, config):
    src = files({"b.py": "q = 'select * from Raw.Xy'\n# STATUS: LATE", "a.py": "# STATUS: EARLY\nq = 'from RAW.xy join OLD.yz'", "z.sql": "insert into raw.XY select 1", "c.py": "x"})
    plan = _plan(extract.object_lists(src))
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1
    deny = policy.load_policy(config({"architecture": {"deprecated_schema_deny": ["OLD"]}}))["deny"]
    facts = extract.job_facts(src, deny).collect()
    assert [(r["status"], r["last_updated"] or None, r["objects"], r["flags"]) for r in facts] == [("EARLY", None, ["OLD.yz", "raw.XY"], ["OLD"])]
    assert extract.job_facts(files({"c.py": "x"}), deny).count() == 0


def test_pieces_of_lines_are_not_dealt_out_for_few_terms(spark):
    texts = spark.createDataFrame([("r", "a.py", "one denied word\nnone"), ("q", "b.py", "denied too")], "repo string, path string, text string")
    # The terms come from a table that looks large: only their counted number says that they are few.
    terms = spark.createDataFrame([("r", "denied"), (None, "none")] * 3, "repo string, term string").hint("merge").join(texts.select("repo").distinct(), "repo", "left").distinct()
    found = secrets.denylist_table_scan(texts, terms)
    assert "SortMergeJoin" not in _plan(found)
    assert tuples(found) == [("r", "a.py", 1, 1), ("r", "a.py", 2, 1)]


def test_large_given_tables_are_not_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id as l_orderkey", "id % 7 as l_partkey").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for most, dealt in ((10**6, True), (1, False)):
        monkeypatch.setattr(estate, "SPREAD_BYTES", most)
        rows = estate.Estate(spark, str(tmp_path)).given("lineitem")
        assert ("Exchange" in _plan(rows)) is dealt
        assert rows.count() == 100
    # Splits are bounded, so that what a task deals out fits its memory.
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_pairs_of_related_jobs_are_not_dealt_out_again(spark):
    edges = spark.createDataFrame([("r", f"J-{t}", o) for t in range(6) for o in "abc"], "repo string, ticket string, object_key string")
    found = graph.related_jobs(edges, spark.createDataFrame([("r", "J-1")], "repo string, ticket string"), least=2)
    plan = _plan(found)
    assert not re.search(r"Exchange hashpartitioning\(repo#\d+, job#\d+, related#\d+", plan)
    # Partitions that make many pairs of few rows are not merged.
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert tuples(found) == [("r", "J-1", f"J-{t}", 3, "a") for t in (0, 2, 3, 4, 5)]


def test_objects_on_a_share_of_the_jobs_are_bits(spark):
    """Objects on 100 of 150 jobs, fewer than the root of the edges: listed object by object, they would be joined for each pair."""
    edges = spark.range(150 * 100).selectExpr("'r' as repo", "concat('J-', id % 150) as ticket", "concat('o', (id % 150 + id div 150) % 150) as object_key")
    assert graph._crowded(edges, 64).count() == 150


def test_pairs_of_failed_runs_are_not_joined_again(spark):
    edges = spark.createDataFrame([("r", f"J-{t}", o) for t in range(4) for o in "abc"] + [("r", "J-8", "z"), ("r", "J-9", "z"), ("r", "J-9", "a")], "repo string, ticket string, object_key string")
    rows = [("r", "J-1", "R-1", "FAILED"), ("r", "J-1", "R-2", "FAILED"), ("r", "J-1", "R-2", "FAILED"), ("r", "J-8", "R-3", "FAILED"), ("r", "J-2", "R-4", "SUCCESS"), ("r", None, "R-5", "FAILED")]
    run = spark.createDataFrame(rows, "repo string, job_key string, run_id string, result_state string")
    found = runs.failure_related(run, edges)
    # Words of bits are columns, and no function over arrays is called for pairs; a run is added to its job before it meets others.
    plan = _plan(found)
    assert "zip_with" not in plan and "mine_0" in plan
    assert not re.search(r"Join \[[^\]]*job_key", plan)
    near = [("J-0", 3, "a", False), ("J-2", 3, "a", False), ("J-3", 3, "a", False), ("J-9", 1, "a", False)]
    want = [("r", i, "J-1", *n) for i in ("R-1", "R-2", "R-2") for n in near] + [("r", "R-3", "J-8", "J-9", 1, "z", False)]
    assert tuples(found) == sorted(want)
    crowded = graph.related_to(edges, run.where("result_state = 'FAILED'").select("repo", run.job_key.alias("job"), "run_id"), least=2)
    assert tuples(crowded.select("repo", "run_id", "job", "related", "n_shared", "first_shared")) == sorted(w[:-1] for w in want)


def test_number_of_a_job_is_read_once_a_job(spark):
    edges = spark.createDataFrame([("r", f"J-{t}", o) for t in (0, 7, 100) for o in "abc"], "repo string, ticket string, object_key string")
    found = graph.looked_up_jobs(edges)
    assert "Exchange" not in _plan(found)
    assert tuples(found) == [("r", "J-0"), ("r", "J-100")]


def test_pairs_on_an_object_are_dealt_into_slices(spark):
    rows = [("r", f"J-{t}", "hub") for t in range(30)] + [("r", "J-1", "a"), ("r", "J-2", "a"), ("r", "J-2", "a"), ("q", "J-2", "a"), ("r", None, "a"), ("r", "J-1", None), (None, "J-3", "a")]
    edges = spark.createDataFrame(rows, "repo string, ticket string, object_key string")
    found = graph.shared_objects(edges, spark.createDataFrame([("r", "J-1"), ("r", "J-1"), ("r", "J-5")], "repo string, ticket string"))
    assert _plan(found).count("REPARTITION_BY_NUM") == 2
    want = [("r", j, f"J-{t}", "hub") for j in ("J-1", "J-5") for t in range(30) if j != f"J-{t}"] + [("r", "J-1", "J-2", "a")] * 2
    assert tuples(found) == sorted(want)
