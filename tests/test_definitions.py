from __future__ import annotations

import json

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from fleetlens.functions import pyhelpers, text
from fleetlens.operators import definitions, drift
from fleetlens.plans import drift_run
from fleetlens.sources.policy import platform_dim
from fleetlens.sources.schemas import JOB_DEF


@pytest.fixture
def defs(spark):
    def make(*rows):
        """(side, env, file name, raw or dict)"""
        out = []
        for side, env, name, raw in rows:
            stem, ext = name.rsplit(".", 1)
            text = raw if isinstance(raw, str) else json.dumps(raw)
            out.append(("r", stem.split("_")[0].lower(), side, env, f"defs/{env}/{name}", stem, ext, text))
        return spark.createDataFrame(out, JOB_DEF)

    return make


def conf(config, **dirs):
    return config({"platform": {"kind": "databricks", "deploy_model": "api-reset", "job_def_dirs": dirs}})


def test_schedule_reads_prod_first_and_skips_broken_files(defs, config):
    rows = defs(
        ("repo", "dev", "JOB-1_A.json", {"name": "dev"}), ("repo", "prod", "JOB-1_A.json", "{broken"),
        ("repo", "prod", "JOB-1_B.json", {"settings": {"name": "p", "schedule": {"quartz_cron_expression": "0 1", "timezone_id": "UTC", "pause_status": "PAUSED"}}}),
        ("repo", "prod", "JOB-1_C.json", {"name": "later"}), ("live", "prod", "JOB-1.json", {"name": "live"}),
    )
    described = definitions.describe(rows)
    assert tuples(definitions.definition_schedule(described, conf(config, dev="defs/dev", prod="defs/prod"))) == [("r", "job-1", "p", "0 1", "UTC", "PAUSED")]
    assert tuples(definitions.definition_schedule(described, conf(config, dev="defs/dev")), "name") == [("dev",)]


def test_lookup_by_stem_key_or_name(spark, defs, config):
    rows = definitions.describe(defs(
        ("repo", "dev", "JOB-1_A.json", {"name": "nightly"}), ("repo", "prod", "job-1.json", {"name": "main"}),
        ("repo", "qa", "x.json", {"name": "Nightly"}), ("repo", "qa", "JOB-10_Z.json", {}),
    ))
    refs = spark.createDataFrame([("r", x) for x in ("JOB-1_Anything", "NIGHTLY", "job-10", "nope")], "repo string, ref string")
    found = definitions.repo_definition_lookup(refs, rows, conf(config, qa="defs/qa", dev="defs/dev", prod="defs/prod"))
    assert tuples(found.fillna("-"), "ref", "path", "name") == [
        ("JOB-1_Anything", "defs/prod/job-1.json", "main"), ("NIGHTLY", "defs/qa/x.json", "Nightly"),
        ("job-10", "defs/qa/JOB-10_Z.json", "-"), ("nope", "-", "-"),
    ]


def test_lint(defs, config):
    rows = definitions.describe(defs(
        ("repo", "prod", "a.json", '{"a": 1}\nx'), ("repo", "prod", "b.json", "[1]"), ("repo", "prod", "c.json", {"settings": {}}),
        ("repo", "prod", "d.json", {"settings": {"name": "n"}}), ("repo", "lab", "e.json", {}), ("repo", "prod", "f.sql", "drop"),
    ))
    assert tuples(definitions.definition_lint(rows, conf(config, prod="./defs/prod/".replace("./", ""))), "problem") == [
        ("defs/prod/a.json:2: invalid JSON: Extra data",),
        ("defs/prod/b.json: job definition must be a JSON object",),
        ('defs/prod/c.json: missing job name (expected top-level "name" or "settings.name")',),
    ]


def test_missing_definitions_by_model(spark, defs, config):
    folders = spark.createDataFrame([("r", f"{k}_A", k) for k in ("JOB-1", "JOB-2")], "repo string, job_dir string, ticket string")
    rows = definitions.describe(defs(("repo", "prod", "JOB-1_x.json", "{"), ("repo", "prod", "JOB-2_x.sql", "create")))
    for model, missing in (("api-reset", ["JOB-2"]), ("sql-ddl", ["JOB-1"]), ("git-sync", [])):
        c = config({"platform": {"kind": "databricks", "deploy_model": model, "job_def_dirs": {"prod": "defs/prod"}}})
        assert [t for t, in tuples(definitions.missing_definitions(folders, rows, c), "ticket")] == missing


def test_leaves_keep_run_as_and_ignore_list_order():
    a = {"settings": {"name": "x", "run_as": {"user": "a"}, "tasks": [{"task_key": "b"}, {"task_key": "a"}]}, "job_id": 3}
    b = {"name": "x", "run_as": {"user": "a"}, "tasks": [{"task_key": "a"}, {"task_key": "b"}], "created_time": 1}
    leaves = lambda d: dict(pyhelpers.definition_leaves(json.dumps(d)))
    assert leaves(a) == leaves(b) and "run_as.user" in leaves(b)
    assert leaves({"a": {"b": {}, "c": [1, {"z": 1, "y": 2}]}, "settings": 5}) == {"a.c": '[1, {"y": 2, "z": 1}]'}
    assert pyhelpers.definition_leaves('{"a.b": 1, "a": {"b": 2}}') == [("a.b", "2")]
    assert pyhelpers.definition_leaves("{") == [] and pyhelpers.definition_leaves('{"a": 1, "a": 1.0}') == [("a", "1.0")]


def test_drift_kinds_and_summary(spark, defs, config):
    rows = defs(
        ("repo", "prod", "JOB-1.json", {"name": "n", "a": 1, "b": 1, "c": None}),
        ("live", "prod", "JOB-1.json", {"job_id": 1, "settings": {"name": "n", "b": 1.0, "c": None, "d": {"e": "x"}}}),
        ("repo", "prod", "JOB-2.json", {"name": "n"}), ("live", "prod", "JOB-2.json", {"settings": {"name": "n"}}),
        ("repo", "prod", "JOB-3.json", {"name": "only here"}),
    )
    assert tuples(drift_run.definition_drift(rows, conf(config, prod="defs/prod")), "job_key", "path", "kind", "repo_val", "live_val") == [
        ("job-1", "a", "removed", "1", "<absent>"), ("job-1", "b", "changed", "1", "1.0"), ("job-1", "d.e", "added", "<absent>", '"x"'),
    ]
    summary = lambda kind, model: tuples(
        drift_run.drift_summary(rows, config({"platform": {"kind": kind, "deploy_model": model, "job_def_dirs": {"prod": "defs/prod"}}}), platform_dim(spark)),
        "job_key", "drift", F.array_join("added", ","), F.array_join("removed", ","), F.array_join("changed", ","),
    )
    # The platform's own model counts: a wrong configured one does not switch drift detection off.
    assert summary("databricks", "git-sync") == [("job-1", True, "d.e", "a", "b"), ("job-2", False, "", "", "")]
    assert summary("airflow", "api-reset") == []


def test_ddl_normalization(spark):
    norm = lambda s: spark.range(1).select(drift.normalized_ddl(F.lit(s)).alias("d")).collect()[0].d
    assert norm("CREATE OR REPLACE TASK T\n  -- a comment\n  AS SELECT 1;") == norm("create or replace task t as select 1")
    assert norm("AS SELECT 'ProdValue'") != norm("AS SELECT 'prodvalue'")
    assert norm("A 'it''s  X' /* y\n */ B ; ") == "a 'it''s X' b"
    assert norm("A 'open  B") == "a 'open b"


def test_live_names(spark, defs, config):
    rows = definitions.describe(defs(("repo", "prod", "JOB-1_A.json", {"name": "main"}), ("repo", "prod", "JOB-2.json", {"name": "twice"})))
    refs = spark.createDataFrame([("r", x) for x in ("JOB-1", "JOB-2", "77", "gone")], "repo string, ref string")
    live = spark.createDataFrame([("r", "1", "main"), ("r", "2", "twice"), ("r", "3", "twice")], "repo string, job_id string, name string")
    found = definitions.repo_definition_lookup(refs, rows, conf(config, prod="defs/prod"))
    assert tuples(drift.live_name_resolution(refs, found, live).fillna("-"), "ref", "job_id", "n_matches", "status") == [
        ("77", "77", 1, "resolved"), ("JOB-1", "1", 1, "resolved"), ("JOB-2", "-", 2, "ambiguous"), ("gone", "-", 0, "missing"),
    ]


def test_drift_compares_the_definition_a_lookup_finds(defs, config):
    rows = defs(
        ("repo", "dev", "JOB-1_A.json", {"name": "dev"}), ("repo", "prod", "JOB-1_A.json", {"name": "n"}), ("repo", "prod", "JOB-1_B.json", {"x": 1}),
        ("live", "prod", "JOB-1.json", {"name": "n"}), ("repo", "dev", "JOB-2.json", {"name": "a"}), ("live", "prod", "JOB-2.json", {"name": "b"}),
        ("repo", "lab", "JOB-3.json", {"name": "a"}), ("live", "prod", "JOB-3.json", {"name": "b"}),
    )
    got = drift_run.definition_drift(rows, conf(config, dev="defs/dev", prod="defs/prod"))
    assert tuples(got, "job_key", "path", "kind") == [("job-2", "name", "changed")]


def test_gate_judges_only_definitions_in_configured_folders(spark, files, defs, config):
    from fleetlens.operators import catalog
    from fleetlens.plans import gate_run

    src = files({"a.py": "x = 1"})
    rows = defs(("repo", "prod", "JOB-1_A.json", {"name": "n"}), ("repo", "lab", "JOB-1_A.json", "{"))
    doc = spark.createDataFrame([], "repo string, job_dir string, text string, content_sha256 string")
    folders = catalog.job_folders(src)
    for dirs, problems in (({"prod": "defs/prod"}, 0), ({"prod": "defs/prod", "lab": "defs/lab"}, 1)):
        checks = gate_run.run_checks(folders, src, doc, rows, conf(config, **dirs))
        gate = {r.check: (r.ok, r.n_problems) for r in gate_run.job_gate(folders, checks).collect()}
        assert gate["job_definitions"] == (problems == 0, problems)
        assert gate["dependency_vulns"] == (True, 0) and gate["notebook_syntax"] == (True, 0)


def test_task_refs(spark):
    good = ["nightly_load", "RAW.nightly_load", "prod.raw.load$2", "_x"]
    bad = ["", "2load", "a.b.c.d", "a..b", ".a", "a.", "load; drop table t", "load'--", "lo ad", "../load", "load\n", "lädt", None]
    rows = spark.createDataFrame([(r,) for r in good + bad], "ref string").select("ref", text.is_task_ref(F.col("ref")).alias("ok"))
    assert [r.ref for r in rows.where("ok").collect()] == good and rows.where("ok is null").count() == 0
