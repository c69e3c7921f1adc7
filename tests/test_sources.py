from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from conftest import tuples

from fleetlens.operators import definitions
from fleetlens.plans import queries
from fleetlens.session import drop_path
from fleetlens.sources import files, listing, policy, snapshots


def put(root, path, data):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan_source_files(spark, tmp_path):
    put(tmp_path, "my repo/jobs/JOB-1_A/a.py", "x\r\ny\rz\n")
    put(tmp_path, "my repo/jobs/JOB-1_A/deep/100%+b.sql", b"caf\xe9 \xe2\x82 ok")
    put(tmp_path, "my repo/jobs/JOB-1_A/readme.md", "no")
    put(tmp_path, "my repo/lib/JOB-1_A/a.py", "no")
    assert tuples(files.scan_source_files(spark, [str(tmp_path)])) == [
        ("my repo", "JOB-1_A", "jobs/JOB-1_A/a.py", "py", "x\ny\nz\n", 7),
        ("my repo", "JOB-1_A", "jobs/JOB-1_A/deep/100%+b.sql", "sql", b"caf\xe9 \xe2\x82 ok".decode(errors="replace"), 10),
    ]
    assert [p.rsplit("/", 1)[1] for p, in tuples(files.scan_tree(spark, [str(tmp_path)], "*.{py,sql}"), "path")] == ["a.py", "a.py"]


def test_names_that_begin_with_a_mark_are_files_too(spark, tmp_path):
    for name in ("__init__.py", ".hidden.py", "_lib/a.py", ".cache/b.py", ".git/c.py", "x.PY", "empty.py"):
        put(tmp_path, f"r/jobs/JOB-1_A/{name}", "" if name == "empty.py" else "x")
    found = tuples(files.scan_source_files(spark, [str(tmp_path)]), "path", "n_bytes")
    assert [(p.removeprefix("jobs/JOB-1_A/"), n) for p, n in found] == [(".cache/b.py", 1), (".hidden.py", 1), ("__init__.py", 1), ("_lib/a.py", 1), ("empty.py", 0)]


def test_listing_of_job_folders_only(spark, tmp_path, config):
    for path in ("a/jobs/JOB-1_A/a.py", "a/lib/x/y.py", "b/jobs/JOB-2_A/a.py", "b/etl/JOB-3_A/sub/deep/a.py", "b/etl/loose.py", "c/readme"):
        put(tmp_path, path, "x")
    conf = config({"repo": "b", "project": {"jobs_dir": "./etl/"}})
    assert tuples(files.list_job_files(spark, [str(tmp_path)], config=conf), "repo", "job_dir", "path", "rest", "length") == [
        ("a", "JOB-1_A", "jobs/JOB-1_A/a.py", "a.py", 1), ("b", "JOB-3_A", "etl/JOB-3_A/sub/deep/a.py", "sub/deep/a.py", 1),
    ]
    only = files.list_job_files(spark, [str(tmp_path)], config=conf, folders=[f"{tmp_path}/b/etl/JOB-3_A", f"{tmp_path}/b/jobs/JOB-2_A"])
    assert tuples(only, "path") == [("etl/JOB-3_A/sub/deep/a.py",)]
    whole = config({"repo": "a", "project": {"jobs_dir": "."}})
    assert ("a", "lib", "lib/x/y.py") in tuples(files.list_job_files(spark, [str(tmp_path)], config=whole), "repo", "job_dir", "path")
    assert files.list_job_files(spark, [str(tmp_path / "nowhere")]).count() == 0


def test_changes_between_listings(spark, tmp_path):
    for i in range(4):
        put(tmp_path, f"r{i % 2}/jobs/JOB-{i}_A/a.py", "x")
    take = lambda: files.list_job_files(spark, [str(tmp_path)])
    before = take()
    gone = take().where("job_dir = 'JOB-3_A'")
    put(tmp_path, "r0/jobs/JOB-0_A/a.py", "longer")
    put(tmp_path, "r0/jobs/JOB-9_A/b.py", "x")
    drop_path(spark, f"{tmp_path}/r1/jobs/JOB-3_A")
    assert tuples(listing.file_changes(before, take())) == [
        ("r0", "jobs/JOB-0_A/a.py", "changed"), ("r0", "jobs/JOB-9_A/b.py", "added"), ("r1", "jobs/JOB-3_A/a.py", "removed"),
    ]
    assert gone.count() == 1 and listing.with_content(gone).count() == 0  # vanished after it was listed


def test_listings_are_handed_over_by_rows_not_by_folder(tmp_path):
    for i in range(6):
        put(tmp_path, f"f{i // 2}/{i}.py", "x")
    folders = pa.record_batch({"repo": ["r"] * 3, "path": [""] * 3, "uri": [f"{tmp_path}/f{i}" for i in range(3)]})
    listed = lambda *more: list(listing._list_level(["*"], *more)(iter([folders])))
    assert [b.num_rows for b in listed()] == [6] and [b.num_rows for b in listed(4)] == [4, 2] and listed()[0].schema == listed(4)[1].schema
    assert sorted(listed()[0].column("path").to_pylist()) == [f"{i}.py" for i in range(6)]


def test_names_of_file_systems():
    name = lambda uri: listing.file_system(uri)[1]
    assert [name(u) for u in ("/a b/c", "file:/a b/c%20", "file:///a", "file:/")] == ["/a b/c", "/a b/c%20", "/a", "/"]
    assert listing._patterns("*.{py,sql}") == ["*.py", "*.sql"] and listing._patterns("a") == ["a"]


def test_scan_docs_one_level_deep(spark, tmp_path):
    put(tmp_path, "r/jobs/JOB-1_A/claude.md", "# x\r\n")
    put(tmp_path, "r/jobs/JOB-1_A/sub/claude.md", "no")
    put(tmp_path, "r/jobs/notes/claude.md", "no key")
    assert tuples(files.scan_job_docs(spark, [str(tmp_path)])) == [("r", "JOB-1_A", "# x\n", hashlib.sha256(b"# x\r\n").hexdigest())]
    assert files.scan_job_docs(spark, [str(tmp_path)], key_prefixes=["ABC"]).count() == 0


def test_scan_definitions(spark, tmp_path):
    put(tmp_path, "r/databricks/job_definitions/prod/JOB-1_Load.v2.json", '{"name": "n"}')
    put(tmp_path, "r/databricks/job_definitions/dev/JOB-2.sql", "create task t")
    found = definitions.describe(files.scan_definitions(spark, [str(tmp_path)]))
    assert tuples(found.fillna("-"), "repo", "job_key", "env", "stem", "ext", "name") == [
        ("r", "job-1", "prod", "JOB-1_Load.v2", "json", "n"), ("r", "job-2", "dev", "JOB-2", "sql", "-"),
    ]


def test_scans_follow_each_repository(spark, tmp_path, config):
    put(tmp_path, "repo1/job_definitions/prod/JOB-1_x.json", "{}")
    put(tmp_path, "repo2/jobs/JOB-2_x/jobs/sub/a.py", "x")
    put(tmp_path, "repo3/etl/JOB-3_x/a.py", "x")
    put(tmp_path, "repo3/etl/JOB-3_x/claude.md", "x")
    put(tmp_path, "repo3/etl/index_data.json", '{"jobs":[{"ticket":"J-1","name":"n"}]}')
    put(tmp_path, "repo3/infra/etl/job_definitions/prod/JOB-3_x.json", "{}")
    put(tmp_path, "repo4/infra/defs/prod/JOB-4_x.json", "{}")
    put(tmp_path, "repo4/job_definitions/prod/JOB-5_x.json", "{}")
    put(tmp_path, "a.b/j+s/JOB-6_x/a.py", "x")
    conf = config(
        {"repo": "repo3", "project": {"jobs_dir": "etl/"}}, {"repo": "a.b", "project": {"jobs_dir": "j+s"}},
        {"repo": "repo4", "platform": {"job_def_dirs": {"live": "infra/defs/prod/"}}},
    )
    root = [str(tmp_path)]
    assert tuples(files.scan_source_files(spark, root, config=conf), "repo", "job_dir", "path") == [
        ("a.b", "JOB-6_x", "j+s/JOB-6_x/a.py"), ("repo2", "JOB-2_x", "jobs/JOB-2_x/jobs/sub/a.py"), ("repo3", "JOB-3_x", "etl/JOB-3_x/a.py"),
    ]
    assert tuples(files.scan_definitions(spark, root, config=conf), "repo", "env", "path") == [
        ("repo1", "prod", "job_definitions/prod/JOB-1_x.json"), ("repo3", "prod", "infra/etl/job_definitions/prod/JOB-3_x.json"),
        ("repo4", "live", "infra/defs/prod/JOB-4_x.json"),
    ]
    assert tuples(files.scan_job_docs(spark, root, config=conf), "repo", "job_dir") == [("repo3", "JOB-3_x")]
    assert tuples(files.load_enrichment(spark, root, config=conf), "repo", "ticket") == [("repo3", "J-1")]


def test_enrichment_last_entry_wins(spark, tmp_path):
    put(tmp_path, "a/jobs/index_data.json", json.dumps({"jobs": [
        {"ticket": "J-1", "name": "old", "objects": ["x.y"]}, {"name": "none"}, {"ticket": "J-1", "name": "new"}]}))
    put(tmp_path, "b/jobs/index_data.json", '{"jobs": [')
    assert tuples(files.load_enrichment(spark, [str(tmp_path)]), "repo", "ticket", "name") == [("a", "J-1", "new")]


def test_live_jobs_of_every_platform(spark, tmp_path):
    put(tmp_path, "kind=databricks/a.json", "\n".join(map(json.dumps, [
        {"repo": "r", "job_id": "7", "settings": {"name": "n", "schedule": {"quartz_cron_expression": "0", "pause_status": "PAUSED"}}},
        {"repo": "r", "job_id": "8", "settings": {"name": "m"}}])))
    put(tmp_path, "kind=airflow/a.json", json.dumps({"repo": "r", "dag_id": "d", "paused": "False"}))
    put(tmp_path, "kind=snowflake_tasks/a.json", json.dumps({"repo": "r", "name": "T", "state": "Suspended", "schedule": "1 m"}))
    put(tmp_path, "kind=dbt/a.json", json.dumps({"repo": "r", "name": "model"}))
    got = {(r.kind, r.job_id): (r.name, r.paused, r.schedule) for r in snapshots.load_live_jobs(spark, str(tmp_path)).collect()}
    assert got == {
        ("databricks", "7"): ("n", True, "0"), ("databricks", "8"): ("m", None, None), ("airflow", "d"): ("d", False, None),
        ("snowflake_tasks", "T"): ("T", True, "1 m"), ("dbt", "model"): ("model", None, None),
    }


def test_advisories(spark, tmp_path):
    put(tmp_path, "adv.json", json.dumps({"package": "A_b", "version": "1", "vulns": [{"id": "V1"}, {"id": "V2"}]}))
    put(tmp_path, "allow.json", json.dumps({"package": "a.B", "version": "1", "vulns": ["V1"]}))
    known, allowed = snapshots.load_advisories(spark, str(tmp_path / "adv.json"), str(tmp_path / "allow.json"))
    assert tuples(known) == [("a-b", "1", "V1"), ("a-b", "1", "V2")] and tuples(allowed) == [("a-b", "1", "V1")]


def test_policy_tables_and_rows(config):
    conf = config({"architecture": {"layer_rules": {"a": ["x"], "A": ["y", "z"]}, "replace_hints": {"s": "1", "S": "2"}, "deprecated_schema_deny": ["q"]}})
    [row] = policy.policy_rows(conf).collect()
    assert (row.deny, row.exceptions, row.hints, row.layer_rules) == (["Q"], [], {"S": "2"}, {"A": ["Y", "Z"]})
    tables = policy.load_policy(conf)
    assert tuples(tables["deny"], "term", "schema") == [("q", "Q")]
    assert tuples(tables["doc_rule"].where("kind = 'doc'"), "ord", "field") == [(0, "Purpose"), (1, "Schedule"), (2, "Business Owner")]


def test_repositories_of_a_large_tree_lie_below_several_roots(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id as c_custkey", "concat('C', id) as c_name", "id % 3 as c_nationkey", "'M' as c_mktsegment").write.parquet(
        str(tmp_path / "customer.parquet"))
    written, write = [], queries.write_tree
    monkeypatch.setattr(queries, "write_tree", lambda rows, root: (written.extend(r["path"] for r in rows.collect()), write(rows, root)))
    found = queries.QUERIES["load_enrichment"](spark, str(tmp_path))
    assert {len(p.split("/")) for p in written} == {4} and len({p.split("/")[0] for p in written}) > 10
    assert found.count() == 70 and tuples(found.where("repo = 'repo1'")) == [("repo1", "JOB-1", "C1", None, "o1")]
