from __future__ import annotations

import hashlib
import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from fleetlens.functions import ranks, skew, text
from fleetlens.operators import catalog, freshness, graph, runs
from fleetlens.plans.catalog_build import build_catalog
from fleetlens.sources import sinks
from fleetlens.sources.schemas import ENRICHMENT, JOB_DEF, JOB_DOC

DOC = "# Job: JOB-1 Demo\n**Purpose**: Sums things\n**Schedule**: weekly\n**Business Owner**: Analytics Team\n**Status**: TESTING\n"


@pytest.fixture
def estate(spark, files, config):
    """One demo job with everything, a second folder of the same ticket, and a bare job."""
    src = files({
        "demo.py": "# STATUS: ACTIVE\n# LAST_UPDATED: 2024-02-01\nq = 'SELECT * FROM ANALYTICS.VW_X JOIN legacy.old'",
        "JOB-1_B/q.sql": "select 1 from analytics.vw_x", "JOB-20_C/q.sql": "update Staging.tt",
    })
    conf = config({
        "project": {"jobs_dir": "jobs", "ticket_url_template": "https://t/{id}"},
        "platform": {"job_def_dirs": {"prod": "defs"}},
        "architecture": {"deprecated_schema_deny": ["LEGACY"]},
    })
    doc = spark.createDataFrame([("r", "JOB-1_A", DOC, hashlib.sha256(DOC.encode()).hexdigest())], JOB_DOC)
    job_def = spark.createDataFrame(
        [("r", "job-1", "repo", "prod", "defs/JOB-1.json", "JOB-1", "json", '{"name": "N", "schedule": {"quartz_cron_expression": "0 7"}}')], JOB_DEF
    )
    curated = spark.createDataFrame(
        [("r", "JOB-20", None, "x" * 200, "Team", "", "2020-01-01", [" Extra.o ", "", "STAGING.TT"], None),
         ("r", "JOB-1", "", "Curated", None, None, None, None, "other")], ENRICHMENT
    )
    folders = catalog.job_folders(src.select("repo", "job_dir"), conf)
    return build_catalog(folders, src, doc, job_def, curated, conf).persist()


def test_catalog_precedence(estate):
    rows = {r.dir: r for r in catalog.in_catalog_order(estate).collect()}
    assert list(rows) == ["JOB-1_A", "JOB-1_B", "JOB-20_C"]
    a, b, c = rows.values()
    assert (a.name, a.purpose, a.schedule, a.owner, a.status, a.last_updated) == ("JOB-1 Demo", "Curated", "0 7", "Analytics Team", "ACTIVE", "2024-02-01")
    assert (a.flags, a.objects, a.url, a.link) == (["LEGACY"], ["ANALYTICS.VW_X", "legacy.old"], "https://t/JOB-1", "jobs/JOB-1_A/")
    assert (a.has_claude_md, a.stale) == (True, True) and (b.has_claude_md, b.stale) == (False, False)
    assert (b.name, b.owner, b.status) == ("N", "—", "Unknown")
    assert (c.name, c.purpose, c.owner, c.last_updated) == ("JOB-20_C", "x" * 200, "Team", "2020-01-01")
    assert c.objects == ["Extra.o", "STAGING.TT"]


def test_summary_and_indexes(estate):
    assert tuples(catalog.catalog_summary(estate), "ord", "metric", "n") == [
        (0, "jobs", 3), (1, "status:ACTIVE", 1), (4, "status:Unknown", 2), (8, "with deprecated refs", 1), (9, "without doc", 2),
    ]
    assert [tuple(r) for r in catalog.in_index_order(catalog.object_index(estate)).select("object", "n_jobs", "dir").collect()] == [
        ("ANALYTICS.VW_X", 2, "JOB-1_A"), ("ANALYTICS.VW_X", 2, "JOB-1_B"), ("Extra.o", 1, "JOB-20_C"),
        ("legacy.old", 1, "JOB-1_A"), ("STAGING.TT", 1, "JOB-20_C"),
    ]
    assert tuples(catalog.migration_map(estate), "schema", "n_jobs", "dir") == [("LEGACY", 1, "JOB-1_A")]


def test_graph_counts_tickets_not_folders(estate):
    assert tuples(graph.graph_job_nodes(estate), "ticket", "name", "n_folders") == [("JOB-1", "JOB-1 Demo", 2), ("JOB-20", "JOB-20_C", 1)]
    assert tuples(graph.graph_object_nodes(estate).where("object = 'ANALYTICS.VW_X'"), "layer", "n_tickets", "ticket", "name") == [
        ("ANALYTICS", 1, "JOB-1", "JOB-1 Demo"),
    ]
    assert tuples(graph.graph_job_facets(estate).where("ticket = 'JOB-1'"), "facet", "value") == [
        ("flag", "LEGACY"), ("folder", "JOB-1_A"), ("folder", "JOB-1_B"), ("object", "ANALYTICS.VW_X"), ("object", "legacy.old"),
        ("owner", "Analytics Team"),
    ]
    assert graph.graph_edges(estate).count() == 4


def test_related_jobs_of_given_jobs(spark):
    edges = spark.createDataFrame(
        [("r", t, o) for t, objects in {"J-1": "abc", "J-2": "bc", "J-3": "c", "J-4": "d"}.items() for o in objects],
        "repo string, ticket string, object_key string",
    )
    target = spark.createDataFrame([("r", "J-1")], "repo string, ticket string")
    assert tuples(graph.related_jobs(edges, target), "related", "n_shared", "first_shared") == [("J-2", 2, "b"), ("J-3", 1, "c")]
    numbered = spark.createDataFrame([("r", t, "a") for t in ("J-100", "J-12300", "J-10", "J-1001", "J-" + "9" * 30 + "00", "J-0")], edges.schema)
    assert {t for t, in tuples(graph.looked_up_jobs(numbered), "ticket")} == {"J-100", "J-12300", "J-" + "9" * 30 + "00", "J-0"}


def test_crowded_objects_are_counted_like_others(spark):
    """Shared objects by bit sets, by joins, and by both, over more than one word of bits."""
    draw = random.Random(3)
    rows = [(f"r{r}", f"J-{t}", f"o{o:03d}") for r in range(2) for t in range(40) for o in draw.sample(range(150), 60)]
    rows += [("r0", f"J-{t}", "hub") for t in range(40)] + [("r1", "J-1", "only")]
    edges = spark.createDataFrame(rows, "repo string, ticket string, object_key string")
    targets = spark.createDataFrame([("r0", "J-1"), ("r0", "J-39"), ("r1", "J-7"), ("r1", "none")], "repo string, ticket string")
    own = {}
    for repo, ticket, key in rows:
        own.setdefault((repo, ticket), set()).add(key)
    want = sorted(
        (r, j, t, len(own[r, j] & o), min(own[r, j] & o)) for r, j in (("r0", "J-1"), ("r0", "J-39"), ("r1", "J-7")) for (q, t), o in own.items() if q == r and t != j and own[r, j] & o
    )
    for least in (0, 15, 20, 10**6):
        assert tuples(graph.related_jobs(edges, targets, least)) == want


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(3000).selectExpr("'r' as repo", "if(id % 3 = 0, 'hot', concat('o', id % 40)) as object_key", "concat('JOB-', (id * 7919) % 3000) as ticket", "concat('d', id) as dir")
    got = ranks.ranked(rows.repartition(7), ["repo", "object_key"], [text.key_number(F.col("ticket")), F.col("ticket"), F.col("dir")], parts=16)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.object_key, []).append((int(r.ticket[4:]), r.ticket, r.dir))
    want = sorted((k, d, i) for k, g in groups.items() for i, (_, _, d) in enumerate(sorted(g), 1))
    assert tuples(got, "object_key", "dir", "rank") == want and got.columns == [*rows.columns, "rank"]
    assert len(groups["hot"]) == 1000


def test_publishing_rewrites_only_what_changed(spark, tmp_path):
    def rows(*data):
        return spark.createDataFrame(list(data), "repo string, dir string, status string, flags array<string>")

    path = str(tmp_path / "catalog")
    old = rows(("a", "J-1", "x", ["f"]), ("a", "J-2", "x", None), ("b", "J-1", "x", []), ("c", "J-9", "x", []))
    sinks.publish_catalog(old, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "catalog" / "repo=b").iterdir()}
    fresh = rows(("a", "J-1", "y", ["f"]), ("a", "J-3", "x", None), ("b", "J-1", "x", []))
    assert tuples(freshness.catalog_staleness(fresh, old)) == [("a", "J-1", "changed"), ("a", "J-3", "missing")]
    assert tuples(freshness.catalog_orphans(fresh, old)) == [("a", "J-2"), ("c", "J-9")]
    for _ in range(2):
        sinks.write_catalog(fresh, path)
        assert tuples(sinks.read_catalog(spark, path, sinks.fresh_schema(fresh)), "repo", "dir", "status") == [
            ("a", "J-1", "y"), ("a", "J-3", "x"), ("b", "J-1", "x"),
        ]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "catalog" / "repo=b").iterdir()} == before


def test_orphans_ignore_case_and_stale_summaries_compare_hashes(spark):
    one = lambda d: spark.createDataFrame([("r", d)], "repo string, dir string")
    assert freshness.catalog_orphans(one("job-1"), one("JOB-1")).count() == 0
    assert tuples(freshness.catalog_orphans(one("job-1"), one("JOB-999"))) == [("r", "JOB-999")]
    curated = spark.createDataFrame([("r", "J-1", "s", "h1"), ("r", "J-2", "s", "h"), ("r", "J-3", "", "h1"), ("r", "J-4", "s", None)], "repo string, ticket string, summary string, claude_md_hash string")
    folders = spark.createDataFrame([("r", f"{t}_X", t) for t in ("J-1", "J-2", "J-3", "J-4")], "repo string, job_dir string, ticket string")
    doc = folders.select("repo", "job_dir", F.lit("h").alias("content_sha256"))
    assert tuples(freshness.stale_summaries(curated, folders, doc), "ticket") == [("J-1",)]


def test_result_does_not_depend_on_row_order(spark, files):
    from fleetlens.operators import extract

    texts = {f"f{i}.{e}": f"from raw.{'TAB' if i % 2 else 'tab'} join s.o{i % 3}x" for i in range(20) for e in ("py", "sql")}
    want = None
    for seed in range(3):
        items = list(texts.items())
        random.Random(seed).shuffle(items)
        got = tuples(extract.object_refs(files(dict(items)).repartition(7)))
        want = want or got
        assert got == want


def test_hot_keys_join_in_several_tasks(spark):
    rows = spark.range(200_000)
    facts = rows.select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id").repartition(16)
    lookup = spark.createDataFrame([("hot", 1), ("9", 2)], "k string, v int")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = skew.lookup_join(facts, lookup, ["k"])
        values = [r.v for r in joined.collect()]
        assert len(values) == 200_000 and values.count(1) == 180_000 and values.count(2) == 1
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)


def test_runs(spark):
    run = spark.createDataFrame(
        [("r", "databricks", "J-1", "1", "RUNNING", None, ["t"], "", "boom", None, "raw"),
         ("r", "databricks", "J-1", "2", "TERMINATED", "FAILED", None, "Connection refused", None, True, "raw"),
         ("r", "airflow", "J-2", "3", "running", None, None, None, None, None, "z" * 5000),
         ("r", "dbt", "J-3", "4", "RUNNING", "FAILED", None, "x", "y", False, "raw"),
         ("r", "airflow", "J-2", "5", None, None, None, None, None, None, "raw")],
        "repo string, kind string, job_key string, run_id string, state string, result_state string, tasks array<string>, "
        "logs string, error string, logs_truncated boolean, payload string",
    ).withColumn("started", F.lit("2024"))
    active = runs.active_runs(run)
    assert tuples(active, "run_id") == [("1",), ("3",)]
    asked = spark.createDataFrame([(1, "r", "J-1"), (2, "r", "J-3")], "request_id int, repo string, job_key string")
    assert tuples(runs.trigger_conflicts(asked, active).fillna("-"), "request_id", "n_active", "first_run_id", "ok") == [(1, 1, "1", False), (2, 0, "-", True)]
    assert tuples(runs.run_status(run).where("run_id in (1, 5)"), "state", "n_tasks") == [("RUNNING", 1), ("UNKNOWN", 0)]
    out = {r.run_id: (r.text, r.truncated) for r in runs.run_output(run).collect()}
    assert out["1"] == ("boom", False) and out["2"] == ("Connection refused", True) and out["3"] == ("z" * 5000, False)
    rows = spark.createDataFrame([("r", "J-1", "J-1_A", "n", "o", True)], "repo string, ticket string, dir string, name string, owner string, has_claude_md boolean")
    edges = spark.createDataFrame([("r", "J-1", "a"), ("r", "J-3", "a"), ("r", "J-1", "b"), ("r", "J-2", "b")], "repo string, ticket string, object_key string")
    assert tuples(runs.failure_triage(run, rows, edges).fillna("-"), "run_id", "class", "dir", "has_doc", "n_shared_objects", "max_failing_jobs") == [
        ("2", "transient", "J-1_A", True, 1, 2), ("4", "unclassified", "-", False, 1, 2),
    ]
