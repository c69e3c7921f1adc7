"""The published estate is refreshed job by job and equals a full rebuild."""

from __future__ import annotations

import json
import shutil

import pytest
from conftest import tuples

from fleetlens.operators import catalog, graph
from fleetlens.plans import catalog_build
from fleetlens.session import settle
from fleetlens.sources import files, schemas, sinks
from fleetlens.sources.published import Published
from fleetlens.streaming.catalog_refresh import catalog_refresh_stream, touched_jobs


@pytest.fixture
def tree(spark, config, tmp_path):
    """Two repositories on disk, one with its jobs in another folder, and scans of all or of some jobs."""
    root = tmp_path / "repos"
    conf = config({"repo": "a"}, {"repo": "b", "project": {"jobs_dir": "etl/work"}}, {"repo": "c"}).persist()
    seen: list[set[str]] = []

    def put(path, text):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    def scan(folders=None):
        src = files.scan_source_files(spark, [str(root)], config=conf, folders=folders)
        docs = files.scan_job_docs(spark, [str(root)], config=conf, folders=folders)
        if folders is not None:
            listed = files.list_job_files(spark, [str(root)], config=conf, folders=folders)
            seen.append({f.split("/repos/")[1].rsplit("/", 1)[0] for f, in listed.select("uri").collect()})
        dirs = src.select("repo", "job_dir").unionByName(docs.select("repo", "job_dir"))
        return catalog.job_folders(dirs, conf), src, docs

    def rows(folders=None):
        job_folders, src, docs = scan(folders)
        none = lambda schema: spark.createDataFrame([], schema)
        built = catalog_build.build_catalog(job_folders, src, docs, none(schemas.JOB_DEF), none(schemas.ENRICHMENT), conf)
        return settle(built, "rows")

    put("a/jobs/JOB-1_A/q.sql", "select 1 from Raw.One join raw.two")
    put("a/jobs/JOB-1_B/q.sql", "select 1 from raw.one")
    put("a/jobs/JOB-2_A/q.sql", "select 1 from RAW.ONE join RAW.TWO")
    put("a/jobs/JOB-30_A/sub/q.py", "# STATUS: ACTIVE\nq = 'from raw.three'")
    put("b/etl/work/JOB-5_A/q.sql", "select 1 from Raw.One")
    put("b/etl/work/JOB-6_A/q.sql", "select 1 from raw.one join x.yy")
    put("b/jobs/JOB-7_A/q.sql", "select 1 from raw.seven")  # not this repository's jobs folder
    build = lambda jobs: rows(files.job_paths(spark, [str(root)], jobs, config=conf))
    return root, put, rows, build, conf, seen


def everything(rows, totals=None):
    """C1 and C3 to C6 as sets of rows."""
    return {
        "catalog": tuples(rows.selectExpr("*", "array_join(flags, ',') as f", "array_join(objects, ',') as o").drop("flags", "objects").fillna("")),
        "index": tuples(catalog.object_index(rows, totals)),
        "facets": tuples(graph.graph_job_facets(rows, totals)),
        "jobs": tuples(graph.graph_job_nodes(rows)),
        "objects": tuples(graph.graph_object_nodes(rows, totals)),
        "edges": tuples(graph.graph_edges(rows)),
    }


def changed(spark, tmp_path, name, *paths):
    """One file of change events, which makes one micro-batch."""
    folder = tmp_path / "changes"
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"repo": p.split(":")[0], "path": p.split(":")[1]}) for p in paths))
    reader = spark.readStream.schema(schemas.FILE_CHANGE).option("maxFilesPerTrigger", 1)
    return reader.json(str(folder))


def test_refresh_reads_touched_folders_only_and_equals_a_rebuild(spark, tree, tmp_path):
    root, put, rows, build, conf, seen = tree
    published = Published.first(rows(), str(tmp_path / "published"))
    assert everything(published.catalog(), published.totals()) == everything(rows())

    def run(name, *paths):
        stream = changed(spark, tmp_path, name, *paths)
        catalog_refresh_stream(stream, build, published, str(tmp_path / "state"), config=conf).awaitTermination()
        assert everything(published.catalog(), published.totals()) == everything(rows())
        folders = {f for some in seen for f in some}
        seen.clear()
        return folders

    # The holder of an object's label loses it; the next one is found among jobs that are not read.
    put("a/jobs/JOB-1_A/q.sql", "select 1 from raw.FOUR")
    mtimes = {p: p.stat().st_mtime_ns for p in (tmp_path / "published").rglob("repo=b/*/*.parquet")}
    assert run("1", "a:src/../jobs/JOB-1_A/q.sql") == {"a/jobs/JOB-1_A"}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "published").rglob("repo=b/*/*.parquet")} == mtimes
    labels = dict(tuples(published.totals().where("repo = 'a'"), "object_key", "object"))
    assert labels["raw.one"] == "raw.one" and labels["raw.two"] == "RAW.TWO" and labels["raw.four"] == "raw.FOUR"
    # A folder vanishes, one appears with an earlier first entry, and the other repository keeps its jobs elsewhere.
    shutil.rmtree(root / "a/jobs/JOB-1_B")
    put("a/jobs/JOB-0_N/q.sql", "select 1 from rAW.tWO")
    put("b/etl/work/JOB-6_A/q.sql", "select 1 from x.zz")
    got = run("2", "a:jobs/JOB-1_B/q.sql", "a:jobs/JOB-0_N/q.sql", "b:etl/work/JOB-6_A/q.sql", "b:jobs/JOB-7_A/q.sql", "a:jobs/JOBS.md", "a:lib/x.py")
    assert got == {"a/jobs/JOB-0_N", "b/etl/work/JOB-6_A"}
    assert dict(tuples(published.totals().where("repo = 'a'"), "object_key", "object"))["raw.two"] == "rAW.tWO"
    assert tuples(published.totals().where("repo = 'b'"), "object_key", "n_jobs") == [("raw.one", 1), ("x.zz", 1)]
    # A first job of a new repository, and the last one of another goes.
    put("c/jobs/JOB-9_A/claude.md", "# Job: JOB-9 Nine")
    shutil.rmtree(root / "b/etl/work/JOB-6_A")
    shutil.rmtree(root / "b/etl/work/JOB-5_A")
    assert run("3", "c:jobs/JOB-9_A/claude.md", "b:etl/work/JOB-6_A/q.sql", "b:etl/work/JOB-5_A/q.sql") == {"c/jobs/JOB-9_A"}
    assert {r for r, in tuples(published.catalog(), "repo")} == {"a", "c"}


def test_broken_off_batches_can_come_again(spark, tree, tmp_path):
    root, put, rows, build, conf, _ = tree
    published = Published.first(rows(), str(tmp_path / "published"))
    put("a/jobs/JOB-2_A/q.sql", "select 1 from raw.one join raw.five")
    jobs = spark.createDataFrame([("a", "JOB-2_A", "JOB-2")], schemas.JOB_FOLDER)
    want = everything(rows())
    # Broken off while the batch's changes are written, and between the two published tables.
    published._stage(jobs, build, f"{published.path}/staged/batch-0")
    shutil.rmtree(tmp_path / "published/staged/batch-0/totals")
    assert everything(published.catalog(), published.totals()) != want
    published._stage(jobs, build, f"{published.path}/staged/batch-1")
    staged = published._staged(f"{published.path}/staged/batch-1", "catalog", published.schema)
    sinks.replace_rows(f"{published.path}/catalog", published.schema, staged, staged.select("repo", "ticket", "bucket"), ["repo", "ticket"])
    for batch in ("batch-1", "batch-1", "batch-0"):
        published.refresh(jobs, build, batch)
        assert everything(published.catalog(), published.totals()) == want


def test_touched_jobs(spark, config):
    conf = config({"repo": "a"}, {"repo": "b", "project": {"jobs_dir": "./etl/work/", "key_prefixes": ["ZZ"]}})
    rows = [("a", "jobs/JOB-1_A/x/y.py"), ("a", "jobs/README"), ("a", "jobs/notes/x.py"), ("b", "etl/work/ZZ-4_Q/a.sql"), ("b", "jobs/ZZ-5_Q/a.sql"), ("b", "etl/work/JOB-1_A/a.sql"),
            ("a", "jobs/graph/JOB-1.md"), ("a", "jobs/JOB-1_A/../JOB-3_C/z")]
    changes = spark.createDataFrame(rows, "repo string, path string")
    assert tuples(touched_jobs(changes, config=conf)) == [("a", "JOB-1_A", "JOB-1"), ("a", "JOB-3_C", "JOB-3"), ("b", "ZZ-4_Q", "ZZ-4")]


def test_one_changed_job_rewrites_one_folder(spark, tmp_path):
    path = tmp_path / "catalog"
    rows = spark.range(200).selectExpr("'r' as repo", "concat('JOB-', id) as ticket", "concat('JOB-', id, '_A') as dir", "'x' as status", "array('f') as flags")
    sinks.publish_catalog(rows, str(path))
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert len({p.parent for p in before}) == sinks.BUCKETS
    fresh = rows.selectExpr("repo", "ticket", "dir", "if(ticket = 'JOB-7', 'y', status) as status", "flags")
    sinks.write_catalog(fresh, str(path))
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert len({p.parent for p, _ in before.items() ^ after.items()}) == 1
    assert tuples(sinks.read_catalog(spark, str(path), sinks.fresh_schema(fresh)).where("status = 'y'"), "dir") == [("JOB-7_A",)]
