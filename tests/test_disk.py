"""What steps leave on disk and send to the driver."""

from __future__ import annotations

import re

from conftest import tuples
from pyspark.sql import functions as F

from fleetlens import session
from fleetlens.functions import ranks
from fleetlens.functions import text as X
from fleetlens.operators import catalog, graph, secrets
from fleetlens.plans import catalog_build, gate_run, queries
from fleetlens.sources import schemas, sinks


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_job_nodes_come_from_the_whole_catalog(spark, monkeypatch):
    columns = "repo string, ticket string, dir string, name string, status string, last_updated string, purpose string"
    rows = spark.createDataFrame([("r", "J-1", "b", "B", "x", "d", "p"), ("r", "J-1", "a", "A", "y", "e", "q")], columns)
    asked = []
    monkeypatch.setattr(queries, "_sources", lambda e: {})
    monkeypatch.setattr(catalog_build, "build_catalog", lambda **sources: asked.append(1) or rows)
    assert tuples(queries.graph_job_nodes(None)) == [("r", "J-1", "A", "y", "e", "q", 2)] and asked == [1]


def test_looked_up_jobs_go_to_no_more_blocks_than_tasks_need(spark):
    edges = spark.createDataFrame([(f"r{i}", f"J-{t}", o) for i in range(200) for t in range(3) for o in "abc"], "repo string, ticket string, object_key string")
    found = graph.related_jobs(edges, spark.createDataFrame([("r7", "J-1")], "repo string, ticket string"), least=2)
    blocks = re.findall(r"pmod\(xxhash64\(ticket#\d+, 42\), (\d+)\)", _plan(found))
    assert blocks and max(map(int, blocks)) <= -(-4 * graph._pair_parts(edges) // 200)
    assert tuples(found) == [("r7", "J-1", "J-0", 3, "a"), ("r7", "J-1", "J-2", 3, "a")]


def test_shuffle_files_of_many_written_rows_are_given_up(spark, monkeypatch):
    released = []
    monkeypatch.setattr(session, "release_shuffles", lambda s: released.append(s))
    assert session.settle(spark.range(5), "few").count() == 5 and not released
    monkeypatch.setattr(session, "RELEASE_BYTES", 1)
    assert session.settle(spark.range(5), "many").count() == 5 and len(released) == 1


def test_ranks_are_sorted_by_columns(spark, monkeypatch):
    rows = spark.createDataFrame([("r", "o", f"J-{t}") for t in (10, 9, "007", 100, "x")], "repo string, object_key string, ticket string")
    plans, settle = [], ranks.settle
    monkeypatch.setattr(ranks, "settle", lambda df, label: plans.append(_plan(df)) or settle(df, label))
    found = ranks.ranked(rows, ["repo", "object_key"], [X.key_number(F.col("ticket")), F.col("ticket")])
    sort = next(line for line in plans[0].splitlines() if " Sort [" in line)
    assert "regexp" not in sort and found.columns == [*rows.columns, "rank"]
    assert [t for t, _ in sorted(tuples(found, "ticket", "rank"), key=lambda r: r[1])] == ["J-x", "J-007", "J-9", "J-10", "J-100"]


def test_number_of_a_ticket_is_read_before_its_objects_become_rows(spark):
    rows = spark.createDataFrame([("r", "J-7", "d", ["B.x", "a.Y"])], "repo string, ticket string, dir string, objects array<string>")
    plan = _plan(catalog.object_entries(rows)).splitlines()
    explode, number = (next(i for i, line in enumerate(plan) if word in line) for word in ("Generate", "regexp_extract"))
    assert number > explode  # below it
    assert tuples(catalog.object_entries(rows), "object_key", "place.num.digits", "place.pos") == [("a.y", "7", 1), ("b.x", "7", 0)]


def test_names_are_told_apart_without_calls_for_each_comparison(spark):
    rows = spark.createDataFrame([(["b.X", "A.y", "B.x", "b.X", "a.Y", "c"],), ([],)], "names array<string>")
    found = rows.select(X.distinct_fold_case(F.col("names")).alias("n"))
    assert "array_sort" not in _plan(found) and [r.n for r in found.collect()] == [["A.y", "b.X", "c"], []]


def test_the_gate_keeps_configurations_of_the_repositories_at_hand(spark, files, config, monkeypatch):
    src = files({"a.py": "x = 1"}).unionByName(files({"a.sql": "select * from OLD.t"}, repo="q"))
    deny = {"architecture": {"deprecated_schema_deny": ["OLD"], "layer_rules": {}}}
    conf = config({**deny}, {"repo": "q", **deny}, *({"repo": f"other{i}"} for i in range(9)))
    kept, required = [], gate_run.required_fields
    monkeypatch.setattr(gate_run, "required_fields", lambda c: kept.extend(tuples(c, "repo")) or required(c))
    none = lambda schema: spark.createDataFrame([], schema)
    folders = catalog.job_folders(src.where("repo = 'r'"))
    checks = gate_run.run_checks(folders, src, none(schemas.JOB_DOC), none(schemas.JOB_DEF), conf)
    assert kept == [("q",), ("r",)]
    # A repository without a folder of its own keeps its findings.
    assert tuples(checks.findings, "repo", "schema") == [("q", "OLD")]
    assert gate_run.job_gate(folders, checks).count() == 5


def test_findings_are_written_compressed_and_in_rounds(spark, tmp_path, monkeypatch):
    rows = spark.range(90).selectExpr("if(id % 7 = 6, null, concat('r', id % 7)) as repo", "id", "concat('says ', id) as message")
    path = str(tmp_path / "found")
    for most, _ in ((10**6, 1), (20, 5)):
        monkeypatch.setattr(sinks, "ROUND_ROWS", most)
        sinks.write_findings(rows, path)
        names = [p.name for p in (tmp_path / "found").rglob("part-*")]
        assert names and all(n.endswith(".json.gz") for n in names)
        assert tuples(spark.read.schema(rows.schema).json(path).fillna("-"), *rows.columns) == tuples(rows.fillna("-"))


def test_pieces_of_a_line_are_cut_in_one_pass(spark):
    texts = spark.createDataFrame([("r", "a", "\U0001f600\U0001f600 so denied\U0001d4b3\nabc\n" + "x" * 3000 + "DEN\u0130ED"), ("r", "b", "\U0001d4b3 \U0001f600ab\U0001d4b3")], "repo string, path string, text string")
    terms = spark.createDataFrame([(None, "denied"), ("r", "\U0001f600ab\U0001d4b3"), ("q", "denied")], "repo string, term string")
    found = secrets.denylist_table_scan(texts, terms)
    plan = _plan(found)
    assert "sequence(" not in plan and "Join" in plan and "NestedLoop" not in plan
    assert tuples(found) == [("r", "a", 1, 1), ("r", "b", 1, 1)]
    loose = secrets.denylist_table_scan(texts, terms.unionByName(spark.createDataFrame([("r", "a.c")], "repo string, term string")))
    assert tuples(loose) == [("r", "a", 1, 1), ("r", "a", 2, 1), ("r", "b", 1, 1)]
