from __future__ import annotations

import json
import re

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from fleetlens.functions import patterns as P
from fleetlens.operators import commands, config_audit, inference, secrets
from fleetlens.sources import commands as source
from fleetlens.sources.policy import guard_rules, platform_dim
from fleetlens.streaming import catalog_refresh
from fleetlens.streaming.command_audit import SqlVerdicts, command_audit_stream, sql_verdict_stream

SQL_FILES = [
    ("r", "deploy.sql", "select 1;\ndrop view daily_totals;", 33), ("r", "safe.sql", "select dropped_on from ledger", 29),
    ("r", "big.sql", "-- pad\n" * 300_000 + "truncate table t", 2_100_016), ("r", "sub/x.sql", "re'vo'ke all on v", 17),
]


@pytest.fixture
def decide(spark):
    files = spark.createDataFrame(SQL_FILES, "repo string, path string, text string, n_bytes long")

    def run(kind: str, *cmds: str, cwd: str = "", rules=tuple(P.GUARD_RULES)) -> list[str]:
        rows = [(i, None, "r", kind, cwd, c) for i, c in enumerate(cmds)]
        from fleetlens.sources.schemas import COMMAND

        got = commands.command_audit(spark.createDataFrame(rows, COMMAND), files, rules)
        return [r.reason or "pass" for r in got.orderBy("event_id").collect()]

    return run


def test_quotes_paths_and_files(decide):
    assert decide(
        "databricks", "data'bricks' jo\"bs\" reset --job-id 5", '/usr/local/bin/snow sql -q "DELETE FROM t"', 'snow sql -f "deploy.sql"',
        "snow sql -f big.sql", "psql db < safe.sql", "psql db <deploy.sql", "snow sql -f none.sql", "snow sql -f big.sql", "cat deploy.sql",
        "snow sql -f safe.sql -f none.sql --file='deploy.sql'", "snow sql -q 'create  or replace view v' -f deploy.sql", "snowball DROP", "ls",
    ) == [
        "platform:databricks:jobs-reset", "warehouse:snow:DELETE", "warehouse:snow:DROP", "warehouse:snow:TRUNCATE", "pass", "warehouse:psql:DROP",
        "pass", "warehouse:snow:TRUNCATE", "pass", "warehouse:snow:DROP", "warehouse:snow:CREATE  OR REPLACE", "pass", "pass",
    ]
    assert decide("databricks", "bq query -f x.sql", "bq -f ../deploy.sql", "bq -f /x.sql", cwd="sub") == ["warehouse:bq:REVOKE", "warehouse:bq:DROP", "pass"]
    assert decide("databricks", "snow sql -f ./deploy.sql") == ["warehouse:snow:DROP"]


def test_dbt_prod_in_every_form(decide):
    asked = [f"dbt {verb} {way}" for verb in ("run", "build -s tag:nightly", "seed --full-refresh", "snapshot") for way in ("--target prod", "--target=prod", "-t prod", "-t=prod")]
    asked += ["dbt -t prod --quiet seed", "cd models && dbt --no-color snapshot --target prod", "dbt run-operation vacuum_all --args '{}'"]
    fine = ["dbt seed", "dbt build --target staging", "dbt snapshot -t prod_copy", "dbt docs generate --target prod", "dbt run -t prod-eu"]
    assert all(r.startswith("platform:dbt") for r in decide("dbt", *asked)) and set(decide("dbt", *fine)) == {"pass"}
    assert set(decide("airflow", *asked)) == {"pass"}


def test_rules_are_tried_in_order(decide):
    rules = [("databricks", 1, "second", "jobs"), ("databricks", 0, "first", "jobs\\s+list")]
    assert decide("databricks", "x jobs list", "x jobs", rules=rules) == ["platform:databricks:first", "platform:databricks:second"]
    assert decide("glue", "databricks jobs delete 1") == ["pass"]


def test_rule_parity(spark):
    rules = guard_rules(spark)
    assert commands.guard_rule_parity(rules, rules).count() == 0
    weaker = rules.where("rule <> 'drop-task'")
    assert tuples(commands.guard_rule_parity(weaker, rules), "kind", "only_in") == [("snowflake_tasks", "b")]


def test_stream_replays_into_the_same_folder(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    lines = [{"event_id": i, "ts": "2024-01-01T00:00:00", "repo": "r", "kind": "databricks", "tool_name": tool, "tool_input": {"command": cmd}, "cwd": ""}
             for i, (tool, cmd) in enumerate([("Bash", "databricks jobs delete 1"), ("Read", "x"), ("Bash", " "), ("Bash", "snow sql -f deploy.sql")])]
    (events / "a.json").write_text("\n".join(map(json.dumps, lines)))
    files = spark.createDataFrame(SQL_FILES, "repo string, path string, text string, n_bytes long")
    verdicts = SqlVerdicts(spark, str(tmp_path / "verdicts"))
    verdicts.update(files, lambda wanted: files)
    out = str(tmp_path / "out")
    for attempt in range(2):  # a lost checkpoint replays batch 0
        stream = source.load_commands(spark, str(events), streaming=True)
        command_audit_stream(stream, verdicts, out, str(tmp_path / f"state{attempt}")).awaitTermination()
        assert tuples(spark.read.parquet(out), "event_id", "reason", "batch_id") == [(0, "platform:databricks:jobs-delete", 0), (3, "warehouse:snow:DROP", 0)]


def test_a_batch_of_changes_reads_only_the_files_it_names(spark, tmp_path):
    texts = {f"sql/f{i}.sql": "drop table t" if i % 2 else "select 1" for i in range(40)}
    asked: list[list[str]] = []

    def read(wanted):
        asked.append([p for p, in tuples(wanted, "path")])
        return spark.createDataFrame([("r", p, texts[p]) for p in asked[-1] if p in texts], "repo string, path string, text string")

    def changed(name, *paths):
        (tmp_path / "changes").mkdir(exist_ok=True)
        (tmp_path / "changes" / f"{name}.json").write_text("\n".join(json.dumps({"repo": "r", "path": p}) for p in paths))
        stream = source.load_file_changes(spark, str(tmp_path / "changes"), streaming=True)
        sql_verdict_stream(stream, read, verdicts, str(tmp_path / "state")).awaitTermination()
        return dict(tuples(verdicts.of(spark.createDataFrame([("r", p) for p in texts] + [("r", "sql/gone.sql")], "repo string, path string")), "path", "verb"))

    verdicts = SqlVerdicts(spark, str(tmp_path / "verdicts"))
    nothing = spark.createDataFrame([("r", "sql/f1.sql")], "repo string, path string")
    assert verdicts.of(nothing).count() == 0
    texts["sql/gone.sql"] = "truncate t"
    want = {p: "DROP" if "drop" in t else "TRUNCATE" if "trunc" in t else None for p, t in texts.items()}
    assert changed("1", *texts) == want
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "verdicts").rglob("*.parquet")}
    texts["sql/f2.sql"] = "grant all on t"
    del texts["sql/gone.sql"]
    del want["sql/gone.sql"]
    assert changed("2", "sql/./f2.sql", "x/../sql/gone.sql") == {**want, "sql/f2.sql": "GRANT"}
    assert asked[1:] == [["sql/f2.sql", "sql/gone.sql"]]
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "verdicts").rglob("*.parquet")}
    assert len({p.parent for p, _ in before.items() ^ after.items()}) <= 2 < len({p.parent for p in after})
    one = verdicts.of(nothing)
    assert one.select(F.input_file_name()).distinct().count() == 1 and ("sql/f1.sql", "DROP") in tuples(one, "path", "verb")


def test_no_event_is_lost_or_merged(spark):
    """Equal events, events of one id in different folders, and null ids."""
    from fleetlens.sources.schemas import COMMAND

    rows = [(1, None, "r", "dbt", cwd, "snow sql -f x.sql -f deploy.sql") for cwd in ("", "sub", "sub", "sub")]
    rows += [(None, None, "r", "dbt", None, "snow sql -f sub/x.sql")] * 2 + [(2, None, "r", "dbt", "", "ls")] * 2
    files = spark.createDataFrame(SQL_FILES, "repo string, path string, text string, n_bytes long")
    got = commands.command_audit(spark.createDataFrame(rows, COMMAND), files).fillna({"event_id": -1}).fillna("pass", ["reason"])
    assert tuples(got, "event_id", "reason") == sorted(
        [(1, "warehouse:snow:DROP")] + [(1, "warehouse:snow:REVOKE")] * 3 + [(-1, "warehouse:snow:REVOKE")] * 2 + [(2, "pass")] * 2
    )


def test_only_real_edits_below_the_jobs_folder_refresh(spark):
    paths = ["jobs/JOB-1_A/a.py", "./jobs/x.sql", "src/../jobs/y", "jobsX/JOB-1/a.py", "jobs/JOBS.md", "jobs/graph/J.md", "jobs/objects/o.md",
             "jobs/JOB-1_A/graph/n.md", "jobs/../lib/a.py", "jobs", "jobs/JOB-2/index_data.json"]
    changes = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    assert [p for p, in tuples(catalog_refresh.catalog_edits(changes), "path")] == sorted(["jobs/JOB-1_A/a.py", "jobs/x.sql", "jobs/y", "jobs/JOB-1_A/graph/n.md"])


def test_edits_are_judged_by_each_repositorys_own_folder(spark):
    paths = ["etl/work/JOB-1/a.py", "etl/work/graph/J.md", "jobs/JOB-1/a.py", "jobs/graph/J.md"]
    changes = spark.createDataFrame([(r, p) for r in ("own", "plain", "unknown") for p in paths], "repo string, path string")
    config = spark.createDataFrame([("own", ("etl/work/",)), ("plain", (None,))], "repo string, project struct<jobs_dir string>")
    want = [("own", "etl/work/JOB-1/a.py"), ("plain", "jobs/JOB-1/a.py"), ("unknown", "jobs/JOB-1/a.py")]
    assert tuples(catalog_refresh.catalog_edits(changes, config=config), "repo", "path") == want


# Secrets -------------------------------------------------------------------------------------------
#: Assembled here, so that this file holds none of the shapes.
SHAPED = {
    "cloud account ID": ["acct=" + "9" * 11 + "7", "(" + "40" * 6 + ")"],
    "AWS access key ID": ["id " + "AKIA" + "Q7" * 8],
    "Slack token": ["xox" + "r-" + "Zz9" * 4],
    "GitHub PAT": ["gh" + "u_" + "x7Y" * 12],
    "Slack channel/user ID": ["#" + "C0" + "ZK9" * 3],
    "private key": ["-----BEGIN " + "EC PRIVATE KEY-----"],
    "local home path": ["open /Users" + "/m.lee/notes"],
    "email address": ["ops+night@" + "plant-7.coop", "q@testing" + ".dev"],
    "non-placeholder ticket key": ["see W" + "H-4021."],
}
FINE = ["JOB-1234 DAG-7 ABC-42 ENG-1 PROJ-2", "t@example.com u@test.x", "1234567890123", "é12345" + "6789012", "xC0" + "12345678", "XBI-813456"]


def test_every_shape_fires_and_placeholders_do_not(spark):
    lines = [(label, v) for label, values in SHAPED.items() for v in values] + [("fine", v) for v in FINE]
    files = spark.createDataFrame([("r", f"f{i}", f"first\n  {v}  \n") for i, (_, v) in enumerate(lines)], "repo string, path string, text string")
    got = {}
    for row in secrets.secret_shape_scan(files).collect():
        got.setdefault(int(row.path[1:]), []).append(row.shape)
        assert row.line_no == 2 and row.snippet == lines[int(row.path[1:])][1].strip()
    assert {i: set(s) for i, s in got.items()} == {i: {label} for i, (label, _) in enumerate(lines) if label != "fine"}


def test_shapes_agree_with_their_plain_patterns(spark):
    """The rewritten patterns find what the plain ones find, on random text."""
    import random

    plain = {
        "cloud account ID": r"\b[0-9]{12}\b", "Slack channel/user ID": r"\bC0[0-9A-Z]{8,}\b",
        "email address": r"[a-zA-Z0-9._%+-]+@(?!example\.(?:com|org|net)\b)(?!test\b)(?!invalid\b)(?!localhost\b)[a-zA-Z0-9-]+\.[a-zA-Z]{2,}",
        "non-placeholder ticket key": r"\b(?!JOB-|DAG-|ABC-|ENG-|PROJ-)[A-Z]{2,6}-[0-9]{1,5}\b",
    }
    rnd = random.Random(7)
    pieces = ["JOB-", "AB-", "ABCDEFG-", "12", "123456789012", "é", "_", "C0", "ABCD1234", "@", "example", ".com", "test", ".", " ", "²", "x", "localhost", "PROJ-1"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, path string, text string")
    got = {(int(r.path), r.shape) for r in secrets.secret_shape_scan(df).collect() if r.shape in plain}
    want = {(i, label) for i, t in enumerate(texts) for label, p in plain.items() if re.search(p, t)}
    assert got == want


def test_denylist_gives_the_place_only(spark):
    files = spark.createDataFrame([("r", "a.py", "x = Internal_Thing\nother"), ("r", ".git/x", "internal_thing"), ("r", "a.PNG", "internal_thing")], "repo string, path string, text string")
    terms = secrets.read_denylist(["# a comment", "", " internal_thing ", "th.ng"])
    assert tuples(secrets.denylist_scan(secrets.scannable(files), terms)) == [("r", "a.py", 1, 2)]
    assert secrets.denylist_scan(files, []).count() == 0
    many = [f"none{i}" for i in range(250)] + ["other"]
    assert tuples(secrets.denylist_scan(secrets.scannable(files), many)) == [("r", "a.py", 2, 1)]


def test_denylist_as_a_table(spark):
    """Equal to the list of patterns, whatever parts of them are literal, and per repository."""
    import random

    terms = ["corp\\.io", "old\\.gone", "erion|eaux", "th.ng", "a+bcde", "x?yzzy", "(ab|cd)efgh", "[xy]z{2,3}wxyz", "stra\u00dfe", "\\bfoo\\b", "ab", "q\\|rstu", "k{0}lmno|pqrs", "caf\u00e9s?", "end$", "\u03c3\u03bf\u03c6\u03bf\u03c2"]
    draw = random.Random(2)
    bits = ["corp.io", "CORP.IO", "corpxio", "old.gone", "eriON", "eaux", "thing", "aabcde", "yzzy", "abefgh", "cdEFGH", "xzzwxyz", "STRASSE", "STRA\u00dfE", "foo", "food", "AB", "q|rstu", "lmno", "pqrs", "caf\u00e9", "Caf\u00c9S", "end", "\u03a3\u039f\u03a6\u039f\u03a3", " ", "\n", "\u0130", "z"]
    files = spark.createDataFrame([(f"r{i % 2}", f"f{i}", "".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))) for i in range(600)], "repo string, path string, text string")
    table = spark.createDataFrame([(None, t) for t in [*terms, *terms, ""]], "repo string, term string")
    assert tuples(secrets.denylist_table_scan(files, table)) == tuples(secrets.denylist_scan(files, terms))
    own = spark.createDataFrame([("r0", "eaux"), ("r1", "foo"), ("r9", "z")], "repo string, term string")
    want = sorted(tuples(secrets.denylist_scan(files.where("repo = 'r0'"), ["eaux"])) + tuples(secrets.denylist_scan(files.where("repo = 'r1'"), ["foo"])))
    assert tuples(secrets.denylist_table_scan(files, own)) == want and want
    # Pieces are literal texts of every alternative; a term without one is tested everywhere.
    pieces = dict(tuples(secrets.denylist_pieces(table).where("term in ('ab', 'x?yzzy', 'th.ng')").fillna("-"), "term", "piece"))
    assert pieces == {"ab": "-", "x?yzzy": "YZZY", "th.ng": "-"}


def test_a_hundred_thousand_denied_terms(spark):
    terms = spark.range(100_000).selectExpr("cast(null as string) as repo", "concat('term', id, 'x') as term")
    files = spark.createDataFrame([("r", "a", "see TERM77x and term99999x\nnothing\nterm100000x")], "repo string, path string, text string")
    assert tuples(secrets.denylist_table_scan(files, terms)) == [("r", "a", 1, 2)]


# Configuration ---------------------------------------------------------------------------------------
def test_field_violations(config):
    good = {"schema_version": 1, "platform": {"kind": "dbt", "deploy_model": "git-sync"}, "project": {"ticket_url_template": "https://x/{id}"}}
    assert config_audit.config_field_violations(config(good)).count() == 0
    bad = {
        "schema_version": 2, "project": {"key_prefixes": ["A B"], "jobs_dir": "/abs", "ticket_url_template": "https://x"},
        "platform": {"kind": "cron", "job_def_dirs": {"e v": "../x"}, "profile": "p;q", "dags_dir": "a b"}, "warehouse": {"dialect": "oracle"},
        "architecture": {"layers": ["1x"], "layer_rules": {"a-b": ["ok", "n o"]}, "deprecated_schema_deny": ["a.b"], "read_exceptions": ["A.X*", "*.B", "A.*"], "replace_hints": {"a b": "x"}},
    }
    got = tuples(config_audit.config_field_violations(config(bad)), "field", "value", "rule")
    assert got == sorted([
        ("schema_version", "2", "schema version"), ("project.key_prefixes[]", "A B", "name"), ("project.jobs_dir", "/abs", "relpath"),
        ("project.ticket_url_template", "https://x", "url template"), ("platform.kind", "cron", "platform kind"),
        ("platform.deploy_model", "", "required"), ("platform.job_def_dirs key", "e v", "name"), ("platform.job_def_dirs[]", "../x", "relpath"),
        ("platform.profile", "p;q", "name"), ("platform.dags_dir", "a b", "relpath"), ("warehouse.dialect", "oracle", "dialect"),
        ("architecture.layers[]", "1x", "identifier"), ("architecture.layer_rules key", "a-b", "identifier"), ("architecture.layer_rules[]", "n o", "identifier"),
        ("architecture.deprecated_schema_deny[]", "a.b", "identifier"), ("architecture.read_exceptions[]", "*.B", "fqn"), ("architecture.read_exceptions[]", "A.*", "fqn"), ("architecture.replace_hints key", "a b", "hint key"),
    ])


def test_cross_checks_and_models(spark, config):
    conf = lambda kind, model, dirs, dags: config({"platform": {"kind": kind, "deploy_model": model, "job_def_dirs": dirs, "dags_dir": dags}})
    errors = lambda *a: [e for e, in tuples(config_audit.config_cross_check(conf("dbt", *a)), "error")]
    assert errors("git-sync", {"prod": "x"}, "") == ["dags_dir missing on git-sync", "job_def_dirs set on git-sync"]
    assert errors("sql-ddl", {}, "dags") == ["dags_dir set on sql-ddl", "job_def_dirs missing on sql-ddl"]
    assert errors("git-sync", None, "dags") == [] and errors("api-reset", {"prod": "x"}, None) == []
    model = lambda k, m: tuples(config_audit.deploy_model_mismatch(conf(k, m, {}, ""), platform_dim(spark)), "error")
    assert model("databricks", "git-sync") == [("deploy_model mismatch",)] and model("glue", "api-reset") == [("no adapter",)] and model("dbt", "git-sync") == []


def test_inference(spark):
    tree = {
        "a": {"dbt_project.yml": "", "dags/x.py": "import airflow", "jobs/ETL-1_Load/a.py": "", "jobs/AB-2_x/a.py": "", ".hid/job_definitions/p/x.json": ""},
        "b": {"x/job_definitions/prod/a.json": "", "x/job_definitions/de v/b.json": "", "databricks.yml": "", "z/CREATE.sql": "create  task t", "work/J-1_x/f": ""},
        "c": {"y/job_definitions/all.json": "", "sql/a.sql": "CREATE OR REPLACE TASK t", "node_modules/job_definitions/p/q": "", "jobs/J-1_x": ""},
        "d": {"readme": "airflow"}, "e": {"q/a.sql": "-- create\ncreate task t", "build/b.sql": "create task t", "dags/a.txt": "airflow"},
    }
    listing = spark.createDataFrame([(r, p, t) for r, fs in tree.items() for p, t in fs.items()], "repo string, path string, text string")
    best = inference.platform_inference(listing).withColumn("evidence", F.array_join("evidence", "|"))
    assert tuples(best) == [
        ("a", "dbt", 3, "dbt_project.yml in repo root"),
        ("b", "databricks", 5, "a job_definitions/ dir in the repo|databricks/ in repo root"),
        ("c", "databricks", 3, "a job_definitions/ dir in the repo"),
        ("e", "snowflake_tasks", 3, "CREATE TASK in q/a.sql"),
    ]
    assert tuples(inference.layout_inference(listing)) == [
        ("a", "jobs_dir", "", "jobs"), ("a", "key_prefix", "", "AB"), ("a", "key_prefix", "", "ETL"),
        ("b", "job_def_dir", "prod", "x/job_definitions/prod"), ("b", "jobs_dir", "", "work"), ("b", "key_prefix", "", "J"),
        ("c", "job_def_dir", "prod", "y/job_definitions"), ("c", "jobs_dir", "", "jobs"), ("d", "jobs_dir", "", "jobs"), ("e", "jobs_dir", "", "jobs"),
    ]
