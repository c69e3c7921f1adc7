from __future__ import annotations

from conftest import tuples
from pyspark.sql import functions as F

from fleetlens.functions import text as X
from fleetlens.operators import extract
from fleetlens.sources.policy import load_policy


def deny_of(config, *terms):
    return load_policy(config({"architecture": {"deprecated_schema_deny": list(terms)}}))["deny"]


def test_lines_end_like_text_lines_do(files):
    texts = {"a.sql": "x\n\ny\n", "b.sql": "", "c.sql": "\n", "d.sql": "a\x0bb\x0cc\x1cd\x85e f", "e.sql": "no end", "f.sql": "a\r\nb"}
    got = tuples(extract.source_lines(files(texts)), "path", "line_no", "line")
    want = [(f"jobs/JOB-1_A/{p}", i + 1, line) for p, t in texts.items() for i, line in enumerate(t.splitlines())]
    assert got == sorted(want)


def test_objects_skip_imports_and_comments(files):
    code = "\n".join([
        "from slack_sdk.errors import X",
        "#   from slack_sdk.errors import X",
        'q = "SELECT * FROM Raw.Events"  # from legacy.old_thing',
        "import os",
        "os.path.join(a)",
        "select 1 from a.b -- join c.dd",
    ])
    assert tuples(extract.object_refs(files({"a.py": code})), "object") == [("Raw.Events",)]
    assert tuples(extract.object_refs(files({"a.py": "JOIN db.sch.obj x"})), "object") == [("db.sch.obj",)]


def test_first_casing_is_sql_before_py_then_path_then_text(files):
    df = files({"z.sql": "from raw.tab", "b/a.sql": "from RAW.TAB", "b-a.sql": "from Raw.Tab", "a.py": "from rAW.tAB"})
    # 'b' sorts before 'b-a.sql' folder by folder
    assert tuples(extract.object_refs(df), "object") == [("RAW.TAB",)]


def test_all_names_of_a_folder_are_kept(files):
    refs = [f"raw.t_{i:03d}" for i in range(60)]
    df = files({"a.sql": "\n".join(f"from {r}" for r in reversed(refs)), "JOB-2_B/a.sql": "from x.yy"})
    got = tuples(extract.object_refs(df), "job_dir", "object")
    assert got == [("JOB-1_A", r) for r in refs] + [("JOB-2_B", "x.yy")]


def test_mentions_anywhere_in_configured_casing(files, config):
    df = files({"a.sql": "-- see legacy_store.events\nselect LEGACY_STORES, xLEGACY_STORE, A$B_C, Q$A"})
    assert tuples(extract.deprecated_mentions(df, deny_of(config, "Legacy_Store", "OTHER")), "term") == [("Legacy_Store",)]
    assert tuples(extract.deprecated_mentions(df, deny_of(config, "a$b_c", "B_C", "a$b", "Q$A$")), "term") == [("B_C",), ("a$b_c",)]
    assert tuples(extract.deprecated_mentions(df, deny_of(config)), "term") == []
    # Neither can be a schema's name; their first words are not denied.
    assert tuples(extract.deprecated_mentions(files({"a.sql": "old news, OLD.GONE OLD-STORE"}), deny_of(config, "OLD.GONE", "OLD-STORE", "", "news")), "term") == [("news",)]


def test_mentions_agree_however_many_words_are_denied(files, config):
    df = files({"a.sql": "raw.x OLD.y", "JOB-2_B/b.py": "old news é_raw raw²"})
    deny = deny_of(config, "RAW", "Old", "N$X")
    want = [("JOB-1_A", "Old"), ("JOB-1_A", "RAW"), ("JOB-2_B", "Old")]
    assert tuples(extract.deprecated_mentions(df, deny), "job_dir", "term") == want
    accented = files({"a.sql": "select 1 from été.x", "JOB-2_B/b.py": "tété"})
    for more in (0, 58, 1098):
        many = deny_of(config, "ÉTÉ", "Old", *[f"W{i}" for i in range(more)])
        assert tuples(extract.deprecated_mentions(accented, many), "job_dir", "term") == [("JOB-1_A", "ÉTÉ")]


def test_headers_come_from_the_first_notebook_with_any(files):
    df = files({
        "a.py": "x = 1", "b.py": "# STATUS: ACTIVE\n# STATUS: OLD\n", "c.py": "# LAST_UPDATED: 2020",
        "JOB-2_B/lib/a.py": "# STATUS: NO", "JOB-3_C/a.py": "\n" * 60 + "# STATUS: LATE",
        "JOB-4_D/a.py": "# STATUS:\n# LAST_UPDATED: 1",
    })
    assert tuples(extract.notebook_headers(df), "job_dir", F.coalesce("status", F.lit("-")), F.coalesce("last_updated", F.lit("-"))) == [
        ("JOB-1_A", "ACTIVE", "-"), ("JOB-3_C", "LATE", "-"), ("JOB-4_D", "# LAST_UPDATED: 1", "-"),
    ]


def test_job_facts_agree_with_the_single_operators(files, config):
    df = files({
        "a.py": "# STATUS: ACTIVE\nq = 'from raw.tab join OLD.tab'", "s.sql": "update raw.TAB", "JOB-2_B/x.sql": "select 1",
    })
    deny = deny_of(config, "OLD")
    [row] = extract.job_facts(df, deny).collect()
    assert (row.status, row.last_updated, row.objects, row.flags) == ("ACTIVE", None, ["OLD.tab", "raw.TAB"], ["OLD"])


def test_policy_refs_keep_comments_and_drop_quotes(files):
    df = files({"a.sql": 'SELECT * FROM "LEGACY_STORE".T\n-- merge  into `p`.`d`.`t` from a.b\nfrom os.path import join'})
    assert tuples(extract.policy_refs(df), "line_no", "occ", "ref") == [
        (1, 0, "LEGACY_STORE.T"), (2, 0, "p.d.t"), (2, 1, "a.b"),
    ]


def test_declared_layer_is_the_first(files):
    df = files({"a.py": "x\n  # LAYER = marts\n# LAYER: RAW", "b.py": "#LAYERS: X"})
    assert tuples(extract.declared_layer(df), "path", "layer") == [("jobs/JOB-1_A/a.py", "MARTS")]


def test_doc_fields_may_run_into_the_next_line(spark):
    doc = "# Intro\n# Job: Load x \n**Purpose**:\n**Schedule**: daily \n**Business Owner**: Team A\n"
    df = spark.createDataFrame([("r", "j", doc, "h")], "repo string, job_dir string, text string, content_sha256 string")
    [row] = extract.job_doc_fields(df).collect()
    assert (row.name, row.purpose, row.schedule, row.owner, row.status) == ("Load x", "**Schedule**: daily", "daily", "Team A", None)


def test_installs(files):
    df = files({"a.py": "# MAGIC %pip install -q Foo_Bar[x]==1.2 pip baz==dev a..b\npip INSTALL c==2\nx = 'pip install no'", "b.sql": "pip install d==1"})
    got = tuples(extract.pip_requirements(df).fillna("-"), "package", "version")
    assert got == [("a-b", "-"), ("c", "2"), ("foo-bar", "1.2")]


def test_syntax_tolerates_magic_only(files):
    df = files({
        "good.py": "%pip install pandas==2.0.0\nimport pandas as pd\n!ls\npip install x\n", "bad.py": "x = 1\ndef f(:\n    pass\n", "q.sql": "def f(:",
        "nul.py": "x = 1\x00",
    })
    got = tuples(extract.syntax_findings(df), "path", "line")
    assert [p for p, _ in got] == ["jobs/JOB-1_A/bad.py", "jobs/JOB-1_A/nul.py"] and got[0][1] == 2


def test_expressions(spark):
    df = spark.createDataFrame([("JOB-12_X", "a" * 179 + " tail", "DB.MARTS.V", "a b/é+*~.md")], "d string, long string, o string, p string")
    row = df.select(
        X.job_key(F.col("d")).alias("key"), X.key_number(F.lit("JOB-0012")).alias("num"), X.key_number(F.lit("x")).alias("none"),
        X.key_number(F.lit("JOB-" + "9" * 25)).alias("huge"), X.schema_part(F.col("o")).alias("layer"), X.schema_part(F.lit("bare")).alias("bare"),
        X.node_id(F.lit("a:b\\c/d")).alias("node"), X.url_path(F.col("p")).alias("url"), X.table_cell(F.lit(" a|b\nc ")).alias("cell"),
        X.job_key(F.lit("my.JOB-7"), F.array(F.lit("y."), F.lit("OB"))).alias("prefixed"),
        X.distinct_fold_case(F.array(F.lit("b"), F.lit("A"), F.lit("a"), F.lit("B"))).alias("folded"),
    ).collect()[0]
    assert row.key == "JOB-12" and tuple(row.num) == (2, "12") and tuple(row.none) == (0, "")
    assert row.none < row.num < row.huge and tuple(row.huge) == (25, "9" * 25) and row.layer == "MARTS" and row.bare == "object"
    assert row.node == "a.b.c.d" and row.url == "a%20b/%C3%A9%2B%2A~.md" and row.cell == "a\\|b c"
    assert row.prefixed == "OB-7" and row.folded == ["A", "b"]
