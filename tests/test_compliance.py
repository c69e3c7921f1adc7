from __future__ import annotations

from conftest import tuples
from pyspark.sql import functions as F

from fleetlens.operators import compliance, dependencies, docs, extract, gate
from fleetlens.sources.policy import policy_rows, required_fields


def findings(files, config, texts, **architecture):
    return compliance.arch_findings(extract.policy_refs(files(texts)), policy_rows(config({"architecture": architecture})))


def test_deprecated_with_hint_and_quotes(files, config):
    got = findings(
        files, config, {"x.sql": 'SELECT * FROM "LEGACY_STORE".T\nfrom legacy_store.u join a.b'},
        deprecated_schema_deny=["Legacy_Store"], replace_hints={"legacy_store": "MARTS.V", "LEGACY_STORE.T": "X.Y"},
    )
    assert tuples(got, "line", "ref", "schema", "kind", "message") == [
        (1, "LEGACY_STORE.T", "LEGACY_STORE", "deprecated", "references deprecated schema LEGACY_STORE — migrate to X.Y"),
        (2, "legacy_store.u", "LEGACY_STORE", "deprecated", "references deprecated schema LEGACY_STORE — migrate to MARTS.V"),
    ]


def test_first_denied_part_and_sanctioned_reads(files, config):
    got = findings(
        files, config, {"x.sql": "from B.A.t\nfrom A.ok\nfrom a.B.x"},
        deprecated_schema_deny=["A", "B"], read_exceptions=["a.OK"],
    )
    assert tuples(got, "line", "schema", "message") == [
        (1, "B", "references deprecated schema B"), (3, "A", "references deprecated schema A"),
    ]


def test_layer_rule_needs_a_declared_layer(files, config):
    rules = {"layer_rules": {"Marts": ["STAGING", "marts"], "EMPTY": []}}
    text = "FROM RAW.EVENTS\nFROM staging.a\nFROM db.marts.b"
    got = findings(files, config, {"a.py": "# LAYER: MARTS\n" + text, "b.py": text, "c.py": "# LAYER: none\n" + text, "d.py": "# LAYER: Empty\nFROM x.y"}, **rules)
    assert tuples(got, "file", "line", "schema", "message") == [
        ("jobs/JOB-1_A/a.py", 2, "RAW", "layer MARTS may not reference RAW (allowed: ['MARTS', 'STAGING'])"),
        ("jobs/JOB-1_A/d.py", 2, "X", "layer EMPTY may not reference X (allowed: none)"),
    ]


def test_imports_are_no_references(files, config):
    assert findings(files, config, {"a.py": "from os.path import join\n"}, deprecated_schema_deny=["OS"]).count() == 0


def test_deprecated_references_are_debt(files, config):
    got = compliance.compliance_summary(findings(
        files, config, {"a.sql": "# LAYER: M\nfrom OLD.t", "JOB-2_B/a.sql": "# LAYER: M\nfrom x.t\nfrom OLD.x"},
        deprecated_schema_deny=["OLD"], layer_rules={"M": ["M"]},
    ))
    assert tuples(got, "job_dir", "n_violations", "n_deprecated", "ok") == [("JOB-1_A", 0, 1, True), ("JOB-2_B", 1, 1, False)]


def folders_of(spark, *dirs):
    return spark.createDataFrame([("r", d, d.split("_")[0]) for d in dirs], "repo string, job_dir string, ticket string")


def test_doc_lint(spark, files, config):
    folders = folders_of(spark, "JOB-1_A", "JOB-2_B", "JOB-3_C")
    doc = spark.createDataFrame(
        [("r", "JOB-1_A", "**Purpose**:\n\n**Schedule**: x\n"), ("r", "JOB-2_B", "**Purpose**: a\n**Schedule**:  \n")],
        "repo string, job_dir string, text string",
    ).withColumn("content_sha256", F.lit("h"))
    src = files({
        "a.py": "# JOB: x", "b.py": "#STATUS = y\n# JOB : 1", "c.py": "# JOB: 1\n# TICKET: 2",
        "JOB-2_B/a.py": "\n" * 80 + "# JOB: late", "JOB-3_C/sub/a.py": "# JOB: x",
    })
    required = required_fields(config({"governance": {"claude_md_required": ["Purpose", "Schedule"], "header_required": ["JOB", "STATUS"]}}))
    assert tuples(docs.doc_lint(folders, doc, src, required), "job_dir", "problem") == [
        ("JOB-2_B", "claude.md missing **Schedule**"),
        ("JOB-2_B", "notebook header missing # STATUS"),
        ("JOB-3_C", "missing claude.md"), ("JOB-3_C", "no .py notebook found to check header"),
    ]
    [row] = docs.doc_coverage(folders, docs.doc_lint(folders, doc, src, required)).collect()
    assert (row.n_jobs, row.n_documented, row.n_without_doc, row.n_problems) == (3, 1, 1, 4)


def test_required_fields_that_no_single_pattern_spells(spark, files, config):
    folders = folders_of(spark, "JOB-1_A")
    doc = spark.createDataFrame([("r", "JOB-1_A", "")], "repo string, job_dir string, text string")
    src = files({"a.py": "# A:B: x\n# C.D = 1"})
    required = required_fields(config({"governance": {"claude_md_required": ["P"], "header_required": ["A:B", "C.D", "CxD"]}}))
    got = tuples(docs.doc_lint(folders, doc, src, required), "problem")
    assert got == [("claude.md missing **P**",), ("notebook header missing # CxD",)]


def test_pins_against_advisories(spark, files):
    pins = extract.pip_requirements(files({"a.py": "%pip install A_b==1.0 c==2 d"}))
    advisory = spark.createDataFrame([("a-b", "1.0", "V1"), ("a-b", "1.0", "V2"), ("c", "3", "V3")], "package string, version string, vuln_id string")
    allow = spark.createDataFrame([("a-b", "1.0", "V1")], advisory.schema)
    assert tuples(dependencies.vulnerable_pins(pins, advisory, allow), "package", "vuln_id") == [("a-b", "V2")]
    assert tuples(dependencies.unpinned_installs(pins), "package") == [("d",)]


def gate_rows(spark, files, **over):
    folders = folders_of(spark, "JOB-1_A")
    empty = lambda cols: spark.createDataFrame([], f"repo string, job_dir string, {cols}")
    counts = spark.createDataFrame([("r", "JOB-1_A", "JOB-1", "api-reset", 1)], "repo string, job_dir string, ticket string, deploy_model string, n_defs long")
    parts = {
        "syntax": empty("path string"), "definition_counts": counts, "definition_problems": empty("problem string"),
        "findings": empty("kind string"), "doc_problems": empty("problem string"), "vulnerable": None, **over,
    }
    rows = gate.job_gate(folders, files({"a.py": "x = 1"}), **parts).collect()
    return {r.check: (r.ok, r.detail) for r in rows}, {r.job_ok for r in rows}


def test_gate_passes_with_debt_and_fails_without_definition(spark, files):
    debt = spark.createDataFrame([("r", "JOB-1_A", "deprecated")], "repo string, job_dir string, kind string")
    checks, ok = gate_rows(spark, files, findings=debt)
    assert ok == {True} and checks["architecture"] == (True, "1 deprecated-schema ref(s) (migration debt, non-blocking)")
    assert checks["dependency_vulns"] == (True, "skipped (offline)") and checks["notebook_syntax"] == (True, "1 file(s) OK")
    for model, artifact in (("api-reset", "job-def JSON"), ("sql-ddl", "task DDL (*.sql)")):
        none = spark.createDataFrame([("r", "JOB-1_A", "JOB-1", model, 0)], "repo string, job_dir string, ticket string, deploy_model string, n_defs long")
        checks, ok = gate_rows(spark, files, definition_counts=none)
        assert ok == {False}
        assert checks["job_definitions"] == (False, f"REQUIRED {artifact} missing for JOB-1 (deploy_model={model})")
    git = spark.createDataFrame([("r", "JOB-1_A", "JOB-1", "git-sync", 0)], "repo string, job_dir string, ticket string, deploy_model string, n_defs long")
    checks, ok = gate_rows(spark, files, definition_counts=git)
    assert ok == {True} and checks["job_definitions"] == (True, "no definition file (not required for git-sync)")
