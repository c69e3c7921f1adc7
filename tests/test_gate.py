"""The gate reads every text twice: for patterns and for Python's parser."""

from __future__ import annotations

from conftest import tuples

from fleetlens.operators import catalog, compliance, docs, extract
from fleetlens.plans import gate_run
from fleetlens.sources import schemas
from fleetlens.sources.policy import policy_rows, required_fields

TEXTS = {
    "a.py": "# JOB: 1\n# LAYER: STAGING\nfrom raw import x\nq = 'select * from RAW.t1 join MARTS.t2'  # from old.gone\n%pip install a==1.0 b\ndef f(:",
    "b.sql": "select * from OLD.t;\r\nupdate `Old`.\"x\" -- delete from staging.yy",
    "lib/c.py": "# STATUS: x\n!ls\nx = 1\n# MAGIC %pip install c==2\n", "empty.sql": "select 1", "note.md.py": "\x00",
    "JOB-2_B/a.py": "# JOB : 2\n#STATUS = 3", "JOB-2_B/q.sql": "merge into old.q",
}


def test_facts_say_what_each_check_reads_off_the_text(files, config):
    src = files(TEXTS).repartition(3)
    facts = extract.file_facts(src).persist()
    columns = ("repo", "job_dir", "path", "layer", "line_no", "occ", "ref")
    assert tuples(extract.policy_refs_of(facts).fillna("-"), *columns) == tuples(extract.policy_refs(src).fillna("-"), *columns)
    assert tuples(extract.requirements(facts.where("installs is not null")).fillna("-")) == tuples(extract.pip_requirements(src).fillna("-"))
    names = lambda df: tuples(df.selectExpr("path", "array_join(array_sort(names), ',') as n"))
    assert names(facts.where("names is not null")) == names(docs.notebook_names(src))
    assert "empty.sql" not in [p.rsplit("/", 1)[1] for p, in tuples(facts, "path")]
    rules = policy_rows(config({"architecture": {"deprecated_schema_deny": ["OLD"], "layer_rules": {"STAGING": ["RAW"]}}}))
    assert tuples(compliance.arch_findings(extract.policy_refs_of(facts), rules)) == tuples(compliance.arch_findings(extract.policy_refs(src), rules))


def test_gate_scans_texts_twice(spark, files, config):
    src = files(TEXTS)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    scanned = src.mapInArrow(counted, src.schema)
    conf = config({"architecture": {"deprecated_schema_deny": ["OLD"]}, "platform": {"kind": "databricks", "deploy_model": "git-sync"}, "governance": {"header_required": ["JOB", "A:B"]}})
    folders = catalog.job_folders(src)
    none = lambda schema: spark.createDataFrame([], schema)
    advisory = spark.createDataFrame([("a", "1.0", "V1"), ("a", "1.0", "V2")], "package string, version string, vuln_id string")
    checks = gate_run.run_checks(folders, scanned, none(schemas.JOB_DOC), none(schemas.JOB_DEF), conf, advisory, advisory.limit(0))
    rows = {(r.job_dir, r.check): (r.ok, r.n_problems) for r in gate_run.job_gate(folders, checks).collect()}
    details = gate_run.gate_details(checks).collect()
    assert read.value == 2 * src.count()
    assert rows["JOB-1_A", "notebook_syntax"] == (False, 2) and rows["JOB-1_A", "dependency_vulns"] == (False, 1)
    assert rows["JOB-2_B", "architecture"] == (True, 0) and rows["JOB-2_B", "documentation"] == (False, 2)
    assert sum(d["check"] == "dependency_vulns" for d in details) == 2 and required_fields(conf).count() == 1
