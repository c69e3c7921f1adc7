"""The per-job gate: five checks, every one reduced to one row per job before it is joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compliance import DEPRECATED, VIOLATION
from .definitions import artifact_name

JOB = ["repo", "job_dir"]
CHECKS = ["notebook_syntax", "job_definitions", "dependency_vulns", "architecture", "documentation"]


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def job_gate(
    folders: DataFrame,
    notebooks: DataFrame,
    syntax: DataFrame,
    definition_counts: DataFrame,
    definition_problems: DataFrame,
    findings: DataFrame,
    doc_problems: DataFrame,
    vulnerable: DataFrame | None = None,
) -> DataFrame:
    """One row per (job, check): (repo, job_dir, check, ok, n_problems, detail, job_ok). ``notebooks`` has a row for each parsed file. Without
    ``vulnerable`` the dependency check counts as skipped. Deprecated references never fail a job.
    The single problems are rows of :func:`gate_details`."""
    mark = lambda df, name: df.select(*JOB, name.alias("what") if isinstance(name, Column) else F.lit(name).alias("what"))
    found = [
        mark(notebooks, "n_files"),
        mark(syntax, "n_syntax"),
        mark(definition_problems, "n_def_problems"),
        mark(findings, F.when(F.col("kind") == VIOLATION, "n_violations").when(F.col("kind") == DEPRECATED, "n_debt")),
        mark(doc_problems, "n_doc"),
    ]
    if vulnerable is not None:
        found.append(mark(vulnerable.select(*JOB, "package", "version").distinct(), "n_vulnerable"))
    # Every check gives rows of one kind; they are counted together, merged before the one shuffle.
    names = ["n_files", "n_syntax", "n_def_problems", "n_violations", "n_debt", "n_doc", "n_vulnerable"]
    counted = reduce(DataFrame.unionByName, found).groupBy(*JOB).agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])
    rows = folders.join(definition_counts.select(*JOB, "deploy_model", "n_defs"), JOB, "left").join(counted, JOB, "left")

    model = F.col("deploy_model")
    needs_def = F.coalesce(model.isin("api-reset", "sql-ddl"), F.lit(False))
    missing = needs_def & (_n("n_defs") == 0)
    files_ok = lambda n: F.concat(n.cast("string"), F.lit(" file(s) OK"))
    bad = lambda n: F.concat(n.cast("string"), F.lit(" problem(s)"))

    def check(name: str, problems: Column, fine: Column, failing: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            (problems == 0).alias("ok"),
            problems.cast("bigint").alias("n_problems"),
            F.when(problems == 0, fine).otherwise(bad(problems) if failing is None else failing).alias("detail"),
        )

    def_problems = _n("n_def_problems") + missing.cast("int")
    def_fine = F.when(
        _n("n_defs") > 0,
        F.concat(F.col("n_defs").cast("string"), F.lit(" "), artifact_name(model), F.lit(" file(s) OK")),
    ).otherwise(F.concat(F.lit("no definition file (not required for "), F.coalesce(model, F.lit("?")), F.lit(")")))
    def_failing = F.when(
        missing,
        F.concat(
            F.lit("REQUIRED "), artifact_name(model), F.lit(" missing for "), "ticket",
            F.lit(" (deploy_model="), model, F.lit(")"),
        ),
    ).otherwise(bad(_n("n_def_problems")))
    debt = F.when(
        _n("n_debt") > 0,
        F.concat(_n("n_debt").cast("string"), F.lit(" deprecated-schema ref(s) (migration debt, non-blocking)")),
    ).otherwise(F.lit("clean"))
    if vulnerable is None:
        dependency = check("dependency_vulns", F.lit(0), F.lit("skipped (offline)"))
    else:
        dependency = check("dependency_vulns", _n("n_vulnerable"), F.lit("OK"))
    checks = F.array(
        check("notebook_syntax", _n("n_syntax"), files_ok(_n("n_files"))),
        check("job_definitions", def_problems, def_fine, def_failing),
        dependency,
        check("architecture", _n("n_violations"), debt),
        check("documentation", _n("n_doc"), F.lit("complete")),
    )
    return rows.select(*JOB, checks.alias("checks")).select(
        *JOB, F.forall("checks", lambda c: c["ok"]).alias("job_ok"), F.explode("checks").alias("c")
    ).select(*JOB, "c.check", "c.ok", "c.n_problems", "c.detail", "job_ok")


def gate_details(
    syntax: DataFrame,
    definition_problems: DataFrame,
    findings: DataFrame,
    doc_problems: DataFrame,
    vulnerable: DataFrame | None = None,
) -> DataFrame:
    """Every single problem behind a failed check: (repo, job_dir, check, detail)."""
    text = lambda *cols: F.concat(*[c.cast("string") for c in cols])
    c = F.col
    parts = [
        syntax.select(
            *JOB, F.lit(CHECKS[0]).alias("check"),
            text(c("path"), F.lit(":"), F.coalesce(c("line").cast("string"), F.lit("None")), F.lit(": "), c("msg")).alias("detail"),
        ),
        definition_problems.select(*JOB, F.lit(CHECKS[1]).alias("check"), c("problem").alias("detail")),
        findings.where(c("kind") == VIOLATION).select(
            *JOB, F.lit(CHECKS[3]).alias("check"),
            text(c("file"), F.lit(":"), c("line"), F.lit(" "), c("message")).alias("detail"),
        ),
        doc_problems.select(*JOB, F.lit(CHECKS[4]).alias("check"), c("problem").alias("detail")),
    ]
    if vulnerable is not None:
        parts.append(
            vulnerable.select(
                *JOB, F.lit(CHECKS[2]).alias("check"),
                text(c("package"), F.lit("=="), c("version"), F.lit(": "), c("vuln_id")).alias("detail"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
