"""One query per operator over the derived estate, for any scale of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import (
    catalog,
    commands,
    compliance,
    config_audit,
    definitions,
    dependencies,
    docs,
    drift,
    extract,
    freshness,
    graph,
    inference,
    rule_sets,
    runs,
    secrets,
)
from ..session import drop_path, scratch_dir, settle, tune
from ..sources import commands as command_source
from ..sources import files as file_source
from ..sources import listing, policy, sinks, snapshots
from ..sources.published import Published
from ..sources.trees import write_tree
from ..streaming import catalog_refresh
from ..streaming import command_audit as audit_stream
from . import catalog_build, drift_run, gate_run
from .estate import Estate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Estate(tune(spark), sf_dir))
    return fn


def joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


# Shared inputs -----------------------------------------------------------------------------------
def _sources(e: Estate) -> dict[str, DataFrame]:
    return {
        "folders": e.table("folder"), "files": e.files(), "docs": e.docs(), "job_def": e.definitions(),
        "enrichment": e.enrichment(), "config": e.config(),
    }


def _catalog(e: Estate) -> DataFrame:
    return catalog_build.build_catalog(**_sources(e))


def _settled_catalog(e: Estate) -> DataFrame:
    return settle(_catalog(e), "catalog-rows")


def _object_rows(e: Estate) -> DataFrame:
    return settle(catalog_build.build_object_rows(**_sources(e)), "object-rows")


def _flat_catalog(rows: DataFrame) -> DataFrame:
    return rows.withColumn("flags", joined("flags")).withColumn("objects", joined("objects"))


def _checks(e: Estate) -> gate_run.GateInputs:
    return gate_run.run_checks(
        e.table("folder"), e.files(), e.docs(), e.definitions(), e.config(), *_advisories(e)
    )


def _advisories(e: Estate) -> tuple[DataFrame, DataFrame]:
    known = e.table("advisory").withColumn("package", X.package_name(F.col("package")))
    return known, e.table("allow")


def _texts(e: Estate) -> DataFrame:
    """All running text of the given tables as files, plus the source files."""
    doc = e.given("documents").select(
        F.lit("documents").alias("repo"), F.concat(F.lit("d/"), "doc_id").alias("path"), "text"
    )
    page = e.given("pages").select(F.lit("pages").alias("repo"), F.concat(F.lit("p/"), "page_id").alias("path"), F.col("html").alias("text"))
    talk = e.given("conversations").select(
        F.lit("conversations").alias("repo"), F.concat(F.lit("c/"), "conv_id", F.lit("/"), "turn").alias("path"), "text"
    )
    return doc.unionByName(page).unionByName(talk).unionByName(e.table("src").select("repo", "path", "text"))


# Sources and sinks -------------------------------------------------------------------------------
@query
def scan_source_files(e: Estate) -> DataFrame:
    root = scratch_dir(e.spark, "sources")
    # Some sources keep their jobs in another folder.
    place = F.when(F.ascii(F.right("source", F.lit(1))) % 2 == 0, "jobs").otherwise("etl/work")
    doc = e.given("documents")
    config = doc.select(F.col("source").alias("repo"), F.struct(place.alias("jobs_dir"), F.array().cast("array<string>").alias("key_prefixes")).alias("project")).distinct()
    write_tree(
        doc.select(
            F.concat("source", F.lit("/"), place, F.lit("/JOB-"), "doc_id", F.lit("_Text/sub/t."),
                     F.when(F.col("lang") == "en", "py").otherwise("sql")).alias("path"),
            "text",
        ),
        root,
    )
    return file_source.scan_source_files(e.spark, [root], config=config)


@query
def tree_changes(e: Estate) -> DataFrame:
    """What a listing finds after some files of a tree were edited, some added, and one repository removed."""
    root = scratch_dir(e.spark, "listed")
    doc = e.given("documents").where("source is not null").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = lambda name: F.concat("source", F.lit("/jobs/JOB-"), "doc_id", F.lit(f"_Text/{name}")).alias("path")
    write_tree(doc.select(place("_t.sql"), "text"), root)
    before = file_source.list_job_files(e.spark, [root])
    write_tree(doc.where("doc_id % 3 = 0").select(place("_t.sql"), F.concat("text", F.lit(" ")).alias("text")), root)
    write_tree(doc.where("doc_id % 5 = 0").select(place("sub/n.sql"), "text"), root)
    drop_path(e.spark, f"{root}/{doc.agg(F.min('source')).first()[0]}")
    return listing.file_changes(before, file_source.list_job_files(e.spark, [root]))


@query
def scan_job_docs(e: Estate) -> DataFrame:
    root = scratch_dir(e.spark, "docs")
    doc = e.table("doc")
    write_tree(doc.select(F.concat("repo", F.lit("/jobs/"), "job_dir", F.lit("/claude.md")).alias("path"), "text"), root)
    return file_source.scan_job_docs(e.spark, [root])


@query
def scan_definitions(e: Estate) -> DataFrame:
    root = scratch_dir(e.spark, "definitions")
    own = e.definitions().where(F.col("side") == "repo")
    write_tree(own.select(F.concat_ws("/", "repo", "path").alias("path"), F.col("raw").alias("text")), root)
    found = file_source.scan_definitions(e.spark, [root], config=e.config())
    return definitions.with_errors(settle(definitions.describe(found), "definitions")).select(
        "repo", "job_key", "env", "path", "stem", "ext", "raw", "error_line", "name", "cron"
    )


#: Root folders of a tree of many repositories. Writers that add folders to one parent wait for each other, and one task lists it.
_ROOTS = 256


@query
def load_enrichment(e: Estate) -> DataFrame:
    base = scratch_dir(e.spark, "enrichment")
    root = F.pmod(F.xxhash64("repo"), F.lit(_ROOTS))
    write_tree(
        e.table("curated_doc").select(
            F.concat(root.cast("string"), F.lit("/"), "repo", F.lit("/jobs/index_data.json")).alias("path"), F.col("raw").alias("text")
        ),
        base,
    )
    return file_source.load_enrichment(e.spark, [f"{base}/*"]).select("repo", "ticket", "name", "summary", "owner")


def _live_export(e: Estate) -> DataFrame:
    live = e.table("live_job").join(e.table("conf").select("repo", "kind"), "repo")
    is_kind = lambda k: F.col("kind") == k
    cron = F.concat(F.lit("0 "), "job_id")
    pause = F.when(F.col("job_id").endswith("1"), "PAUSED").when(F.col("job_id").endswith("2"), "UNPAUSED")
    return live.select(
        "repo", "kind",
        F.when(is_kind("databricks"), F.col("job_id")).alias("job_id"),
        F.when(
            is_kind("databricks"),
            F.struct("name", F.struct(cron.alias("quartz_cron_expression"), pause.alias("pause_status")).alias("schedule")),
        ).alias("settings"),
        F.when(is_kind("airflow"), F.col("name")).alias("dag_id"),
        F.when(is_kind("airflow"), F.when(F.col("job_id").endswith("1"), "True").otherwise("False")).alias("paused"),
        F.when(~is_kind("databricks") & ~is_kind("airflow"), F.col("name")).alias("name"),
        F.when(is_kind("snowflake_tasks"), F.when(F.col("job_id").endswith("1"), "suspended").otherwise("started")).alias("state"),
        F.when(is_kind("snowflake_tasks"), cron).alias("schedule"),
    )


@query
def load_platform_snapshots(e: Estate) -> DataFrame:
    path = scratch_dir(e.spark, "live-jobs")
    _live_export(e).write.partitionBy("kind").json(path)
    return snapshots.load_live_jobs(e.spark, path)


@query
def load_platform_runs(e: Estate) -> DataFrame:
    path = scratch_dir(e.spark, "runs")
    run = e.runs()
    is_air, is_snow = F.col("kind") == "airflow", F.col("kind") == "snowflake_tasks"
    run.select(
        "repo", "kind", "job_key",
        F.when(~is_air & ~is_snow, F.col("run_id")).alias("run_id"), F.when(is_air, F.col("run_id")).alias("dag_run_id"),
        F.when(is_snow, F.col("run_id")).alias("QUERY_ID"),
        F.when(~is_air & ~is_snow, F.col("state")).alias("life_cycle"), F.when(is_air, F.col("state")).alias("state"),
        F.when(is_snow, F.col("state")).alias("STATE_NAME"),
        "result_state", F.date_format("started", "yyyy-MM-dd").alias("started"), "tasks", "logs", "error", "logs_truncated",
    ).write.partitionBy("kind").json(path)
    return snapshots.load_runs(e.spark, path).select(
        "repo", "kind", "job_key", "run_id", "started", "state", "result_state", "logs", "error"
    )


@query
def load_policy(e: Estate) -> DataFrame:
    rules = policy.load_policy(e.config())
    row = lambda t, a, b: rules[t].select(
        "repo", F.lit(t).alias("rule"), F.col(a).cast("string").alias("name"), F.col(b).cast("string").alias("value")
    )
    return (
        row("deny", "schema", "term")
        .unionByName(row("read_exception", "ref", "ref"))
        .unionByName(row("replace_hint", "target", "hint"))
        .unionByName(row("layer_rule", "layer", "allowed"))
        .unionByName(rules["doc_rule"].select("repo", F.concat(F.lit("doc_rule:"), "kind").alias("rule"), F.col("field").alias("name"), F.col("ord").cast("string").alias("value")))
    )


def _command_events(e: Estate) -> DataFrame:
    event = e.table("command")
    # Blank commands and other tools occur too; they are dropped on load.
    extra = event.select(
        "event_id", "ts", "repo", "kind",
        F.explode(F.array(
            F.struct(F.lit("Bash").alias("tool_name"), F.col("cmd").alias("command")),
            F.struct(F.lit("Read").alias("tool_name"), F.col("cmd").alias("command")),
            F.struct(F.lit("Bash").alias("tool_name"), F.lit("  ").alias("command")),
        )).alias("x"),
        "cwd",
    )
    return extra.select(
        "event_id", "ts", "repo", "kind", "x.tool_name", F.struct(F.col("x.command").alias("command")).alias("tool_input"), "cwd"
    )


def _write_commands(e: Estate) -> str:
    path = scratch_dir(e.spark, "commands")
    _command_events(e).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return path


@query
def load_commands(e: Estate) -> DataFrame:
    return command_source.load_commands(e.spark, _write_commands(e)).select("event_id", "ts", "repo", "kind", "cmd")


@query
def load_advisories(e: Estate) -> DataFrame:
    known, allowed = scratch_dir(e.spark, "advisories"), scratch_dir(e.spark, "allowed")
    e.table("advisory").select("package", "version", F.array(F.struct(F.col("vuln_id").alias("id"))).alias("vulns")).write.json(known)
    e.table("allow").select("package", "version", F.array("vuln_id").alias("vulns")).write.json(allowed)
    advisory, allow = snapshots.load_advisories(e.spark, known, allowed)
    return advisory.withColumn("source", F.lit("advisory")).unionByName(allow.withColumn("source", F.lit("allow")))


@query
def write_findings(e: Estate) -> DataFrame:
    path = scratch_dir(e.spark, "findings")
    found = _findings(e)
    sinks.write_findings(found, path)
    return e.spark.read.schema(found.schema).json(path).select("repo", "job_dir", "file", "line", "occ", "ref", "schema", "kind", "message")


def _published(fresh: DataFrame) -> DataFrame:
    """An older state of the catalog: some rows differ and some folders have another name."""
    old = F.regexp_extract("dir", r"^JOB-(\d+)", 1).cast("bigint")
    return fresh.withColumn("status", F.when(old % 5 == 0, F.lit("OLD")).otherwise(F.col("status"))).withColumn(
        "dir", F.when(old % 7 == 0, F.concat(F.lit("GONE-"), "dir")).otherwise(F.col("dir"))
    )


@query
def write_catalog(e: Estate) -> DataFrame:
    path = scratch_dir(e.spark, "catalog")
    fresh = _settled_catalog(e)
    sinks.publish_catalog(_published(fresh), path)
    sinks.write_catalog(fresh, path)
    return _flat_catalog(sinks.read_catalog(e.spark, path, sinks.fresh_schema(fresh)))


# Extraction --------------------------------------------------------------------------------------
@query
def source_lines(e: Estate) -> DataFrame:
    return extract.source_lines(_texts(e))


@query
def object_refs(e: Estate) -> DataFrame:
    return extract.object_refs(e.files())


@query
def policy_refs(e: Estate) -> DataFrame:
    return extract.policy_refs(e.files()).select("repo", "job_dir", "path", "line_no", "occ", "ref", joined("parts").alias("parts"))


@query
def deprecated_mentions(e: Estate) -> DataFrame:
    return extract.deprecated_mentions(e.files(), policy.load_policy(policy.config_of(e.config(), e.files()))["deny"])


@query
def job_doc_fields(e: Estate) -> DataFrame:
    return extract.job_doc_fields(e.docs())


@query
def notebook_headers(e: Estate) -> DataFrame:
    return extract.notebook_headers(e.files())


@query
def definition_schedule(e: Estate) -> DataFrame:
    return definitions.definition_schedule(definitions.describe(e.definitions()), e.config())


@query
def pip_requirements(e: Estate) -> DataFrame:
    return extract.pip_requirements(e.files())


@query
def syntax_findings(e: Estate) -> DataFrame:
    return extract.syntax_findings(e.files())


@query
def declared_layer(e: Estate) -> DataFrame:
    return extract.declared_layer(e.files())


# Catalog -----------------------------------------------------------------------------------------
@query
def job_catalog(e: Estate) -> DataFrame:
    return _flat_catalog(_catalog(e))


@query
def catalog_summary(e: Estate) -> DataFrame:
    return catalog.catalog_summary(settle(catalog_build.build_status_rows(**_sources(e)), "status-rows"))


@query
def object_index(e: Estate) -> DataFrame:
    return catalog.object_index(_object_rows(e))


@query
def object_index_ranks(e: Estate) -> DataFrame:
    """The same with each job's place among the jobs of its object."""
    return catalog.index_ranks(settle(catalog.object_index(_object_rows(e)), "index-rows"))


@query
def graph_job_nodes(e: Estate) -> DataFrame:
    return graph.graph_job_nodes(_settled_catalog(e))


@query
def graph_job_facets(e: Estate) -> DataFrame:
    return graph.graph_job_facets(_settled_catalog(e))


@query
def graph_object_nodes(e: Estate) -> DataFrame:
    return graph.graph_object_nodes(_settled_catalog(e))


@query
def graph_object_ranks(e: Estate) -> DataFrame:
    """The same with each ticket's place on its object."""
    return graph.node_ranks(settle(graph.graph_object_nodes(_settled_catalog(e)), "node-rows"))


@query
def graph_edges(e: Estate) -> DataFrame:
    return graph.graph_edges(catalog_build.build_object_rows(**_sources(e)))


def _edges(e: Estate) -> DataFrame:
    return settle(graph.graph_edges(catalog_build.build_object_rows(**_sources(e))), "edges")


@query
def related_jobs(e: Estate) -> DataFrame:
    edges = _edges(e)
    return graph.related_jobs(edges, graph.looked_up_jobs(edges))


@query
def shared_objects(e: Estate) -> DataFrame:
    edges = _edges(e)
    return graph.shared_objects(edges, graph.looked_up_jobs(edges))


@query
def migration_map(e: Estate) -> DataFrame:
    return catalog.migration_map(settle(catalog_build.build_flag_rows(**_sources(e)), "flag-rows"))


@query
def catalog_staleness(e: Estate) -> DataFrame:
    fresh = _settled_catalog(e)
    return freshness.catalog_staleness(fresh, _published(fresh))


@query
def catalog_orphans(e: Estate) -> DataFrame:
    fresh = _settled_catalog(e)
    return freshness.catalog_orphans(fresh, _published(fresh))


@query
def stale_summaries(e: Estate) -> DataFrame:
    return freshness.stale_summaries(e.enrichment(), e.table("folder"), e.docs())


# Compliance and the gate ---------------------------------------------------------------------------
def _policy(e: Estate) -> DataFrame:
    return policy.policy_rows(policy.config_of(e.config(), e.files()))


def _findings(e: Estate) -> DataFrame:
    return compliance.arch_findings(extract.policy_refs(e.files()), _policy(e))


@query
def deprecated_refs(e: Estate) -> DataFrame:
    return compliance.deprecated_refs(extract.policy_refs(e.files()), _policy(e)).drop("kind")


@query
def layer_violations(e: Estate) -> DataFrame:
    return compliance.layer_violations(extract.policy_refs(e.files()), _policy(e)).drop("kind")


@query
def arch_findings(e: Estate) -> DataFrame:
    return _findings(e)


@query
def compliance_summary(e: Estate) -> DataFrame:
    return compliance.compliance_summary(_findings(e))


def _doc_problems(e: Estate) -> DataFrame:
    return docs.doc_lint(e.table("folder"), e.docs(), e.files(), policy.required_fields(e.config()))


@query
def doc_lint(e: Estate) -> DataFrame:
    return _doc_problems(e)


@query
def doc_coverage(e: Estate) -> DataFrame:
    return docs.doc_coverage(e.table("folder"), _doc_problems(e))


@query
def definition_lint(e: Estate) -> DataFrame:
    return definitions.definition_lint(settle(definitions.describe(e.definitions()).drop("raw"), "definitions"), e.config())


@query
def missing_definitions(e: Estate) -> DataFrame:
    return definitions.missing_definitions(e.table("folder"), e.definitions(), e.config())


@query
def vulnerable_pins(e: Estate) -> DataFrame:
    return dependencies.vulnerable_pins(extract.pip_requirements(e.files()), *_advisories(e))


@query
def unpinned_installs(e: Estate) -> DataFrame:
    return dependencies.unpinned_installs(extract.pip_requirements(e.files()))


@query
def job_gate(e: Estate) -> DataFrame:
    return gate_run.job_gate(e.table("folder"), _checks(e))


@query
def job_gate_details(e: Estate) -> DataFrame:
    return gate_run.gate_details(_checks(e))


@query
def secret_shape_scan(e: Estate) -> DataFrame:
    return secrets.secret_shape_scan(_texts(e))


#: Terms of a private denylist for the query; a real list is read from outside the repository.
DENY_TERMS = ["corp\\.io", "old\\.gone", "erion|eaux"]


@query
def denylist_scan(e: Estate) -> DataFrame:
    return secrets.denylist_scan(_texts(e), DENY_TERMS)


@query
def denylist_table_scan(e: Estate) -> DataFrame:
    """Terms for all repositories, and one of its own for each source of documents."""
    shared = e.spark.createDataFrame([(None, t) for t in DENY_TERMS], "repo string, term string")
    doc = e.given("documents")
    own = doc.select(F.col("source").alias("repo"), F.concat(F.lit("the "), F.lower(F.right("source", F.lit(1))), F.lit("[a-z]+ing|"), F.lower("source")).alias("term"))
    texts = doc.select(F.col("source").alias("repo"), F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    return secrets.denylist_table_scan(secrets.scannable(texts.where("text is not null")), shared.unionByName(own.distinct()))


# Drift ---------------------------------------------------------------------------------------------
@query
def definition_leaves(e: Estate) -> DataFrame:
    return drift.definition_leaves(drift_run.comparable(e.definitions(), e.config()))


@query
def definition_drift(e: Estate) -> DataFrame:
    return drift_run.definition_drift(e.definitions(), e.config())


@query
def drift_summary(e: Estate) -> DataFrame:
    out = drift_run.drift_summary(e.definitions(), e.config(), policy.platform_dim(e.spark))
    return out.select("repo", "job_key", "drift", *[joined(k).alias(k) for k in ("added", "removed", "changed")])


@query
def ddl_drift(e: Estate) -> DataFrame:
    return drift.ddl_drift(drift_run.comparable(e.definitions(), e.config()))


def _definition_refs(e: Estate) -> DataFrame:
    """References of every spelling: ticket, folder, definition name, number."""
    return e.table("folder").select(
        "repo",
        F.explode(F.array("ticket", "job_dir", F.replace("ticket", F.lit("JOB"), F.lit("load")), F.replace("ticket", F.lit("JOB-"), F.lit("")))).alias("ref"),
    ).distinct()


def _found(e: Estate) -> DataFrame:
    return definitions.repo_definition_lookup(
        _definition_refs(e), definitions.describe(e.definitions()), e.config()
    )


@query
def repo_definition_lookup(e: Estate) -> DataFrame:
    return _found(e)


@query
def live_name_resolution(e: Estate) -> DataFrame:
    return drift.live_name_resolution(_definition_refs(e), _found(e), e.table("live_job"))


# Runs ----------------------------------------------------------------------------------------------
@query
def active_runs(e: Estate) -> DataFrame:
    return runs.active_runs(e.runs())


def _requests(e: Estate) -> DataFrame:
    return e.given("customer").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("repo"), F.col("c_custkey") % 25).alias("repo"),
        F.concat(F.lit("JOB-"), "c_custkey").alias("job_key"),
    )


@query
def trigger_conflicts(e: Estate) -> DataFrame:
    return runs.trigger_conflicts(_requests(e), runs.active_runs(e.runs()))


@query
def blocking_runs(e: Estate) -> DataFrame:
    return runs.blocking_runs(_requests(e), runs.active_runs(e.runs()))


@query
def run_status(e: Estate) -> DataFrame:
    return runs.run_status(e.runs())


@query
def run_output(e: Estate) -> DataFrame:
    return runs.run_output(e.runs())


@query
def failure_triage(e: Estate) -> DataFrame:
    # Only the entries and objects of failing jobs are asked for, so only their sources are read.
    failing = runs.failed_runs(e.runs()).select("repo", F.col("job_key").alias("ticket")).distinct()
    jobs = settle(e.table("folder").join(failing, ["repo", "ticket"], "left_semi"), "failing-folders")
    rows = settle(catalog_build.build_catalog_for(jobs, **_sources(e)), "failing-rows")
    return runs.failure_triage(e.runs(), rows, graph.graph_edges(rows))


@query
def failure_related(e: Estate) -> DataFrame:
    """The related jobs of every failed run, as rows."""
    return runs.failure_related(e.runs(), _edges(e))


# Commands and configuration ------------------------------------------------------------------------
@query
def command_audit(e: Estate) -> DataFrame:
    return commands.command_audit(e.table("command"), e.table("sql_file"))


@query
def referenced_sql_scan(e: Estate) -> DataFrame:
    return commands.referenced_sql_scan(e.table("command"), e.table("sql_file"))


@query
def command_audit_stream(e: Estate) -> DataFrame:
    names = ("audit", "audit-state", "sql-verdicts", "sql-changes", "sql-state")
    out, state, judged, changes, judged_state = (scratch_dir(e.spark, n) for n in names)
    files = e.table("sql_file")
    verdicts = audit_stream.SqlVerdicts(e.spark, judged)
    files.select("repo", F.concat(F.lit("./"), "path").alias("path")).write.json(changes)
    edits = command_source.load_file_changes(e.spark, changes, streaming=True)
    read = lambda wanted: files.join(wanted, ["repo", "path"], "left_semi")
    audit_stream.sql_verdict_stream(edits, read, verdicts, judged_state).awaitTermination()
    stream = command_source.load_commands(e.spark, _write_commands(e), streaming=True)
    audit_stream.command_audit_stream(stream, verdicts, out, state).awaitTermination()
    return e.spark.read.parquet(out).select("event_id", "ts", "repo", "kind", "cmd", "decision", "reason")


@query
def guard_rule_parity(e: Estate) -> DataFrame:
    """All guard rules against the rules that ever decided a command: what is left never fired."""
    rules = policy.guard_rules(e.spark)
    rule = commands.first_rule(F.col("kind"), X.dequoted(F.col("cmd")))
    fired = e.table("command").select("kind", rule.alias("rule")).distinct()
    return commands.guard_rule_parity(rules, rules.join(fired, ["kind", "rule"], "left_semi"))


@query
def guard_rule_set_parity(e: Estate) -> DataFrame:
    """Rules of adapters, playbooks and fallback copies, read from their texts, against each other."""
    files = e.table("rule_file")
    of = lambda path: files.where(F.col("path") == path)
    return rule_sets.rule_set_parity(
        rule_sets.adapter_rules(of("adapter.py")), playbook=rule_sets.playbook_rules(of("playbook.md")), fallback=rule_sets.fallback_rules(of("fallback.py"))
    )


@query
def config_field_violations(e: Estate) -> DataFrame:
    return config_audit.config_field_violations(e.config())


@query
def config_cross_check(e: Estate) -> DataFrame:
    return config_audit.config_cross_check(e.config())


@query
def deploy_model_mismatch(e: Estate) -> DataFrame:
    return config_audit.deploy_model_mismatch(e.config(), policy.platform_dim(e.spark))


@query
def platform_inference(e: Estate) -> DataFrame:
    return inference.platform_inference(e.table("listing")).withColumn("evidence", joined("evidence"))


@query
def layout_inference(e: Estate) -> DataFrame:
    return inference.layout_inference(e.table("listing"))


# Streaming refresh -----------------------------------------------------------------------------------
def _outdated(rows: DataFrame) -> DataFrame:
    """An older state of the catalog: other statuses, objects that came or went, folders that are new or gone since."""
    num = F.regexp_extract("ticket", r"(\d+)$", 1).cast("bigint")
    objects = F.when(num % 5 == 0, F.slice("objects", 2, F.greatest(F.size("objects") - 1, F.lit(0)))).otherwise(F.col("objects"))
    more = F.when(num % 3 == 0, F.array(F.concat(F.lit("Old.GONE_"), num % 7))).otherwise(F.array().cast("array<string>"))
    old = rows.withColumn("objects", F.concat(objects, more)).withColumn("status", F.lit("OLD"))
    gone = old.where((num % 13 == 0) & F.endswith("dir", F.lit("_F"))).withColumn("dir", F.concat("ticket", F.lit("_X")))
    return old.where(~((num % 11 == 0) & F.endswith("dir", F.lit("_O")))).unionByName(gone)


def _refreshed(e: Estate) -> Published:
    path, state, changes = (scratch_dir(e.spark, n) for n in ("published", "refresh-state", "changes"))
    sources = _sources(e)
    published = Published.first(_outdated(_settled_catalog(e)), path)
    e.table("file_change").drop("event_id").write.json(changes)
    stream = command_source.load_file_changes(e.spark, changes, streaming=True)
    build = lambda jobs: catalog_build.build_catalog_for(jobs, **sources)
    catalog_refresh.catalog_refresh_stream(stream, build, published, state, config=sources["config"]).awaitTermination()
    return published


@query
def catalog_refresh_stream(e: Estate) -> DataFrame:
    return _flat_catalog(_refreshed(e).catalog())


@query
def catalog_refresh_index(e: Estate) -> DataFrame:
    """Totals of the objects after the same refresh."""
    return _refreshed(e).totals().select("repo", "object_key", "object", "n_jobs", "n_tickets")
