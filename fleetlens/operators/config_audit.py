"""Checks of repository configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

IDENTIFIER = r"\A[A-Za-z_][A-Za-z0-9_$]*\n?\z"
FQN = r"\A[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$*]*)*\n?\z"
NAME = r"\A[A-Za-z0-9._-]+\n?\z"
RELPATH = r"\A[A-Za-z0-9._/-]+\n?\z"
URL_TEMPLATE = r"(?U)\Ahttps?://[^\s\"'<>]+\n?\z"
HINT_KEY = r"\A[A-Za-z0-9_.$*-]+\n?\z"

_NO_TEXT = "array<string>"


def _values(field: str, rule: str, values: Column) -> Column:
    values = F.coalesce(values, F.array().cast(_NO_TEXT))
    return F.transform(
        values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"), F.lit(rule).alias("rule"))
    )


def _one(field: str, rule: str, value: Column) -> Column:
    """A single optional value: not checked when empty."""
    return _values(field, rule, F.array_compact(F.array(F.nullif(value, F.lit("")))))


def _passes(value: Column, rule: Column) -> Column:
    choice = lambda options: value.isin(options)
    return (
        F.when(rule == "required", value != "")
        .when(rule == "identifier", value.rlike(IDENTIFIER))
        .when(rule == "fqn", value.rlike(FQN))
        .when(rule == "name", value.rlike(NAME))
        .when(rule == "relpath", value.rlike(RELPATH) & ~value.contains("..") & ~value.startswith("/"))
        .when(rule == "url template", value.rlike(URL_TEMPLATE) & value.contains("{id}"))
        .when(rule == "hint key", value.rlike(HINT_KEY))
        .when(rule == "platform kind", choice(P.PLATFORM_KINDS))
        .when(rule == "deploy model", choice(P.DEPLOY_MODELS))
        .when(rule == "dialect", choice(P.WAREHOUSE_DIALECTS))
        .when(rule == "schema version", value.cast("int") <= P.CONFIG_SCHEMA_VERSION)
    )


def config_field_violations(config: DataFrame) -> DataFrame:
    """(repo, field, value, rule) of every value that breaks its rule."""
    p, w, a, j = (F.col(c) for c in ("platform", "warehouse", "architecture", "project"))
    dirs, rules, hints = p["job_def_dirs"], a["layer_rules"], a["replace_hints"]
    required = lambda v: F.array(F.coalesce(v, F.lit("")))
    checks = F.concat(
        _values("schema_version", "schema version", F.array_compact(F.array(F.col("schema_version").cast("string")))),
        _values("project.key_prefixes[]", "name", j["key_prefixes"]),
        _one("project.ticket_url_template", "url template", j["ticket_url_template"]),
        _values("project.jobs_dir", "relpath", F.array(F.coalesce(j["jobs_dir"], F.lit("jobs")))),
        _values("platform.kind", "required", required(p["kind"])),
        _one("platform.kind", "platform kind", p["kind"]),
        _values("platform.deploy_model", "required", required(p["deploy_model"])),
        _one("platform.deploy_model", "deploy model", p["deploy_model"]),
        _values("platform.job_def_dirs key", "name", F.map_keys(dirs)),
        _values("platform.job_def_dirs[]", "relpath", F.map_values(dirs)),
        _one("platform.profile", "name", p["profile"]),
        _one("platform.dags_dir", "relpath", p["dags_dir"]),
        _values("warehouse.dialect", "dialect", F.array(F.coalesce(w["dialect"], F.lit("none")))),
        _values("architecture.layers[]", "identifier", a["layers"]),
        _values("architecture.layer_rules key", "identifier", F.map_keys(rules)),
        _values("architecture.layer_rules[]", "identifier", F.flatten(F.map_values(rules))),
        _values("architecture.deprecated_schema_deny[]", "identifier", a["deprecated_schema_deny"]),
        _values("architecture.read_exceptions[]", "fqn", a["read_exceptions"]),
        _values("architecture.replace_hints key", "hint key", F.map_keys(hints)),
    )
    return (
        config.select("repo", F.explode(checks).alias("c"))
        .select("repo", "c.field", "c.value", "c.rule")
        .where(~F.coalesce(_passes(F.col("value"), F.col("rule")), F.lit(False)))
    )


def config_cross_check(config: DataFrame) -> DataFrame:
    """(repo, error): keys that contradict the deploy model."""
    p = F.col("platform")
    git = p["deploy_model"] == "git-sync"
    has_dirs = F.coalesce(F.size(F.map_keys(p["job_def_dirs"])), F.lit(0)) > 0
    has_dags = F.coalesce(p["dags_dir"], F.lit("")) != ""
    errors = F.array_compact(
        F.array(
            F.when(git & has_dirs, F.lit("job_def_dirs set on git-sync")),
            F.when(git & ~has_dags, F.lit("dags_dir missing on git-sync")),
            F.when(~git & ~has_dirs, F.concat(F.lit("job_def_dirs missing on "), p["deploy_model"])),
            F.when(~git & has_dags, F.concat(F.lit("dags_dir set on "), p["deploy_model"])),
        )
    )
    return config.select("repo", F.explode(errors).alias("error"))


def deploy_model_mismatch(config: DataFrame, platforms: DataFrame) -> DataFrame:
    """(repo, kind, deploy_model, adapter_model, error): no adapter, or another model than its adapter's."""
    mine = config.select("repo", F.col("platform.kind").alias("kind"), F.col("platform.deploy_model").alias("deploy_model"))
    joined = mine.join(platforms.select("kind", "adapter_model"), "kind", "left")
    error = F.when(F.col("adapter_model").isNull(), F.lit("no adapter")).when(
        F.col("adapter_model") != F.col("deploy_model"), F.lit("deploy_model mismatch")
    )
    return joined.withColumn("error", error).where(F.col("error").isNotNull()).select(
        "repo", "kind", "deploy_model", "adapter_model", "error"
    )
