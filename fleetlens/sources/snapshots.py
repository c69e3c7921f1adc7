"""Exported platform state: live jobs, runs, advisories. One JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import schemas


def live_jobs(exports: DataFrame) -> DataFrame:
    """Exports of any platform -> (repo, kind, job_id, name, paused, schedule); ``paused`` is unknown
    where the platform does not say."""
    c = F.col
    is_kind = {k: c("kind") == k for k in ("databricks", "airflow", "snowflake_tasks")}
    named = F.when(is_kind["databricks"], c("settings.name")).when(is_kind["airflow"], c("dag_id")).otherwise(c("name"))
    pause = F.nullif(c("settings.schedule.pause_status"), F.lit(""))
    return exports.select(
        "repo",
        "kind",
        F.when(is_kind["databricks"], F.coalesce("job_id", F.lit(""))).otherwise(F.coalesce(named, F.lit(""))).alias("job_id"),
        F.coalesce(named, F.lit("")).alias("name"),
        F.when(is_kind["databricks"], pause == "PAUSED")
        .when(is_kind["airflow"], F.lower(F.coalesce("paused", F.lit(""))).isin("true", "1"))
        .when(is_kind["snowflake_tasks"], F.lower(F.coalesce("state", F.lit(""))) == "suspended")
        .alias("paused"),
        F.when(is_kind["databricks"], c("settings.schedule.quartz_cron_expression"))
        .when(is_kind["snowflake_tasks"], c("schedule"))
        .alias("schedule"),
    )


def runs(exports: DataFrame) -> DataFrame:
    """Run exports -> run table with one state column for all platforms."""
    c = F.col
    return exports.select(
        "repo",
        "kind",
        "job_key",
        F.when(c("kind") == "airflow", F.coalesce("run_id", "dag_run_id"))
        .when(c("kind") == "snowflake_tasks", c("QUERY_ID"))
        .otherwise(c("run_id"))
        .alias("run_id"),
        "started",
        F.when(c("kind") == "airflow", c("state"))
        .when(c("kind") == "snowflake_tasks", c("STATE_NAME"))
        .otherwise(c("life_cycle"))
        .alias("state"),
        "result_state",
        "tasks",
        "logs",
        "error",
        "logs_truncated",
        "payload",
    )


def load_live_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Folders ``kind=<platform>`` of JSON lines."""
    return live_jobs(spark.read.schema(schemas.LIVE_JOB_EXPORT + ", kind string").json(path))


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return runs(spark.read.schema(schemas.RUN_EXPORT + ", kind string").json(path))


def load_live_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Live definitions as raw text, one JSON line each with repo, job_key, ext and raw."""
    exported = spark.read.schema("repo string, job_key string, ext string, raw string").json(path)
    return exported.select(
        "repo", F.lower("job_key").alias("job_key"), F.lit("live").alias("side"), F.lit("prod").alias("env"),
        F.lit("").alias("path"), F.col("job_key").alias("stem"), "ext", "raw",
    )


def advisories(exports: DataFrame) -> DataFrame:
    """(package, version, vuln_id), packages under their normalised name."""
    return exports.select(
        X.package_name(F.col("package")).alias("package"), "version", F.explode("vulns.id").alias("vuln_id")
    ).distinct()


def load_advisories(spark: SparkSession, path: str, allow_path: str) -> tuple[DataFrame, DataFrame]:
    """Advisories and the grandfathered (package, version, vuln_id) rows."""
    known = advisories(spark.read.schema(schemas.ADVISORY_DOC).json(path))
    allowed = (
        spark.read.schema(schemas.ALLOW_DOC)
        .json(allow_path)
        .select(X.package_name(F.col("package")).alias("package"), "version", F.explode("vulns").alias("vuln_id"))
        .distinct()
    )
    return known, allowed
