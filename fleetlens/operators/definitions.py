"""Job definitions in the repository: schedule, lookup, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import strict_json as J
from ..functions import text as X
from ..functions.pyhelpers import error_batches
from ..functions.skew import lookup_join
from ..session import settle
from ..sources import schemas


def describe(job_def: DataFrame) -> DataFrame:
    """Definitions with name and schedule of the JSON ones, read strictly; ``unparsed`` is the text of one that is no JSON."""
    columns = [c.strip().split(" ")[0] for c in schemas.JOB_DEF.split(",")]
    is_json = F.col("ext") == "json"
    rows = X.computed_once(job_def.select(*columns), spec=F.when(is_json, J.parsed(F.col("raw"))))
    spec = F.col("spec")
    rows = X.computed_once(rows, wrapped=J.member(spec, "settings"))
    wrapped = F.col("wrapped")
    settings = F.when(wrapped.isNotNull(), wrapped).when(J.is_object(spec), spec)
    rows = X.computed_once(rows, settings=settings, schedule=J.member(settings, "schedule"))
    own, schedule = F.col("settings"), F.col("schedule")
    return rows.select(
        *columns,
        F.when(is_json & spec.isNull(), F.coalesce("raw", F.lit(""))).alias("unparsed"),
        F.when(is_json, F.coalesce(J.is_object(spec), F.lit(False))).alias("is_object"),
        F.when(is_json, J.truthy(J.member(spec, "name")) | J.truthy(J.member(wrapped, "name"))).alias("has_name"),
        J.string(J.member(spec, "name")).alias("top_name"),
        J.string(J.member(own, "name")).alias("name"),
        J.string(J.member(schedule, "quartz_cron_expression")).alias("cron"),
        J.string(J.member(schedule, "timezone_id")).alias("tz"),
        J.string(J.member(schedule, "pause_status")).alias("pause"),
    )


def with_errors(defs: DataFrame) -> DataFrame:
    """Definitions with line and message of what is wrong with those that are no JSON, in place of ``unparsed``. Only these go to
    Python, whose parser says where a text breaks off."""
    fine = defs.where(F.col("unparsed").isNull()).withColumns({"error_line": F.lit(None).cast("bigint"), "error_msg": F.lit(None).cast("string")})
    broken = defs.where(F.col("unparsed").isNotNull())
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in defs.schema), "error_line bigint, error_msg string"])
    return fine.unionByName(broken.mapInArrow(error_batches, schema)).drop("unparsed")


def _in_repo(defs: DataFrame) -> DataFrame:
    return defs.where(F.col("side") == "repo")


def _env_order(config: DataFrame) -> DataFrame:
    """(repo, envs, has_prod): environments as configured."""
    envs = F.coalesce(F.map_keys("platform.job_def_dirs"), F.array().cast("array<string>"))
    return config.select("repo", envs.alias("envs"), F.array_contains(envs, "prod").alias("has_prod"))


def definition_schedule(defs: DataFrame, config: DataFrame) -> DataFrame:
    """First readable JSON definition of each key: from the prod folder where one is configured, else
    from every folder in order."""
    ranked = lookup_join(
        _in_repo(defs).where((F.col("ext") == "json") & F.col("unparsed").isNull() & F.col("is_object")),
        _env_order(config), ["repo"], "inner",
    ).where(F.when(F.col("has_prod"), F.col("env") == "prod").otherwise(F.array_contains("envs", F.col("env"))))
    order = F.struct(F.array_position("envs", F.col("env")), X.path_order(F.col("path")))
    return (
        ranked.groupBy("repo", F.lower("job_key").alias("job_key"))
        .agg(F.min_by(F.struct("name", "cron", "tz", "pause"), order).alias("d"))
        .select("repo", "job_key", "d.*")
    )


def _configured(defs: DataFrame, config: DataFrame) -> DataFrame:
    """Definitions in a configured folder with ``env_rank``: JSON from prod first, then (as DDL always)
    in configured order."""
    ranked = lookup_join(_in_repo(defs), _env_order(config), ["repo"], "inner")
    prod_first = (F.col("ext") == "json") & (F.col("env") == "prod")
    position = F.array_position("envs", F.col("env"))
    return ranked.where(position > 0).withColumn("env_rank", F.when(prod_first, 0).otherwise(position))


def configured(defs: DataFrame, config: DataFrame) -> DataFrame:
    """Repository definitions that lie in a configured folder."""
    return _configured(defs, config).select(*defs.columns)


def first_definitions(job_def: DataFrame, config: DataFrame) -> DataFrame:
    """The repository definition of each key and format, as a lookup by key finds it."""
    place = F.struct("env_rank", X.path_order(F.col("path")))
    kept = ["env", "path", "stem", "raw"]
    return (
        _configured(job_def, config)
        .groupBy("repo", "job_key", "side", "ext")
        .agg(F.min_by(F.struct(*kept), place).alias("d"))
        .select("repo", "job_key", "side", "ext", *[F.col(f"d.{c}").alias(c) for c in kept])
    )


def repo_definition_lookup(refs: DataFrame, defs: DataFrame, config: DataFrame) -> DataFrame:
    """Definition file for a reference (repo, ref): by file stem or key, or by name; prod first, then the
    other environments as configured, then path order."""
    placed = settle(_configured(defs.where(F.col("ext") == "json"), config).select(
        "repo",
        F.struct("env_rank", X.path_order(F.col("path")).alias("order")).alias("place"),
        F.struct("path", "top_name").alias("hit"),
        F.lower(F.substring_index("stem", "_", 1)).alias("by_key"),
        F.lower(X.either(F.col("top_name"))).alias("by_name"),
    ), "definition-places")

    def first_by(column: str, alias: str) -> DataFrame:
        return placed.where(F.col(column).isNotNull()).groupBy("repo", F.col(column).alias(alias)).agg(
            F.min(F.struct("place", "hit")).alias(f"{alias}_hit")
        )

    asked = refs.select("repo", "ref").distinct().select(
        "repo", "ref",
        F.lower(F.substring_index("ref", "_", 1)).alias("key"),
        F.lower("ref").alias("named"),
    )
    found = lookup_join(asked, first_by("by_key", "key"), ["repo", "key"])
    found = lookup_join(found, first_by("by_name", "named"), ["repo", "named"])
    best = F.least("key_hit", "named_hit")
    return found.select("repo", "ref", best["hit"]["path"].alias("path"), best["hit"]["top_name"].alias("name"))


def definition_lint(defs: DataFrame, config: DataFrame) -> DataFrame:
    """Unreadable definitions, and definitions in a deployable folder that are no object or lack a name."""
    configured = F.transform(
        F.coalesce(F.map_values("platform.job_def_dirs"), F.array().cast("array<string>")),
        lambda d: F.concat(F.regexp_replace(d, r"/+\z", ""), F.lit("/")),
    )
    fallback = F.array(*[F.lit(d) for d in P.DEFAULT_DEPLOYABLE_DIRS])
    dirs = config.select(
        "repo", F.when(F.size(configured) > 0, configured).otherwise(fallback).alias("dirs")
    )
    checked = lookup_join(
        with_errors(_in_repo(defs).where(F.col("ext") == "json")), dirs, ["repo"]
    )
    normal = F.regexp_replace("path", r"\A[./]+", "")
    deployable = F.exists(F.coalesce("dirs", fallback), lambda d: F.contains(normal, d))
    problem = (
        F.when(
            F.col("error_line").isNotNull(),
            F.concat("path", F.lit(":"), F.col("error_line").cast("string"), F.lit(": invalid JSON: "), "error_msg"),
        )
        .when(deployable & ~F.col("is_object"), F.concat("path", F.lit(": job definition must be a JSON object")))
        .when(
            deployable & ~F.col("has_name"),
            F.concat("path", F.lit(': missing job name (expected top-level "name" or "settings.name")')),
        )
    )
    return checked.select("repo", "job_key", "path", problem.alias("problem")).where(F.col("problem").isNotNull())


def _definition_ext(model: Column) -> Column:
    return F.when(model == "api-reset", F.lit("json")).when(model == "sql-ddl", F.lit("sql"))


def definition_counts(folders: DataFrame, defs: DataFrame, config: DataFrame) -> DataFrame:
    """Per job folder: its deploy model and how many definitions of the format that model needs exist
    for its key in the configured folders."""
    models = config.select(
        "repo",
        F.col("platform.deploy_model").alias("deploy_model"),
        F.coalesce(F.map_keys("platform.job_def_dirs"), F.array().cast("array<string>")).alias("envs"),
    )
    wanted = lookup_join(folders, models, ["repo"], "inner").withColumn("job_key", F.lower("ticket"))
    present = (
        lookup_join(_in_repo(defs), models, ["repo"], "inner")
        .where((F.col("ext") == _definition_ext(F.col("deploy_model"))) & F.array_contains("envs", F.col("env")))
        .groupBy("repo", F.lower("job_key").alias("job_key"))
        .agg(F.count("*").alias("n_defs"))
    )
    return lookup_join(wanted, present, ["repo", "job_key"]).select(
        "repo", "job_dir", "ticket", "deploy_model", F.coalesce("n_defs", F.lit(0)).alias("n_defs")
    )


def artifact_name(model: Column) -> Column:
    return (
        F.when(model == "api-reset", F.lit("job-def JSON"))
        .when(model == "sql-ddl", F.lit("task DDL (*.sql)"))
        .otherwise(F.lit("definition"))
    )


def missing_definitions(folders: DataFrame, defs: DataFrame, config: DataFrame) -> DataFrame:
    """Jobs deployed from repository files without a definition of the right format."""
    model = F.col("deploy_model")
    return (
        definition_counts(folders, defs, config)
        .where(_definition_ext(model).isNotNull() & (F.col("n_defs") == 0))
        .select(
            "repo", "job_dir", "ticket",
            F.concat(
                F.lit("REQUIRED "), artifact_name(model), F.lit(" missing for "), "ticket",
                F.lit(" (deploy_model="), model, F.lit(")"),
            ).alias("problem"),
        )
    )
