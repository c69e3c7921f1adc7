"""Live definitions against the repository's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strict_json as J
from ..functions import text as X
from ..functions.pyhelpers import ASSIGNED_FIELDS, UNORDERED_LISTS, leaf_batches
from ..functions.skew import lookup_join, row_join, settled_lookup
from ..session import settle

ABSENT = "<absent>"
JOB = ["repo", "job_key"]


#: A key with a dot or an escape. Such a key can spell the path of a nested one, and then their order in the text decides.
_DOTTED_KEY = r'(?s)"[^"]*[.\\][^"]*"\s*:'


def definition_leaves(job_def: DataFrame) -> DataFrame:
    """(repo, job_key, side, path, val): authored settings as dotted paths with JSON values. Objects are opened level by level
    until none is left; lists stay whole, and those without an order have their items sorted.

    Only definitions with dotted keys go to Python, if there are any: a VARIANT does not keep the order of keys.
    """
    rows = job_def.where(F.col("ext") == "json").select(*JOB, "side", "raw")
    dotted = F.col("raw").rlike(_DOTTED_KEY)
    specs = X.computed_once(rows.where(~dotted).select(*JOB, "side", "raw"), spec=J.parsed(F.col("raw"))).drop("raw")
    wrapped = J.member(F.col("spec"), "settings")
    body = F.when(J.is_object(wrapped), wrapped).otherwise(F.col("spec"))
    level = J.members(specs.select(*JOB, "side", body.alias("value")), "value", "path", "value_").withColumnRenamed("value_", "value")
    level = settle(level.where(~F.col("path").isin(sorted(ASSIGNED_FIELDS))), "definition-settings")
    item = F.transform(F.col("value").try_cast("array<variant>"), J.to_text)
    sorted_list = F.concat(F.lit("["), F.array_join(F.array_sort(item), ", "), F.lit("]"))
    is_list = F.startswith(F.schema_of_variant("value"), F.lit("ARRAY"))
    whole = F.when(F.col("path").isin(sorted(UNORDERED_LISTS)) & is_list, sorted_list).otherwise(J.to_text(F.col("value")))
    leaves, is_leaf = [], ~J.is_object(F.col("value"))
    while True:
        leaves.append(level.where(is_leaf).select(*JOB, "side", "path", whole.alias("val")))
        opened = level.where(~is_leaf)
        if opened.isEmpty():
            break
        inner = J.members(opened.withColumnRenamed("path", "outer"), "value", "key", "value_")
        level = settle(inner.select(*JOB, "side", F.concat("outer", F.lit("."), "key").alias("path"), F.col("value_").alias("value")), "definition-settings")
        whole = J.to_text(F.col("value"))
    if not rows.where(dotted).isEmpty():
        leaves.append(rows.where(dotted).mapInArrow(leaf_batches, "repo string, job_key string, side string, path string, val string"))
    return reduce(DataFrame.unionByName, leaves)


def compared_jobs(job_def: DataFrame) -> DataFrame:
    """Jobs with a repository and a live definition; the others have nothing to compare."""
    has = lambda s: F.max(F.col("side") == s)
    return job_def.groupBy(*JOB).agg(has("repo").alias("r"), has("live").alias("l")).where("r and l").select(*JOB)


def definition_drift(leaves: DataFrame, compared: DataFrame) -> DataFrame:
    """Paths of the compared jobs that are live only, in the repository only, or differ. Both sides meet in one aggregation
    on (job, path): one shuffle with map-side merge instead of an outer join."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("val")))
    paired = row_join(leaves, compared, JOB, "inner")
    both = paired.groupBy(*JOB, "path").agg(side("repo").alias("repo_val"), side("live").alias("live_val"))
    kind = (
        F.when(F.col("repo_val").isNull(), F.lit("added"))
        .when(F.col("live_val").isNull(), F.lit("removed"))
        .when(F.col("repo_val") != F.col("live_val"), F.lit("changed"))
    )
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *JOB, "path", "kind",
        F.coalesce("repo_val", F.lit(ABSENT)).alias("repo_val"),
        F.coalesce("live_val", F.lit(ABSENT)).alias("live_val"),
    )


def normalized_ddl(ddl: Column) -> Column:
    """Comparison form of a DDL text: comments and final ``;`` dropped, white space collapsed, lower case
    outside single-quoted literals."""
    space = r"(?:[\p{IsWhite_Space}\x1c-\x1f])+"
    bare = F.regexp_replace(F.regexp_replace(ddl, r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    segments = F.regexp_extract_all(bare, F.lit(r"'(?:[^']|'')*'|[^']+|'"), F.lit(0))
    literal = lambda s: s.startswith("'") & (F.length(s) > 1)
    joined = F.array_join(
        F.transform(
            segments,
            lambda s: F.regexp_replace(F.when(literal(s), s).otherwise(F.lower(s)), space, " "),
        ),
        "",
    )
    return F.trim(F.regexp_replace(F.trim(joined), r";+\z", ""))


def ddl_drift(job_def: DataFrame) -> DataFrame:
    """(repo, job_key, drift) of DDL definitions with both sides."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("ddl")))
    return (
        job_def.where(F.col("ext") == "sql")
        .select(*JOB, "side", normalized_ddl(F.col("raw")).alias("ddl"))
        .groupBy(*JOB)
        .agg(side("repo").alias("repo_ddl"), side("live").alias("live_ddl"))
        .where(F.col("repo_ddl").isNotNull() & F.col("live_ddl").isNotNull())
        .select(*JOB, (F.col("repo_ddl") != F.col("live_ddl")).alias("drift"))
    )


def drift_summary(
    compared: DataFrame, drift: DataFrame, ddl: DataFrame, config: DataFrame, platforms: DataFrame
) -> DataFrame:
    """One row per compared job (repo, job_key, drift, added, removed, changed). Jobs on git-synced
    platforms are out of scope, by the platform's own deploy model and not by the configured one. The
    path arrays hold no more than the leaves of one definition."""
    model = platforms.select("kind", "adapter_model")
    scope = (
        config.select("repo", F.col("platform.kind").alias("kind"))
        .join(model, "kind", "inner")
        .where(F.col("adapter_model") != "git-sync")
        .select("repo", "adapter_model")
    )
    paths = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("path")))).alias(k)
    per_job = drift.groupBy(*JOB).agg(paths("added"), paths("removed"), paths("changed"))
    none = F.array().cast("array<string>")
    json_rows = (
        row_join(compared.select(*JOB).distinct(), per_job, JOB)
        .select(
            *JOB, F.lit("api-reset").alias("adapter_model"), F.col("added").isNotNull().alias("drift"),
            *[F.coalesce(k, none).alias(k) for k in ("added", "removed", "changed")],
        )
    )
    ddl_rows = ddl.select(
        *JOB, F.lit("sql-ddl").alias("adapter_model"), "drift", none.alias("added"), none.alias("removed"),
        F.when(F.col("drift"), F.array(F.lit("ddl"))).otherwise(none).alias("changed"),
    )
    return lookup_join(
        json_rows.unionByName(ddl_rows), settled_lookup(scope, "drift-scope"), ["repo", "adapter_model"], "inner"
    ).drop("adapter_model")


def live_name_resolution(refs: DataFrame, found: DataFrame, live_job: DataFrame) -> DataFrame:
    """Job id of a reference: a number is the id itself; else the live job named like the reference's
    definition. No match and several matches are findings. ``found`` is the result of
    :func:`~fleetlens.operators.definitions.repo_definition_lookup`."""
    asked = refs.select("repo", "ref").distinct().join(found.select("repo", "ref", F.col("name").alias("def_name")), ["repo", "ref"], "left")
    by_name = live_job.groupBy("repo", F.col("name").alias("live_name")).agg(
        F.count("*").alias("n"), F.min("job_id").alias("job_id")
    )
    named = asked.withColumn("live_name", F.coalesce("def_name", "ref"))
    hit = lookup_join(named, by_name, ["repo", "live_name"])
    is_id = F.col("ref").rlike(r"^\p{Nd}+\z")
    n = F.when(is_id, F.lit(1)).otherwise(F.coalesce("n", F.lit(0)))
    return hit.select(
        "repo",
        "ref",
        F.when(is_id, F.col("ref")).when(n == 1, F.col("job_id")).alias("job_id"),
        n.cast("bigint").alias("n_matches"),
        F.when(n == 1, F.lit("resolved")).when(n == 0, F.lit("missing")).otherwise(F.lit("ambiguous")).alias("status"),
    )
