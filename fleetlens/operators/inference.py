"""What a repository's file listing tells about its platform and layout. Input: (repo, path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

JOB_FOLDER = r"^([A-Za-z][A-Za-z0-9]*)-\p{Nd}+_"
CANDIDATES = ["jobs", "dags", "pipelines", "tasks"]
NAME = r"\A[A-Za-z0-9._-]+\z"
RELPATH = r"\A[A-Za-z0-9._/-]+\z"


def _usable_path(path: Column) -> Column:
    return path.rlike(RELPATH) & ~path.contains("..")


def _parts() -> Column:
    return X.path_parts(F.col("path"))


def _walked(folder: Column) -> Column:
    """Folders a scan enters: no dot folder, no vendored or derived tree."""
    return ~folder.startswith(".") & ~folder.isin(P.WALK_SKIP_DIRS)


def _folders() -> Column:
    parts = _parts()
    return F.slice(parts, 1, F.size(parts) - 1)


def _definition_dirs() -> Column:
    """Paths of the walked ``job_definitions`` folders a file lies in."""
    depths = lambda fs: F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(fs), F.lit(1))),
        lambda i: (F.get(fs, i - 1) == "job_definitions") & F.forall(F.slice(fs, 1, i), _walked),
    )
    return X.let(_folders(), lambda fs: F.transform(depths(fs), lambda i: F.array_join(F.slice(fs, 1, i), "/")))


def platform_inference(listing: DataFrame) -> DataFrame:
    """(repo, kind, score, evidence): the platform with the highest score, ties by signal order. Every
    signal is one aggregate, so a repository of any size is merged map-side."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    folders = _folders()
    dag = path.startswith("dags/") & path.endswith(".py") & text.rlike(rf"airflow|{P.WORD_START}DAG{P.SPACE}*\(")
    task = (
        path.endswith(".sql")
        & F.forall(folders, _walked)
        & text.rlike(rf"(?i){P.WORD_START}CREATE{P.SPACE}+(OR{P.SPACE}+REPLACE{P.SPACE}+)?TASK{P.WORD_END}")
    )
    signals = listing.groupBy("repo").agg(
        F.max(path == "dbt_project.yml").alias("dbt"),
        F.min(F.when(dag, path)).alias("dag"),
        F.max(F.size(_definition_dirs()) > 0).alias("defs"),
        F.max(path.startswith("databricks/") | (path == "databricks.yml")).alias("bricks"),
        F.min(F.when(task, path)).alias("task"),
    )

    def platform(kind: str, order: int, *hits: tuple[Column, int, Column]) -> Column:
        score = sum((F.when(on, F.lit(weight)).otherwise(0) for on, weight, _ in hits), F.lit(0))
        why = F.array_compact(F.array(*[F.when(on, reason) for on, _, reason in hits]))
        return F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(kind).alias("kind"), why.alias("evidence"))

    ranked = F.array(
        platform("dbt", 0, (F.col("dbt"), 3, F.lit("dbt_project.yml in repo root"))),
        platform("airflow", 1, (F.col("dag").isNotNull(), 3, F.concat(F.lit("DAG code in "), "dag"))),
        platform(
            "databricks", 2,
            (F.col("defs"), 3, F.lit("a job_definitions/ dir in the repo")),
            (F.col("bricks"), 2, F.lit("databricks/ in repo root")),
        ),
        platform("snowflake_tasks", 3, (F.col("task").isNotNull(), 3, F.concat(F.lit("CREATE TASK in "), "task"))),
    )
    best = signals.select("repo", F.array_max(ranked).alias("best"))
    return best.where(F.col("best.score") > 0).select("repo", "best.kind", "best.score", "best.evidence")


def jobs_dir_inference(listing: DataFrame) -> DataFrame:
    """(repo, jobs_dir, key_prefixes): the first candidate folder whose children look like job folders,
    with its prefixes; ``jobs`` without prefixes when there is none."""
    parts = _parts()
    child = F.get(parts, F.lit(1))
    known = F.array(*[F.lit(c) for c in CANDIDATES])
    top = F.get(parts, F.lit(0))
    found = (
        listing.where((F.size(parts) >= 3) & child.rlike(JOB_FOLDER))
        .select("repo", top.alias("top"), F.regexp_extract(child, JOB_FOLDER, 1).alias("prefix"))
        .where(_usable_path(F.col("top")) & (F.col("top").isin(CANDIDATES) | ~F.col("top").startswith(".")))
        .distinct()
    )
    place = F.coalesce(
        F.nullif(F.array_position(known, F.col("top")), F.lit(0).cast("bigint")), F.lit(len(CANDIDATES) + 1).cast("bigint")
    )
    best = (
        found.groupBy("repo", "top")
        .agg(F.sort_array(F.collect_list("prefix")).alias("key_prefixes"))
        .groupBy("repo")
        .agg(F.min(F.struct(place.alias("place"), "top", "key_prefixes")).alias("b"))
        .select("repo", F.col("b.top").alias("jobs_dir"), "b.key_prefixes")
    )
    return (
        listing.select("repo").distinct().join(best, "repo", "left")
        .select(
            "repo", F.coalesce("jobs_dir", F.lit("jobs")).alias("jobs_dir"),
            F.coalesce("key_prefixes", F.array().cast("array<string>")).alias("key_prefixes"),
        )
    )


def definition_dir_inference(listing: DataFrame) -> DataFrame:
    """(repo, env, dir): environments of the first usable ``job_definitions`` folder; the folder itself
    counts as prod when no subfolder is usable."""
    placed = (
        listing.select("repo", "path", F.explode(_definition_dirs()).alias("defs"))
        .withColumn("rest", F.split(F.expr("substring(path, length(defs) + 2)"), "/"))
        .select("repo", "defs", F.when(F.size("rest") > 1, F.get("rest", F.lit(0))).alias("env"))
        .distinct()
    )
    env_path = F.concat_ws("/", "defs", "env")
    usable_env = F.col("env").isNotNull() & F.col("env").rlike(NAME) & _usable_path(env_path)
    options = placed.withColumn("ok", F.coalesce(usable_env, F.lit(False)))
    per_dir = options.groupBy("repo", "defs").agg(F.max("ok").alias("has_env"))
    chosen = (
        per_dir.where(F.col("has_env") | _usable_path(F.col("defs")))
        .groupBy("repo")
        .agg(F.min(F.struct(F.split("defs", "/").alias("parts"), "defs", "has_env")).alias("c"))
        .select("repo", "c.defs", "c.has_env")
    )
    envs = options.where("ok").join(chosen.where("has_env").select("repo", "defs"), ["repo", "defs"], "left_semi").select(
        "repo", "env", env_path.alias("dir")
    )
    whole = chosen.where("not has_env").select("repo", F.lit("prod").alias("env"), F.col("defs").alias("dir"))
    return envs.unionByName(whole)


def layout_inference(listing: DataFrame) -> DataFrame:
    """(repo, item, name, value): the jobs folder, its key prefixes and the definition folders."""
    jobs = jobs_dir_inference(listing)
    rows = F.concat(
        F.array(F.struct(F.lit("jobs_dir").alias("item"), F.lit("").alias("name"), F.col("jobs_dir").alias("value"))),
        F.transform(
            "key_prefixes", lambda p: F.struct(F.lit("key_prefix").alias("item"), F.lit("").alias("name"), p.alias("value"))
        ),
    )
    return jobs.select("repo", F.explode(rows).alias("r")).select("repo", "r.*").unionByName(
        definition_dir_inference(listing).select(
            "repo", F.lit("job_def_dir").alias("item"), F.col("env").alias("name"), F.col("dir").alias("value")
        )
    )
