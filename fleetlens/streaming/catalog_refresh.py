"""Streaming refresh of the published catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import catalog
from ..sources.published import Published

# Files and folders the catalog writes itself.
GENERATED_FILES = ["JOBS.md", "OBJECTS.md", "index_data.json"]
GENERATED_DIRS = ["graph", "objects"]


def catalog_edits(changes: DataFrame, jobs_dir: str = "jobs", config: DataFrame | None = None) -> DataFrame:
    """Changes that call for a new catalog: truly below the jobs folder, and not one of the files the
    catalog writes itself. A repository's own ``project.jobs_dir`` goes before ``jobs_dir``."""
    path, top = F.col("path"), F.col("_top")
    known = changes.withColumn("_top", F.lit(jobs_dir))
    if config is not None:
        own = config.groupBy("repo").agg(F.max("project.jobs_dir").alias("_own"))
        known = changes.join(own, "repo", "left").withColumn("_top", X.resolved_path(F.coalesce("_own", F.lit(jobs_dir))))
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    written = F.array(*[F.concat(top, F.lit(f"/{d}")) for d in GENERATED_DIRS])
    generated = X.file_name(path).isin(GENERATED_FILES) | F.array_contains(written, folder)
    found = known.withColumn("path", X.resolved_path(path)).where(path.startswith(F.concat(top, F.lit("/"))) & ~generated)
    return found.select(*changes.columns)


def touched_jobs(changes: DataFrame, jobs_dir: str = "jobs", config: DataFrame | None = None) -> DataFrame:
    """The job folders in which something changed: (repo, job_dir, ticket). Changes outside a folder with a job key touch none."""
    edits = catalog_edits(changes, jobs_dir, config)
    top = F.lit(jobs_dir)
    if config is not None:
        own = config.groupBy("repo").agg(F.max("project.jobs_dir").alias("own_dir"))
        edits, top = edits.join(own, "repo", "left"), F.coalesce("own_dir", F.lit(jobs_dir))
    inner = F.substr("path", F.length(X.resolved_path(top)) + 2)
    below = edits.select("repo", inner.alias("inner")).where(F.contains("inner", F.lit("/")))
    return catalog.job_folders(below.select("repo", F.substring_index("inner", "/", 1).alias("job_dir")), config)


def catalog_refresh_stream(
    changes: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    published: Published,
    checkpoint: str,
    jobs_dir: str = "jobs",
    config: DataFrame | None = None,
) -> StreamingQuery:
    """Rebuild the catalog rows of the jobs a micro-batch touches, and bring index and graph up to date with them.

    ``build`` gets the touched jobs as (repo, job_dir, ticket) and returns their fresh catalog rows; it should read the sources of
    these jobs only. The result depends on the sources alone, so a replayed batch ends with the same tables.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        published.refresh(touched_jobs(batch, jobs_dir, config), build, f"batch-{batch_id}")

    return (
        changes.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
