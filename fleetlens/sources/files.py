"""Scans of repository trees. Layout under every root: ``<repo>/<jobs dir>/<job folder>/...``, where each repository's
configuration may name its jobs folder and its definition folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import path_exists
from . import listing, schemas


def _bases(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """Full names of the root folders, as the paths of their files begin."""
    bases = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        bases += [status.getPath().toString().rstrip("/") for status in found or []]
    return bases


def job_paths(
    spark: SparkSession, roots: Sequence[str], jobs: DataFrame, jobs_dir: str = "jobs", config: DataFrame | None = None
) -> list[str]:
    """Folders of the given jobs (repo, job_dir) below the roots, as far as they exist. Meant for the few jobs of a micro-batch, whose
    folders can then be scanned without listing the rest of the tree."""
    own = _with_config(jobs.select("repo", "job_dir").distinct(), config, own_dir="project.jobs_dir")
    top = F.rtrim(F.coalesce(F.col("own_dir").cast("string"), F.lit(jobs_dir)), F.lit("/"))
    inner = [r["p"] for r in own.select(F.concat_ws("/", "repo", X.resolved_path(top), "job_dir").alias("p")).orderBy("p").collect()]
    return [p for root in roots for p in (f"{root.rstrip('/')}/{x}" for x in inner) if path_exists(spark, p)]


def _repositories(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(repo, path, uri): the folders right below the roots, the path in them empty."""
    return listing.repositories(spark, _bases(spark, roots))


def _below(repos: DataFrame, inner: Column) -> DataFrame:
    """The folder ``inner`` of each repository, as (repo, path, uri) and the other columns."""
    path = X.resolved_path(inner)
    return repos.withColumn("path", path).withColumn("uri", F.concat("uri", F.when(path != "", F.concat(F.lit("/"), path)).otherwise("")))


def _decoded(content: Column) -> Column:
    """Text of a file: undecodable bytes replaced, line ends made ``\\n``."""
    return X.unix_newlines(F.make_valid_utf8(content.cast("string")))


def _with_config(files: DataFrame, config: DataFrame | None, **fields: str) -> DataFrame:
    """Add fields of the repository's configuration, null where it has none."""
    if config is None:
        return files.select("*", *[F.lit(None).alias(name) for name in fields])
    own = config.groupBy("repo").agg(*[F.first(F.expr(field), ignorenulls=True).alias(name) for name, field in fields.items()])
    return files.join(own, "repo", "left")


def list_job_files(
    spark: SparkSession,
    roots: Sequence[str],
    name_glob: str = "*",
    jobs_dir: str = "jobs",
    config: DataFrame | None = None,
    folders: Sequence[str] | None = None,
    levels: int | None = None,
) -> DataFrame:
    """Files below the job folders, without their texts: (repo, job_dir, path, uri, rest, length, modified), ``rest`` being the path
    below the job folder. The configuration joins the repositories; nothing outside their jobs folders is listed. ``folders`` (of
    ``job_paths``) limit the listing to some jobs, ``levels`` how deep it goes below the jobs folder."""
    tops = _with_config(_repositories(spark, roots), config, own_dir="project.jobs_dir")
    starts = _below(tops, F.coalesce(F.col("own_dir").cast("string"), F.lit(jobs_dir))).withColumnRenamed("path", "top")
    places = starts.select("repo", F.col("top").alias("path"), "uri")
    if folders is not None:
        last = F.substring_index("folder", "/", -1)
        named = spark.createDataFrame([(f,) for f in _bases(spark, folders)], "folder string")
        own = named.withColumn("uri", F.regexp_replace("folder", "/[^/]*$", "")).join(places, "uri")
        places = own.select("repo", F.concat_ws("/", F.nullif("path", F.lit("")), last).alias("path"), F.col("folder").alias("uri"))
        levels = None if levels is None else levels - 1
    found = listing.walk(places, name_glob, levels)
    tops = starts.select("repo", "top").distinct()
    inner = F.substr("path", F.when(F.col("top") == "", 1).otherwise(F.length("top") + 2))
    below = found.join(tops, "repo").withColumn("inner", inner).where(F.contains("inner", F.lit("/")))
    return below.withColumn("job_dir", F.substring_index("inner", "/", 1)).select(
        "repo", "job_dir", "path", "uri", F.substr("inner", F.length("job_dir") + 2).alias("rest"), "length", "modified"
    )


def scan_source_files(
    spark: SparkSession,
    roots: Sequence[str],
    name_glob: str = "*.{py,sql}",
    jobs_dir: str = "jobs",
    config: DataFrame | None = None,
    folders: Sequence[str] | None = None,
) -> DataFrame:
    """Every source file below the job folders, with its whole text. A repository's own ``project.jobs_dir`` goes
    before ``jobs_dir``. ``folders`` (of ``job_paths``) limit the scan to some jobs."""
    found = list_job_files(spark, roots, name_glob, jobs_dir, config, folders)
    return listing.with_content(found).select(
        "repo",
        "job_dir",
        "path",
        F.lower(F.element_at(F.split("path", r"\."), -1)).alias("ext"),
        _decoded(F.col("content")).alias("text"),
        F.col("length").alias("n_bytes"),
    )


def scan_tree(spark: SparkSession, roots: Sequence[str], name_glob: str = "*") -> DataFrame:
    """Every file below the roots as (path, text, n_bytes); files that are no UTF-8 text are left out."""
    return (
        listing.with_content(listing.walk(_repositories(spark, roots), name_glob))
        .where(F.is_valid_utf8(F.col("content").cast("string")))
        .select(F.col("uri").alias("path"), _decoded(F.col("content")).alias("text"), F.col("length").alias("n_bytes"))
    )


def scan_job_docs(
    spark: SparkSession,
    roots: Sequence[str],
    doc_name: str = "claude.md",
    jobs_dir: str = "jobs",
    key_prefixes: Sequence[str] = (),
    config: DataFrame | None = None,
    folders: Sequence[str] | None = None,
) -> DataFrame:
    """The doc directly inside each job folder whose name carries a job key. A repository's own jobs folder and key
    prefixes go before the given ones. ``folders`` (of ``job_paths``) limit the scan to some jobs."""
    found = list_job_files(spark, roots, doc_name, jobs_dir, config, folders, levels=2)
    given = F.array(*[F.lit(p) for p in key_prefixes]).cast("array<string>")
    own = _with_config(found.select("repo").distinct(), config, own_prefixes="project.key_prefixes")
    prefixes = F.coalesce(F.col("own_prefixes").cast("array<string>"), given)
    keyed = found.join(own, "repo").where(X.job_key(F.col("job_dir"), prefixes).isNotNull()).drop("own_prefixes")
    return listing.with_content(keyed).select(
        "repo",
        "job_dir",
        _decoded(F.col("content")).alias("text"),
        F.sha2("content", 256).alias("content_sha256"),
    )


def scan_definitions(
    spark: SparkSession,
    roots: Sequence[str],
    name_glob: str = "*.{json,sql}",
    defs_dir: str = "job_definitions",
    config: DataFrame | None = None,
) -> DataFrame:
    """Definitions directly in the folders that a repository's ``platform.job_def_dirs`` names, with the environment it
    names them for; without such a list, in ``.../<defs_dir>/<env>/``. The key is the file stem before ``_``."""
    found = listing.walk(_repositories(spark, roots), name_glob)
    own = _with_config(found.select("repo").distinct(), config, own_dirs="platform.job_def_dirs")
    files = found.join(own, "repo")
    folder = F.regexp_replace("path", r"/?[^/]*\z", "")
    own = F.filter(F.map_entries(F.col("own_dirs").cast("map<string,string>")), lambda e: F.rtrim(e["value"], F.lit("/")) == folder)
    named = F.regexp_extract(folder, r"(?:^|/)\Q" + defs_dir + r"\E/([^/]+)\z", 1)
    env = F.when(F.col("own_dirs").isNull(), F.nullif(named, F.lit(""))).otherwise(F.get(own, F.lit(0))["key"])
    path = F.col("path")
    wanted = files.withColumn("env", env).where("env is not null").drop("own_dirs")
    return listing.with_content(wanted).select(
        "repo",
        F.lower(F.substring_index(X.file_stem(path), "_", 1)).alias("job_key"),
        F.lit("repo").alias("side"),
        "env",
        "path",
        X.file_stem(path).alias("stem"),
        F.lower(F.element_at(F.split(path, r"\."), -1)).alias("ext"),
        _decoded(F.col("content")).alias("raw"),
    )


def parse_enrichment(docs: DataFrame) -> DataFrame:
    """(repo, raw JSON) -> one row per curated job. A malformed document gives none; of entries with
    the same ticket the last one counts."""
    entries = docs.select("repo", F.from_json("raw", schemas.ENRICHMENT_DOC).alias("doc")).select(
        "repo", F.posexplode("doc.jobs").alias("pos", "job")
    )
    last = entries.where(F.col("job.ticket").isNotNull()).groupBy("repo", F.col("job.ticket").alias("ticket")).agg(
        F.max_by("job", "pos").alias("job")
    )
    return last.select(
        "repo", "ticket", "job.name", "job.summary", "job.owner", "job.status", "job.date", "job.objects",
        "job.claude_md_hash",
    )


def load_enrichment(
    spark: SparkSession, roots: Sequence[str], name: str = "index_data.json", jobs_dir: str = "jobs", config: DataFrame | None = None
) -> DataFrame:
    """Curated summaries of ``<repo>/<jobs dir>/index_data.json``."""
    tops = _with_config(_repositories(spark, roots), config, own_dir="project.jobs_dir")
    starts = _below(tops, F.coalesce(F.col("own_dir").cast("string"), F.lit(jobs_dir)))
    found = listing.with_content(listing.walk(starts, name, levels=1))
    return parse_enrichment(found.select("repo", _decoded(F.col("content")).alias("raw")))
