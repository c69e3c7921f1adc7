"""The job catalog, its summary and its reverse indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.ranks import ranked
from ..functions.skew import lookup_join, row_join, settled_lookup


def job_folders(dirs: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Folders whose name carries a job key: (repo, job_dir, ticket)."""
    named = dirs.select("repo", "job_dir").distinct()
    if config is None:
        keyed = named.withColumn("ticket", X.job_key(F.col("job_dir")))
    else:
        prefixes = config.select("repo", F.col("project.key_prefixes").alias("prefixes"))
        keyed = lookup_join(named, prefixes, ["repo"]).withColumn(
            "ticket", X.job_key(F.col("job_dir"), F.col("prefixes"))
        )
    return keyed.where(F.col("ticket").isNotNull()).select("repo", "job_dir", "ticket")


def job_catalog(
    folders: DataFrame,
    doc_fields: DataFrame,
    facts: DataFrame,
    schedules: DataFrame,
    enrichment: DataFrame,
    config: DataFrame,
) -> DataFrame:
    """One row per job folder. Curated values win over the doc, the doc over the definition; the
    deployed schedule wins over prose and the notebook header over every other status."""
    doc = doc_fields.select(
        "repo", "job_dir",
        *[F.col(c).alias(f"doc_{c}") for c in ("name", "purpose", "schedule", "owner", "status")],
        F.col("content_sha256").alias("doc_hash"),
        F.lit(True).alias("has_doc"),
    )
    found = facts.withColumnRenamed("status", "hdr_status").withColumnRenamed("last_updated", "hdr_updated").withColumnRenamed(
        "objects", "code_objects"
    )
    curated = enrichment.select(
        "repo", "ticket",
        *[F.col(c).alias(f"cur_{c}") for c in ("name", "summary", "owner", "status", "date", "objects")],
        F.col("claude_md_hash").alias("cur_hash"),
    )
    deployed = schedules.select(
        "repo", "job_key", F.col("name").alias("def_name"), F.col("cron").alias("def_cron")
    )
    conf = config.select(
        "repo",
        F.coalesce("project.jobs_dir", F.lit("jobs")).alias("jobs_dir"),
        F.nullif(F.col("project.ticket_url_template"), F.lit("")).alias("url_template"),
    )
    # Wide rows come last, so that few columns are dealt out again.
    rows = row_join(folders, curated, ["repo", "ticket"])
    rows = row_join(rows.withColumn("job_key", F.lower("ticket")), deployed, ["repo", "job_key"])
    rows = lookup_join(rows, conf, ["repo"])
    rows = row_join(row_join(rows, doc, ["repo", "job_dir"]), found, ["repo", "job_dir"])

    c, dash = F.col, F.lit(X.DASH)
    no_text = F.array().cast("array<string>")
    return rows.select(
        "repo",
        "ticket",
        c("job_dir").alias("dir"),
        X.either(c("cur_name"), c("doc_name"), c("def_name"), c("job_dir")).alias("name"),
        X.either(c("cur_summary"), c("doc_purpose"), dash).alias("purpose"),
        X.either(c("def_cron"), c("doc_schedule"), dash).alias("schedule"),
        X.either(c("cur_owner"), c("doc_owner"), dash).alias("owner"),
        F.coalesce("flags", no_text).alias("flags"),
        _status().alias("status"),
        X.either(c("hdr_updated"), c("cur_date"), dash).alias("last_updated"),
        _link().alias("link"),
        F.coalesce("has_doc", F.lit(False)).alias("has_claude_md"),
        F.coalesce(
            X.either(c("cur_summary")).isNotNull() & (X.either(c("cur_hash")) != c("doc_hash")), F.lit(False)
        ).alias("stale"),
        _objects().alias("objects"),
        F.replace(c("url_template"), F.lit("{id}"), c("ticket")).alias("url"),
    )


def _status() -> Column:
    return X.strip(X.either(F.col("hdr_status"), F.col("doc_status"), F.col("cur_status"), F.lit("Unknown")))


def _link() -> Column:
    return F.concat(X.url_path(F.concat_ws("/", F.coalesce("jobs_dir", F.lit("jobs")), "job_dir")), F.lit("/"))


def _objects() -> Column:
    """Curated objects, then those of the code, each in its first casing."""
    none = F.array().cast("array<string>")
    named = F.filter(F.transform(F.coalesce("cur_objects", none), X.strip), lambda o: o.isNotNull() & (o != ""))
    return X.distinct_fold_case(F.concat(named, F.coalesce("code_objects", none)))


def object_rows(folders: DataFrame, objects: DataFrame, enrichment: DataFrame, config: DataFrame) -> DataFrame:
    """Of the catalog only what its object indexes and edges need: (repo, ticket, dir, link, objects). No doc, header or definition
    is read."""
    curated = enrichment.select("repo", "ticket", F.col("objects").alias("cur_objects"))
    conf = config.select("repo", F.col("project.jobs_dir").alias("jobs_dir"))
    rows = lookup_join(row_join(folders, curated, ["repo", "ticket"]), conf, ["repo"])
    rows = row_join(rows, objects.withColumnRenamed("objects", "code_objects"), ["repo", "job_dir"])
    return rows.select("repo", "ticket", F.col("job_dir").alias("dir"), _link().alias("link"), _objects().alias("objects"))


def status_rows(folders: DataFrame, doc_fields: DataFrame, facts: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Of the catalog only what its summary counts: (repo, ticket, dir, status, flags, has_claude_md). No object or definition is read."""
    doc = doc_fields.select("repo", "job_dir", F.col("status").alias("doc_status"), F.lit(True).alias("has_doc"))
    found = facts.withColumnRenamed("status", "hdr_status")
    curated = enrichment.select("repo", "ticket", F.col("status").alias("cur_status"))
    rows = row_join(folders, curated, ["repo", "ticket"])
    rows = row_join(row_join(rows, doc, ["repo", "job_dir"]), found, ["repo", "job_dir"])
    return rows.select(
        "repo", "ticket", F.col("job_dir").alias("dir"), _status().alias("status"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("has_doc", F.lit(False)).alias("has_claude_md"),
    )


def flag_rows(folders: DataFrame, mentions: DataFrame) -> DataFrame:
    """Of the catalog only (repo, ticket, dir, flags), for jobs that have any."""
    return row_join(folders, mentions, ["repo", "job_dir"], "inner").select("repo", "ticket", F.col("job_dir").alias("dir"), "flags")


def in_catalog_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("repo", X.key_number(F.col("ticket")), "ticket", "dir")


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Per repository: jobs, jobs per status (known statuses first), jobs with deprecated references and
    jobs without a doc, as (repo, ord, metric, n)."""
    counts = catalog.groupBy("repo", "status").agg(
        F.count("*").alias("n"),
        F.count_if(F.size("flags") > 0).alias("deprecated"),
        F.count_if(~F.col("has_claude_md")).alias("no_doc"),
    )
    known = F.array(*[F.lit(s) for s in P.STATUS_ORDER])
    rank = F.nullif(F.array_position(known, F.col("status")), F.lit(0).cast("bigint"))
    by_status = counts.select(
        "repo",
        F.coalesce(rank, F.lit(len(P.STATUS_ORDER) + 1).cast("bigint")).cast("int").alias("ord"),
        F.concat(F.lit("status:"), "status").alias("metric"),
        "n",
    )
    totals = counts.groupBy("repo").agg(
        F.sum("n").alias("jobs"), F.sum("deprecated").alias("deprecated"), F.sum("no_doc").alias("no_doc")
    )
    overall = totals.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("ord"), F.lit("jobs").alias("metric"), F.col("jobs").alias("n")),
                F.struct(F.lit(8).alias("ord"), F.lit("with deprecated refs").alias("metric"), F.col("deprecated").alias("n")),
                F.struct(F.lit(9).alias("ord"), F.lit("without doc").alias("metric"), F.col("no_doc").alias("n")),
            )
        ).alias("m"),
    ).select("repo", "m.ord", "m.metric", "m.n")
    return by_status.unionByName(overall)


def dealt_by_ticket(catalog: DataFrame) -> DataFrame:
    """Catalog rows with those of a ticket in one partition, so that what is counted by ticket needs no further shuffle. They are dealt out
    before their objects become rows of their own, in all partitions: short rows make few large files, and many entries."""
    return catalog.repartition(int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo", "ticket")


def object_entries(catalog: DataFrame) -> DataFrame:
    """(repo, object_key, object, place, ticket, dir, ...): an object of a folder; ``place`` orders
    entries as the catalog does. A ticket's number is read once for each folder, before its objects become rows."""
    known = [c for c in ("link", "name", "last_updated") if c in catalog.columns]
    folders = catalog.select("repo", "ticket", "dir", *known, X.key_number(F.col("ticket")).alias("num"), "objects")
    return folders.select("repo", "ticket", "dir", *known, "num", F.posexplode("objects").alias("pos", "object")).select(
        "repo",
        F.lower("object").alias("object_key"),
        "object",
        F.struct("num", "ticket", "dir", "pos").alias("place"),
        "ticket", "dir", *known,
    )


def object_labels(catalog: DataFrame) -> DataFrame:
    """Per object of a repository: the casing of its first entry and its number of folders."""
    keys = ["repo", "object_key"]
    return (
        object_entries(dealt_by_ticket(catalog.select("repo", "ticket", "dir", "objects")))
        .groupBy(F.xxhash64(*keys).alias("hash"), *keys)  # the hash keeps the sort off the strings
        .agg(F.min_by("object", "place").alias("object"), F.count("*").alias("n_jobs"))
        .drop("hash")
    )


def object_totals(catalog: DataFrame) -> DataFrame:
    """Per object of a repository: its first entry in catalog order, whose casing is the object's label, and the numbers of
    folders and tickets that have it."""
    edge, node = ["repo", "object_key", "ticket"], ["repo", "object_key"]
    by_ticket = (
        object_entries(dealt_by_ticket(catalog.select("repo", "ticket", "dir", "objects")))
        .groupBy(F.xxhash64(*edge).alias("hash"), *edge)  # the hash keeps the sort off the strings
        .agg(F.min(F.struct("place", "object")).alias("first"), F.count("*").alias("n"))
        .drop("hash")
    )
    return (
        by_ticket.groupBy(F.xxhash64(*node).alias("hash"), *node)
        .agg(F.min("first").alias("first"), F.sum("n").alias("n_jobs"), F.count("*").alias("n_tickets"))
        .select(*node, F.col("first.object").alias("object"), F.col("first.place").alias("first"), "n_jobs", "n_tickets")
    )


def object_index(catalog: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Object -> jobs, one row per (object, folder) with the object's label and folder count. Rows
    rather than a list per object: an object may occur in a large share of all jobs. ``labels`` are counted unless given."""
    entries = object_entries(catalog).select("repo", "object_key", "ticket", "dir", "link")
    labels = object_labels(catalog) if labels is None else labels.select("repo", "object_key", "object", "n_jobs")
    return lookup_join(entries, settled_lookup(labels, "object-labels"), ["repo", "object_key"], "inner").select(
        "repo", "object_key", "object", "n_jobs", "ticket", "dir", "link"
    )


def index_ranks(index: DataFrame) -> DataFrame:
    """The index with each job's ``rank`` among the jobs of its object: by number, then name."""
    return ranked(index, ["repo", "object_key"], [X.key_number(F.col("ticket")), F.col("ticket"), F.col("dir")])


def in_index_order(index: DataFrame) -> DataFrame:
    """Most used objects first, jobs of an object by number."""
    return index.orderBy("repo", F.desc("n_jobs"), "object_key", X.key_number(F.col("ticket")), "ticket", "dir")


def migration_map(catalog: DataFrame) -> DataFrame:
    """Deprecated schema -> every job still on it, one row each, with the schema's number of jobs."""
    uses = catalog.select("repo", F.explode("flags").alias("schema"), "ticket", "dir")
    sizes = uses.groupBy("repo", "schema").agg(F.count("*").alias("n_jobs"))
    return lookup_join(uses, settled_lookup(sizes, "schema-sizes"), ["repo", "schema"], "inner").select(
        "repo", "schema", "n_jobs", "ticket", "dir"
    )
