"""Published catalog against a fresh one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import lookup_join

KEY = ["repo", "dir"]


def _content_hash(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def catalog_staleness(fresh: DataFrame, published: DataFrame) -> DataFrame:
    """Fresh rows that are not published as they are: (repo, dir, reason)."""
    now = fresh.select(*KEY, _content_hash(fresh).alias("now"))
    was = published.select(*KEY, _content_hash(published).alias("was"))
    return now.join(was, KEY, "left").where(~F.col("now").eqNullSafe(F.col("was"))).select(
        *KEY, F.when(F.col("was").isNull(), F.lit("missing")).otherwise(F.lit("changed")).alias("reason")
    )


def catalog_orphans(fresh: DataFrame, published: DataFrame) -> DataFrame:
    """Published rows without a fresh counterpart; names compare without case."""
    folded = [F.lower("repo").alias("r"), F.lower("dir").alias("d")]
    return (
        published.select(*KEY, *folded)
        .join(fresh.select(*folded).distinct(), ["r", "d"], "left_anti")
        .select(*KEY)
    )


def stale_summaries(enrichment: DataFrame, folders: DataFrame, docs: DataFrame) -> DataFrame:
    """Curated summaries written against another version of the job's doc."""
    curated = enrichment.where(
        (F.coalesce("summary", F.lit("")) != "") & (F.coalesce("claude_md_hash", F.lit("")) != "")
    ).select("repo", "ticket", "claude_md_hash")
    current = folders.join(docs.select("repo", "job_dir", "content_sha256"), ["repo", "job_dir"])
    return lookup_join(current, curated, ["repo", "ticket"], "inner").where(
        F.col("claude_md_hash") != F.col("content_sha256")
    ).select("repo", "ticket", "job_dir")
