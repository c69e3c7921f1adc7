"""Published results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import freshness
from ..session import path_exists, release_shuffles, settle


#: Formats whose files are plain text unless compressed.
TEXT_FORMATS = {"json", "csv", "text", "xml"}

#: Findings that are dealt out in one round, about 80 bytes each in shuffle files.
ROUND_ROWS = 20_000_000


def write_findings(df: DataFrame, path: str, fmt: str = "json", by: str = "repo") -> None:
    """Findings as JSON lines (or another format), one folder per repository. Lines of text repeat most of what the one before says, so
    files of text are compressed.

    Many findings are dealt out repository by repository in several rounds, so that no more than a round's rows lie in shuffle files at a
    time. The first round replaces what is there; a run that breaks off after it has to be repeated.
    """
    spark, rows = df.sparkSession, settle(df, "findings-rows")
    rounds = max(1, -(-rows.count() // ROUND_ROWS))
    for i in range(rounds):
        some = rows if rounds == 1 else rows.where(F.pmod(F.xxhash64(by), F.lit(rounds)) == i)
        writer = some.hint("rebalance", by).write.mode("append" if i else "overwrite").partitionBy(by).format(fmt)
        (writer.option("compression", "gzip") if fmt in TEXT_FORMATS else writer).save(path)
        if rounds > 1:
            release_shuffles(spark)


#: Folders of a repository in a published table: a changed job rewrites one of them.
BUCKETS = 8


def bucketed(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def read_published(spark: SparkSession, path: str, schema: str, places: DataFrame | None = None) -> DataFrame:
    """Rows of a published table with their ``bucket``. What vanished has left a tombstone only. ``places`` (repo, bucket) limits
    the scan to some folders; Spark's index of the table lists as many, so their names fit the driver."""
    stored = spark.read.schema(schema + ", bucket int, tombstone boolean").parquet(path)
    if places is not None:
        wanted = F.lit(False)
        for repo, own in sorted(_by_repo(places).items()):
            wanted = wanted | ((F.col("repo") == repo) & F.col("bucket").isin(own))
        stored = stored.where(wanted)
    return stored.where(~F.col("tombstone")).select(*StructType.fromDDL(schema).names, "bucket")


def _by_repo(places: DataFrame) -> dict[str, list[int]]:
    own = places.select("repo", "bucket").distinct().groupBy("repo").agg(F.array_sort(F.collect_set("bucket")).alias("b"))
    return {r["repo"]: list(r["b"]) for r in own.collect()}


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Published catalog rows."""
    return read_published(spark, path, schema).drop("bucket")


def overwrite_places(rows: DataFrame, places: DataFrame, path: str) -> None:
    """Replace the folders named by ``places`` (repo, bucket), and no others, by ``rows``; one that gets no row keeps a
    tombstone. ``rows`` must not read the folders that they replace. The rebalance hint sizes the files and splits a
    hot folder over several tasks."""
    empty = places.select("repo", "bucket").distinct().join(rows.select("repo", "bucket").distinct(), ["repo", "bucket"], "left_anti")
    gone = empty.select(*[F.col(c) if c in ("repo", "bucket") else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    kept = rows.withColumn("tombstone", F.lit(False)).unionByName(gone.withColumn("tombstone", F.lit(True)))
    (
        kept.hint("rebalance", "repo", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo", "bucket")
        .parquet(path)
    )


def replace_rows(path: str, schema: str, rows: DataFrame, keys: DataFrame, on: list[str]) -> None:
    """Replace the published rows of some keys by ``rows``. Both have their ``bucket``; folders without one of the keys are
    neither read nor written. Doing so twice changes nothing."""
    places = keys.select("repo", "bucket").distinct()
    spark = rows.sparkSession
    fresh = rows.select(*StructType.fromDDL(schema).names, "bucket")
    if path_exists(spark, path):
        kept = read_published(spark, path, schema, places).join(keys.select(*on), on, "left_anti")
        fresh = kept.unionByName(fresh)
    overwrite_places(settle(fresh, "new-rows"), places, path)


def publish(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """First snapshot of a table, in folders by repository and hash of ``key``."""
    placed = bucketed(rows, key, buckets).withColumn("tombstone", F.lit(False))
    placed.hint("rebalance", "repo", "bucket").write.mode("overwrite").partitionBy("repo", "bucket").parquet(path)


def publish_catalog(fresh: DataFrame, path: str) -> None:
    """First snapshot of a catalog."""
    publish(fresh, path, catalog_key(fresh))


def catalog_key(rows: DataFrame) -> str:
    """Folders of one ticket lie together, so that what counts tickets finds them together."""
    return "ticket" if "ticket" in rows.columns else "dir"


def write_catalog(fresh: DataFrame, path: str) -> None:
    """Publish a new snapshot: rewrite the folders in which a row changed, appeared or vanished and leave the
    others alone.

    Safe to repeat: the same input gives the same folders. Where nothing is published yet, all of it is.
    """
    if not path_exists(fresh.sparkSession, path):
        publish_catalog(fresh, path)
        return
    fresh = settle(bucketed(fresh, catalog_key(fresh)), "fresh-catalog")
    plain = fresh.drop("bucket")
    published = read_published(fresh.sparkSession, path, fresh_schema(plain))
    key = catalog_key(fresh)
    changed = freshness.catalog_staleness(plain, published.drop("bucket")).select("repo", "dir")
    orphans = freshness.catalog_orphans(plain, published.drop("bucket")).select("repo", "dir")
    touched = fresh.join(changed, ["repo", "dir"], "left_semi").select("repo", "bucket").union(
        published.join(changed.union(orphans), ["repo", "dir"], "left_semi").select("repo", "bucket")
    )
    places = settle(touched.distinct(), f"changed-{key}-folders")
    overwrite_places(fresh.join(places, ["repo", "bucket"], "left_semi"), places, path)


def fresh_schema(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
