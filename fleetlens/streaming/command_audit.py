"""Streaming command audit, and the table of SQL file verdicts it reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.commands import audit_with, named_files, sql_verdicts
from ..session import path_exists, settle
from ..sources.sinks import bucketed, read_published, replace_rows

FILE = ["repo", "path"]


@dataclass(frozen=True)
class SqlVerdicts:
    """What is known about every SQL file, as a table in folders by (repo, hash of the path). A file is read when it has
    changed and never for a command."""

    spark: SparkSession
    path: str

    SCHEMA = "repo string, path string, verb string"

    def update(self, changed: DataFrame, read: Callable[[DataFrame], DataFrame]) -> None:
        """Judge some files (repo, path) anew. ``read`` gets them and returns those that exist with their ``text``; the others are
        forgotten."""
        keys = settle(bucketed(changed.select(*FILE).distinct(), "path"), "changed-files")
        if keys.isEmpty():
            return
        verdicts = sql_verdicts(read(keys.select(*FILE)).join(keys.select(*FILE), FILE, "left_semi"))
        replace_rows(self.path, self.SCHEMA, bucketed(verdicts, "path"), keys, FILE)

    def of(self, files: DataFrame) -> DataFrame:
        """(repo, path, verb) from the folders in which some files (repo, path) lie."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return read_published(self.spark, self.path, self.SCHEMA, bucketed(files.select(*FILE).distinct(), "path")).drop("bucket")


def sql_verdict_stream(
    changes: DataFrame, read: Callable[[DataFrame], DataFrame], verdicts: SqlVerdicts, checkpoint: str
) -> StreamingQuery:
    """Keep the verdicts up to date with a stream of changed files (repo, path). A batch reads the files it names and no others;
    one that comes again ends with the same table."""

    def keep(batch: DataFrame, _: int) -> None:
        verdicts.update(batch.select("repo", X.resolved_path(F.col("path")).alias("path")), read)

    return (
        changes.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def command_audit_stream(commands: DataFrame, verdicts: SqlVerdicts, out: str, checkpoint: str) -> StreamingQuery:
    """Decide every command of a stream exactly once.

    A micro-batch is audited like a table and written to the folder of its batch id. A batch that is
    replayed after a failure replaces that folder, so no decision is lost or doubled. Of the SQL files' verdicts it reads the
    folders of those that its commands name.
    """

    def audit(batch: DataFrame, batch_id: int) -> None:
        (
            audit_with(batch, verdicts.of(named_files(batch)))
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(out)
        )

    return (
        commands.writeStream.foreachBatch(audit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
