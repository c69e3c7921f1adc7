"""Command and file-change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def shell_commands(events: DataFrame) -> DataFrame:
    """Shell events with a non-blank command."""
    cmd = F.coalesce("tool_input.command", F.lit(""))
    return events.where((F.col("tool_name") == "Bash") & cmd.rlike(r"(?U)\S")).select(
        "event_id", "ts", "repo", "kind", "cwd", cmd.alias("cmd")
    )


def load_commands(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON command events of a folder, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return shell_commands(reader.schema(schemas.COMMAND_EVENT).json(path))


def load_file_changes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.FILE_CHANGE).json(path)
