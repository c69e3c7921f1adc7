"""Drift of every definition of an estate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import definitions, drift
from ..session import settle
from ..sources.policy import config_of


def comparable(job_def: DataFrame, config: DataFrame) -> DataFrame:
    """Live definitions, and of the repository's the one that stands for each job."""
    live = job_def.where(F.col("side") == "live")
    return live.unionByName(definitions.first_definitions(job_def, config_of(config, job_def)))


def _compared(pairs: DataFrame) -> DataFrame:
    return drift.compared_jobs(pairs.where(F.col("ext") == "json"))


def _leaf_drift(pairs: DataFrame) -> DataFrame:
    return drift.definition_drift(drift.definition_leaves(pairs), _compared(pairs))


def definition_drift(job_def: DataFrame, config: DataFrame) -> DataFrame:
    return _leaf_drift(settle(comparable(job_def, config), "definition-sides"))


def drift_summary(job_def: DataFrame, config: DataFrame, platforms: DataFrame) -> DataFrame:
    """Leaves, DDL and the list of jobs read the chosen definitions from one written table instead of choosing them each."""
    config = config_of(config, job_def)
    pairs = settle(comparable(job_def, config), "definition-sides")
    return drift.drift_summary(_compared(pairs), _leaf_drift(pairs), drift.ddl_drift(pairs), config, platforms)
