"""Installed packages against advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import lookup_join

PIN = ["package", "version"]


def open_advisories(advisory: DataFrame, allow: DataFrame) -> DataFrame:
    """Advisories that are not grandfathered: (package, version, vuln_id)."""
    return advisory.distinct().join(allow, [*PIN, "vuln_id"], "left_anti")


def vulnerable_pins(pins: DataFrame, advisory: DataFrame, allow: DataFrame) -> DataFrame:
    """(job, package, version, vuln_id) of pinned versions with an open advisory, one row per advisory."""
    pinned = pins.where(F.col("version").isNotNull())
    known = open_advisories(advisory, allow)
    return lookup_join(pinned, known, PIN, "inner").select("repo", "job_dir", *PIN, "vuln_id")


def unpinned_installs(pins: DataFrame) -> DataFrame:
    """Distinct packages per job whose version is left open."""
    return pins.where(F.col("version").isNull()).select("repo", "job_dir", "package").distinct()
