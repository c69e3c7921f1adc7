"""Time the headline queries: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores), ``BENCH_QUERIES``
(comma-separated names). Prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.plans.queries import QUERIES  # noqa: E402
from fleetlens.session import build_session  # noqa: E402

HEADLINE = [
    "source_lines", "object_refs", "policy_refs", "deprecated_mentions", "notebook_headers", "pip_requirements",
    "syntax_findings", "job_catalog", "object_index", "graph_object_nodes", "related_jobs", "migration_map",
    "arch_findings", "compliance_summary", "doc_lint", "vulnerable_pins", "job_gate", "secret_shape_scan",
    "denylist_scan", "definition_drift", "drift_summary", "live_name_resolution", "trigger_conflicts",
    "failure_triage", "command_audit", "command_audit_stream", "config_field_violations", "platform_inference",
    "layout_inference", "catalog_refresh_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.sql.shuffle.partitions": str(max(int(cpus), 8)), "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that no measured one pays for starting the JVM's workers.
    QUERIES["run_status"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found[1].rstrip("/.")) if found else None,
    }))


if __name__ == "__main__":
    main()
