"""Run queries and their check SQL side by side: ``python tests/check_queries.py SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from fleetlens.plans.estate import GIVEN  # noqa: E402
from fleetlens.session import build_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in GIVEN:
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return db


def plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value


def sorted_rows(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(spark, db, sf_dir: str, name: str) -> tuple[str, int]:
    got = contract.queries()[name](spark, sf_dir)
    left = sorted_rows(got.columns, [tuple(r) for r in got.collect()])
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    right = sorted_rows(columns, cursor.fetchall())
    if sorted(got.columns) != sorted(columns):
        return f"columns {sorted(got.columns)} != {sorted(columns)}", len(left)
    if left != right:
        only_left, only_right = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        return f"{len(left)} vs {len(right)} rows\n   spark {only_left}\n   check {only_right}", len(left)
    return "", len(left)


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(contract.oracle_sql())
    spark = build_session(
        "check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem, n = compare(spark, db, sf_dir, name)
        except Exception as err:  # a broken query must not hide the others
            problem, n = f"{type(err).__name__}: {str(err)[:600]}", -1
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} {n:8d} {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal; without check SQL: {sorted(set(contract.queries()) - set(contract.oracle_sql()))}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
