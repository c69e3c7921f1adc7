"""Small per-batch Python helpers: strict JSON and Python syntax have no built-in Spark function.

Each runs inside ``mapInArrow``; Spark partitions the rows and no row needs another one. The module
is pickled by value, so workers need not have the package installed.
"""

from __future__ import annotations

import ast
import json
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Identity fields the platform assigns, and lists whose order carries no meaning.
ASSIGNED_FIELDS = {"job_id", "created_time", "creator_user_name", "effective_budget_policy_id", "settings"}
UNORDERED_LISTS = {"tasks", "job_clusters"}


def _as_dict(value) -> dict:
    return value if isinstance(value, dict) else {}


def json_error(raw: str) -> tuple[int | None, str | None]:
    """(line, message) of what is wrong with a text that should be JSON."""
    try:
        json.loads(raw)
    except json.JSONDecodeError as err:
        return err.lineno, err.msg
    except (ValueError, RecursionError) as err:
        return 1, str(err)
    return 1, "too large or too deep"


def definition_leaves(raw: str | None) -> list[tuple[str, str]]:
    """(dotted path, JSON value) of every authored setting; lists stay whole."""
    try:
        spec = json.loads(raw if raw is not None else "")
    except (ValueError, RecursionError):
        return []
    spec = _as_dict(spec)
    if isinstance(spec.get("settings"), dict):
        spec = spec["settings"]
    found: list[tuple[str, str]] = []
    pending = [((key,), value) for key, value in spec.items() if key not in ASSIGNED_FIELDS]
    while pending:
        path, value = pending.pop()
        if isinstance(value, dict):
            pending += [((*path, key), inner) for key, inner in value.items()]
            continue
        if len(path) == 1 and isinstance(value, list) and path[0] in UNORDERED_LISTS:
            # Two such lists are equal when their items are, so the items stand in the order of their JSON.
            found.append((path[0], f"[{', '.join(sorted(json.dumps(item, sort_keys=True, ensure_ascii=False) for item in value))}]"))
            continue
        found.append((".".join(map(str, path)), json.dumps(value, sort_keys=True, ensure_ascii=False)))
    # A literal dotted key can spell the same path as a nested one; the later key of the document wins.
    return list(dict(reversed(found)).items())


def parse_failure(source: str) -> tuple[int | None, str] | None:
    """(line, message) where a source is no valid Python. Parsed, never run."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
    except SyntaxError as err:
        return err.lineno, err.msg
    except (ValueError, RecursionError, MemoryError) as err:
        return None, str(err) or type(err).__name__
    return None


def error_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append line and message of what is wrong with the JSON of ``unparsed``."""
    for batch in batches:
        errors = [json_error(raw) for raw in batch["unparsed"].to_pylist()]
        columns = {field.name: batch[field.name] for field in batch.schema}
        columns["error_line"] = pa.array([line for line, _ in errors], pa.int64())
        columns["error_msg"] = pa.array([msg for _, msg in errors], pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def leaf_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per leaf; the key columns are repeated."""
    for batch in batches:
        found = [definition_leaves(raw) for raw in batch["raw"].to_pylist()]
        rows = pa.array([i for i, leaves in enumerate(found) for _ in leaves], pa.int64())
        columns = {f.name: batch[f.name].take(rows) for f in batch.schema if f.name != "raw"}
        columns["path"] = pa.array([path for leaves in found for path, _ in leaves], pa.string())
        columns["val"] = pa.array([val for leaves in found for _, val in leaves], pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def syntax_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file that parses neither as it stands (``text``) nor without its magic lines (``bare``)."""
    for batch in batches:
        pairs = zip(batch["text"].to_pylist(), batch["bare"].to_pylist(), strict=True)
        errors = [parse_failure(text) and parse_failure(bare) for text, bare in pairs]
        bad = pa.array([i for i, error in enumerate(errors) if error is not None], pa.int64())
        hits = [error for error in errors if error is not None]
        columns = {name: batch[name].take(bad) for name in ("repo", "job_dir", "path")}
        columns["line"] = pa.array([line for line, _ in hits], pa.int64())
        columns["msg"] = pa.array([msg for _, msg in hits], pa.string())
        yield pa.RecordBatch.from_pydict(columns)
