"""Definitions read as VARIANT against Python's parser."""

from __future__ import annotations

import json
import random

from conftest import tuples
from pyspark.sql import functions as F

from fleetlens.functions import pyhelpers
from fleetlens.functions import strict_json as J
from fleetlens.operators import definitions, drift
from fleetlens.sources.schemas import JOB_DEF

NUMBERS = ["0", "1", "-0", "-7", "1.0", "1.50", "-0.0", "0.1", "1e5", "1E-3", "12.5e+3", "100000.0", "9223372036854775807", "12345678901234567890", "123456789012345678901234567890123456789012", "NaN", "-Infinity", "Infinity", "1e999", "0.30000000000000004"]
BROKEN = [
    "", " ", "{", "}", '{"a": 1} x', "1, 2", "1],[2", '{"a": x}', "[1,]", '{"a" 1}', "01", "01.5", "1.", ".5", "+1", "1.5.2", "1.5e", "1.5 2.5", "{1.5: 2}", "{1: 2}", '{"a": 1.5 : 2}', "'a'", "tru",
    '"a\nb"', '"\\x"', '{"a": 1}{"b": 2}', '1.5"a"', "-", "1 .5", "nan", "[NaN NaN]", "﻿{}", '{"a": "b}', "/* c */ {}", "[1.0.0]",
]


def draw_value(draw, depth=0):
    kind = draw.choice(["n", "n", "s", "b", "list", "dict", "dict"] if depth < 3 else ["n", "s", "b"])
    if kind == "n":
        return draw.choice(NUMBERS)
    if kind == "s":
        return json.dumps(draw.choice(["", "x", "1.5", "a, b: c", 'q"\\', "é 👍\n\t", "1e5", "NaN", "\x1f\x7f", "[1.0]"]), ensure_ascii=draw.random() < 0.5)
    if kind == "b":
        return draw.choice(["true", "false", "null"])
    pad = lambda: draw.choice(["", " ", "\n", "\t "])
    if kind == "list":
        return "[" + ",".join(pad() + draw_value(draw, depth + 1) + pad() for _ in range(draw.randint(0, 4))) + "]"
    keys = ["name", "settings", "schedule", "tasks", "job_clusters", "job_id", "a", "é", "quartz_cron_expression", "timezone_id", "pause_status", "x.y", "a-b", ""]
    return "{" + ",".join(f"{pad()}{json.dumps(draw.choice(keys))}{pad()}:{pad()}{draw_value(draw, depth + 1)}" for _ in range(draw.randint(0, 5))) + "}"


def described(raw):
    """What a definition says of itself, by Python's parser."""
    spec = json.loads(raw)
    as_dict = lambda v: v if isinstance(v, dict) else {}
    top = as_dict(spec)
    settings = as_dict(top.get("settings", top))
    schedule = as_dict(settings.get("schedule"))
    text = lambda v: v if isinstance(v, str) else None
    return (
        isinstance(spec, dict), bool(top.get("name") or as_dict(top.get("settings")).get("name")), text(top.get("name")), text(settings.get("name")),
        text(schedule.get("quartz_cron_expression")), text(schedule.get("timezone_id")), text(schedule.get("pause_status")),
    )


def test_definitions_read_as_python_reads_them(spark):
    draw = random.Random(7)
    raws = ["{" + draw_value(draw, 0)[1:] if i % 3 == 0 else draw_value(draw, 0) for i in range(900)]
    raws += ['{"settings": 5, "name": "n"}', '{"settings": null, "name": 0.0}', '{"name": 1.0}', '{"name": [], "settings": {"name": {}}}', *BROKEN, *NUMBERS]

    def valid(raw):
        try:
            json.loads(raw)
        except (ValueError, RecursionError):
            return False
        return True

    rows = [("r", str(i), "repo", "prod", f"defs/{i}.json", str(i), "json", raw) for i, raw in enumerate(raws)]
    job_def = spark.createDataFrame([*rows, ("r", "null", "repo", "prod", "defs/null.json", "null", "json", None), ("r", "d", "repo", "prod", "d.sql", "d", "sql", "{")], JOB_DEF).repartition(4)
    got = {r.job_key: r for r in definitions.describe(job_def).collect()}
    assert got["d"].unparsed is None and got["d"].is_object is None and got["null"].unparsed == ""
    for i, raw in enumerate(raws):
        r = got[str(i)]
        if not valid(raw):
            assert r.unparsed == raw and r.is_object is False and r.has_name is False, raw
        else:
            assert r.unparsed is None, raw
            assert (r.is_object, r.has_name, r.top_name, r.name, r.cron, r.tz, r.pause) == described(raw), raw
    assert sum(not valid(raw) for raw in raws) > len(BROKEN) - 3
    errors = {r.job_key: (r.error_line, r.error_msg) for r in definitions.with_errors(definitions.describe(job_def)).collect()}
    assert len(errors) == len(raws) + 2 and all((errors[str(i)][0] is None) == valid(raw) for i, raw in enumerate(raws))

    leaves: dict[str, dict] = {}
    for r in drift.definition_leaves(job_def).collect():
        assert r.path not in leaves.setdefault(r.job_key, {})
        leaves[r.job_key][r.path] = r.val
    value = lambda path, text: sorted(map(repr, v)) if isinstance(v := json.loads(text), list) and path in pyhelpers.UNORDERED_LISTS else repr(v)
    for i, raw in enumerate(raws):
        want = dict(pyhelpers.definition_leaves(raw))
        mine = leaves.get(str(i), {})
        assert mine.keys() == want.keys(), raw
        assert all(value(p, mine[p]) == value(p, want[p]) for p in want), (raw, mine, want)


def test_equal_numbers_are_equal_and_kinds_differ(spark):
    pairs = [("1.0", "1.00", True), ("1.0", "1", False), ("[1, 1.0]", "[1.0, 1]", False), ("1e5", "100000.0", True), ("[1e2]", "[100.0]", True), ("-0", "0", True), ('"1.0"', "1.0", False), ('{"a":1,"b":2}', '{"b": 2, "a": 1}', True)]
    rows = spark.createDataFrame([(a, b, same) for a, b, same in pairs], "a string, b string, same boolean")
    text = lambda c: J.to_text(J.parsed(F.concat(F.lit('{"v":'), c, F.lit("}"))))
    wrong = rows.withColumn("x", text(F.col("a"))).withColumn("y", text(F.col("b"))).where((F.col("x") == F.col("y")) != F.col("same"))
    assert tuples(wrong, "a", "b", "x", "y") == []
    assert spark.range(1).select(text(F.lit('{"z": [1, {"y": 2.0, "b": ", :"}], "a": "é"}')).alias("t")).first().t == '{"v": {"a": "é", "z": [1, {"b": ", :", "y": 2.0}]}}'


def test_well_formed_definitions_need_no_python(spark):
    raw = json.dumps({"name": "n", "schedule": {"quartz_cron_expression": "0 1"}, "tasks": [{"k": 1.5}], "a": {"b": {"c": 1}}})
    job_def = spark.createDataFrame([("r", "j", "repo", "prod", "d/j.json", "j", "json", raw)], JOB_DEF)
    for df in (definitions.describe(job_def), drift.definition_leaves(job_def)):
        assert "Arrow" not in df._jdf.queryExecution().executedPlan().toString() and df.count()
    assert tuples(drift.definition_leaves(job_def), "path", "val") == [
        ("a.b.c", "1"), ("name", '"n"'), ("schedule.quartz_cron_expression", '"0 1"'), ("tasks", '[{"k": 1.5}]'),
    ]
