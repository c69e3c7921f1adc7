"""Audit of shell commands: guarded platform commands and warehouse writes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.skew import lookup_join

PASS, ASK = "pass", "ask"
EVENT = ["event_id", "ts", "repo", "kind", "cmd"]


def first_rule(kind: Column, dequoted: Column, rules: Sequence[tuple] = tuple(P.GUARD_RULES)) -> Column:
    """Name of the first guard rule of the platform that matches, else null. The rules are a fixed list
    per platform, so they are literals of one expression."""
    by_kind: dict[str, list[tuple]] = {}
    for rule in sorted(rules, key=lambda r: (r[0], r[1])):
        by_kind.setdefault(rule[0], []).append(rule)
    found = F.lit(None).cast("string")
    for name, own in by_kind.items():
        tests = F.coalesce(
            *[F.when(dequoted.rlike(f"(?idU){pattern}"), F.lit(rule)) for _, _, rule, pattern in own]
        )
        found = F.when(kind == name, tests).otherwise(found)
    return found


def warehouse_cli(dequoted: Column) -> Column:
    """The warehouse client a command calls, also by a full path; null if none."""
    return F.coalesce(
        *[
            F.when(
                F.contains(dequoted, F.lit(cli)) & dequoted.rlike(rf"(?U)(^|[\s;&|(/]){re.escape(cli)}(\s|$)"),
                F.lit(cli),
            )
            for cli in P.WAREHOUSE_CLIS
        ]
    )


def destructive_verb(dequoted: Column) -> Column:
    """First destructive SQL verb, upper case; null if none."""
    return F.upper(X.first_group(dequoted, P.DESTRUCTIVE_SQL))


def sql_verdicts(sql_files: DataFrame) -> DataFrame:
    """(repo, path, verb) of each SQL file, read whole: all a command needs to know about it, so texts are
    never shuffled."""
    return sql_files.select("repo", "path", destructive_verb(X.dequoted(F.col("text"))).alias("verb"))


def _file_refs(cmd: Column) -> Column:
    """Files named by ``-f``/``--file``-like flags, then those read by ``<``; outer quotes trimmed."""
    raw = F.concat(
        F.regexp_extract_all(cmd, F.lit(P.SQL_FILE_FLAG), F.lit(1)),
        F.regexp_extract_all(cmd, F.lit(P.SQL_STDIN), F.lit(1)),
    )
    return F.filter(
        F.transform(raw, lambda r: F.regexp_replace(r, r"""^['"]+|['"]+\z""", "")), lambda r: r != ""
    )


def named_files(commands: DataFrame, *keep: str) -> DataFrame:
    """One row per command and SQL file it names: (event_id, repo, cwd, ord, ref, path) and what is kept."""
    cwd, ref = F.coalesce("cwd", F.lit("")), F.col("ref")
    return commands.select(
        "event_id", "repo", *keep, cwd.alias("cwd"), F.posexplode(_file_refs(F.col("cmd"))).alias("ord", "ref")
    ).withColumn(
        "path",
        X.resolved_path(F.when((F.col("cwd") != "") & ~ref.startswith("/"), F.concat_ws("/", "cwd", "ref")).otherwise(ref)),
    )


def _file_scans(commands: DataFrame, verdicts: DataFrame, *keep: str) -> DataFrame:
    return lookup_join(named_files(commands, *keep), verdicts, ["repo", "path"])


def referenced_sql_scan(commands: DataFrame, sql_files: DataFrame) -> DataFrame:
    """(event_id, repo, ord, path, verb): the SQL files each command names, with what the scan of the file
    found. Paths are relative to the repository root or to the event's folder in it."""
    return _file_scans(commands, sql_verdicts(sql_files)).select("event_id", "repo", "ord", "path", "verb")


def _decide(commands: DataFrame) -> DataFrame:
    """Decision per command from rule, cli, own verb and what its files hold."""
    verb = F.coalesce("verb", "file_verb")
    reason = (
        F.when(F.col("rule").isNotNull(), F.concat(F.lit("platform:"), "kind", F.lit(":"), "rule"))
        .when(F.col("cli").isNotNull() & verb.isNotNull(), F.concat(F.lit("warehouse:"), "cli", F.lit(":"), verb))
    )
    return commands.withColumn("reason", reason).select(
        *EVENT, F.when(F.col("reason").isNull(), F.lit(PASS)).otherwise(F.lit(ASK)).alias("decision"), "reason"
    )


def command_audit(
    commands: DataFrame, sql_files: DataFrame, rules: Sequence[tuple] = tuple(P.GUARD_RULES)
) -> DataFrame:
    return audit_with(commands, sql_verdicts(sql_files), rules)


def audit_with(
    commands: DataFrame, verdicts: DataFrame, rules: Sequence[tuple] = tuple(P.GUARD_RULES)
) -> DataFrame:
    """One decision per command: the platform's guarded commands first, then destructive SQL sent through
    a warehouse client, inline or in a file. ``verdicts`` are those of the SQL files (repo, path, verb).

    Only commands that call a client, name a file and are not decided yet take the join; all others are
    decided row by row without a shuffle.
    """
    plain = X.dequoted(F.col("cmd"))
    ruled = X.computed_once(
        commands.select("event_id", "ts", "repo", "kind", "cwd", "cmd"), rule=first_rule(F.col("kind"), plain, rules)
    )
    called = X.computed_once(ruled, cli=F.when(F.col("rule").isNull(), warehouse_cli(plain)))
    own = X.computed_once(called, verb=F.when(F.col("cli").isNotNull(), destructive_verb(plain)))
    names_file = F.size(_file_refs(F.col("cmd"))) > 0
    tested = X.computed_once(own, open=F.col("cli").isNotNull() & F.col("verb").isNull() & names_file)
    direct = tested.where(~F.col("open")).select(
        *EVENT, "rule", "cli", "verb", F.lit(None).cast("string").alias("file_verb")
    )
    waiting = tested.where("open").drop("verb")
    with_files = (
        _file_scans(waiting, verdicts, "ts", "kind", "cmd", "cli")
        .groupBy(*EVENT, "cwd", "cli")
        .agg(
            F.min_by("verb", F.when(F.col("verb").isNotNull(), F.col("ord"))).alias("file_verb"),
            # Equal events meet here; each named a first file once and comes out again.
            F.count_if(F.col("ord") == 0).cast("int").alias("times"),
        )
        .withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .drop("cwd", "times", "turn")
        .withColumn("rule", F.lit(None).cast("string"))
        .withColumn("verb", F.lit(None).cast("string"))
    )
    return _decide(direct.unionByName(with_files))


def guard_rule_parity(rules_a: DataFrame, rules_b: DataFrame) -> DataFrame:
    """Rules that occur in only one of two rule sets meant to be equal: (kind, ord, pattern, only_in)."""
    cols = ["kind", "ord", "pattern"]
    a, b = rules_a.select(*cols), rules_b.select(*cols)
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))
