"""Rule sets that are written down in several places: read each place's text into rows, then hold them against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

RULE = ["repo", "kind", "pattern"]


def _rules(files: DataFrame, kind: Column, patterns: Column) -> DataFrame:
    found = files.select("repo", kind.alias("kind"), F.explode(patterns).alias("pattern"))
    return found.where((F.coalesce("kind", F.lit("")) != "") & (F.col("pattern") != "")).distinct()


def adapter_rules(files: DataFrame) -> DataFrame:
    """Rules in code (repo, kind, pattern): one platform per file, named by its ``kind``, with the patterns of its rules."""
    text = X.unix_newlines(F.col("text"))
    patterns = F.regexp_extract_all(text, F.lit(P.CODE_PATTERN), F.lit(1))
    return _rules(files, X.first_group(text, P.CODE_KIND), patterns)


def fallback_rules(files: DataFrame) -> DataFrame:
    """Rules of the copy that code falls back to: several platforms per file, a list under each name."""
    text = X.unix_newlines(F.col("text"))
    names = F.regexp_extract_all(text, F.lit(P.FALLBACK_SECTION), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(P.FALLBACK_SECTION), F.lit(2))
    sections = files.select("repo", F.explode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("s"))
    return _rules(sections, F.col("s.name"), F.regexp_extract_all("s.body", F.lit(P.CODE_PATTERN), F.lit(1)))


def playbook_rules(files: DataFrame) -> DataFrame:
    """Rules in the front matter of playbooks: the list under ``destructive_patterns``, quoted or plain, without comments."""
    head = X.first_group(X.unix_newlines(F.col("text")), P.FRONT_MATTER)
    block = F.regexp_extract(head, P.PLAYBOOK_LIST, 1)
    items = F.regexp_extract_all(block, F.lit(P.PLAYBOOK_ITEM), F.lit(1))
    quoted = lambda q: (lambda i: F.replace(F.substr(i, F.lit(2), F.length(i) - 2), F.lit(q + q), F.lit(q)))
    plain = F.transform(
        items,
        lambda i: F.when(i.rlike(r"\A'.*'\z"), quoted("'")(i)).when(i.rlike(r'\A".*"\z'), quoted('"')(i)).otherwise(i),
    )
    return _rules(files, X.first_group(head, r"(?md)^kind:[ \t]*([A-Za-z0-9_]+)"), plain)


def rule_set_parity(code: DataFrame, **others: DataFrame) -> DataFrame:
    """Rules that only one of the code and another set has: (repo, kind, pattern, source, only_in). Platforms that the code does not
    know are the other set's own business; a platform that another set lacks altogether gives a row for each of its rules.

    All sets meet in one aggregation on the rule.
    """
    tagged = [s.select(*RULE, F.lit(n).alias("source")) for n, s in {"code": code, **others}.items()]
    has = lambda n: F.max(F.col("source") == n).alias(n)
    sets = reduce(DataFrame.unionByName, tagged).groupBy(*RULE).agg(has("code"), *[has(n) for n in others])
    known = code.select("repo", "kind").distinct()
    differs = F.array_compact(F.array(*[
        F.when(F.col("code") != F.col(n), F.struct(F.lit(n).alias("source"), F.when(F.col("code"), F.lit("code")).otherwise(F.lit(n)).alias("only_in")))
        for n in others
    ]))
    return sets.join(known, ["repo", "kind"], "left_semi").select(*RULE, F.explode(differs).alias("d")).select(*RULE, "d.source", "d.only_in")
