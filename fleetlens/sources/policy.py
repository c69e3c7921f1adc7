"""Rule tables from repository configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.skew import settled_lookup
from . import schemas


def load_repo_configs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per repository."""
    return spark.read.schema(schemas.REPO_CONFIG).json(path)


def config_of(config: DataFrame, rows: DataFrame) -> DataFrame:
    """The configurations of the repositories that rows belong to, as a written lookup: an estate may be configured for many more
    repositories than the rows at hand come from."""
    repos = settled_lookup(rows.select("repo").distinct(), "repos")
    return settled_lookup(config.join(repos, "repo", "left_semi"), "config")


def _texts(col) -> F.Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def policy_rows(config: DataFrame) -> DataFrame:
    """One row per repository with its schema rules upper-cased for matching. The arrays and maps come
    straight from the configuration row, so their size is that of one configuration file."""
    a = F.col("architecture")
    upper = lambda arr: F.transform(_texts(arr), F.upper)
    pairs = lambda m, value: F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(F.map_keys(m), F.upper)),
            lambda k: F.struct(
                k.alias("k"),
                value(F.element_at(F.filter(F.map_entries(m), lambda e: F.upper(e["key"]) == k), -1)["value"]).alias("v"),
            ),
        )
    )
    hints = F.coalesce(a["replace_hints"], F.create_map().cast("map<string,string>"))
    rules = F.coalesce(a["layer_rules"], F.create_map().cast("map<string,array<string>>"))
    return config.select(
        "repo",
        upper(a["deprecated_schema_deny"]).alias("deny"),
        upper(a["read_exceptions"]).alias("exceptions"),
        pairs(hints, lambda v: v).alias("hints"),
        pairs(rules, upper).alias("layer_rules"),
    )


def load_policy(config: DataFrame) -> dict[str, DataFrame]:
    """The same rules as long tables."""
    a, g = "architecture.", "governance."
    required = {
        "doc": F.col(g + "claude_md_required"),
        "header": F.col(g + "header_required"),
    }
    defaults = {"doc": P.DEFAULT_DOC_FIELDS, "header": P.DEFAULT_HEADER_FIELDS}
    fields = {
        kind: F.when(F.size(_texts(col)) > 0, col).otherwise(F.array(*[F.lit(f) for f in defaults[kind]]))
        for kind, col in required.items()
    }
    doc_rule = None
    for kind, col in fields.items():
        part = config.select("repo", F.lit(kind).alias("kind"), F.posexplode(col).alias("ord", "field"))
        doc_rule = part if doc_rule is None else doc_rule.unionByName(part)
    return {
        "deny": config.select("repo", F.posexplode(a + "deprecated_schema_deny").alias("ord", "term")).select(
            "repo", "ord", "term", F.upper("term").alias("schema")
        ),
        "read_exception": config.select("repo", F.explode(a + "read_exceptions").alias("ref")).select(
            "repo", F.upper("ref").alias("ref")
        ),
        "replace_hint": config.select("repo", F.explode(a + "replace_hints").alias("target", "hint")).select(
            "repo", F.upper("target").alias("target"), "hint"
        ),
        "layer_rule": config.select("repo", F.explode(a + "layer_rules").alias("layer", "allowed")).select(
            "repo", F.upper("layer").alias("layer"), F.explode("allowed").alias("allowed")
        ).select("repo", "layer", F.upper("allowed").alias("allowed")),
        "doc_rule": doc_rule,
    }


def required_fields(config: DataFrame) -> DataFrame:
    """(repo, doc_fields, header_fields) with the defaults filled in."""
    g = F.col("governance")
    either = lambda col, names: F.when(F.size(_texts(col)) > 0, col).otherwise(
        F.array(*[F.lit(n) for n in names])
    )
    return config.select(
        "repo",
        either(g["claude_md_required"], P.DEFAULT_DOC_FIELDS).alias("doc_fields"),
        either(g["header_required"], P.DEFAULT_HEADER_FIELDS).alias("header_fields"),
    )


def guard_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.GUARD_RULES, "kind string, ord int, rule string, pattern string")


def platform_dim(spark: SparkSession) -> DataFrame:
    """Platforms with an adapter: at most one row per known kind."""
    return spark.createDataFrame(P.ADAPTERS, "kind string, adapter_model string, active_states array<string>")
