"""Schema rules: deprecated schemas and layer references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import lookup_join

DEPRECATED = "deprecated"
VIOLATION = "layer-violation"


def arch_findings(refs: DataFrame, policy: DataFrame) -> DataFrame:
    """Judge every policy reference against its repository's rules, in one pass over the references.

    A sanctioned reference passes. Else the first denied part makes it deprecated. Else, in a file that
    declares a layer with a rule, the schema must be that layer or one it may read.
    """
    rules = policy.select("repo", "deny", "exceptions", "hints", "layer_rules")
    judged = lookup_join(refs, rules, ["repo"], "inner")
    ref, layer, parts = F.upper("ref"), F.col("layer"), F.col("parts")
    denied = F.try_element_at(F.filter(parts, lambda p: F.array_contains(F.col("deny"), p)), F.lit(1))
    hint = F.coalesce(
        F.nullif(F.try_element_at("hints", ref), F.lit("")),
        F.nullif(F.try_element_at("hints", F.col("denied")), F.lit("")),
    )
    allowed = F.col("allowed")
    crosses = (
        allowed.isNotNull() & (F.col("ref_schema") != layer) & ~F.array_contains(allowed, F.col("ref_schema"))
    )
    names = F.array_sort(F.array_distinct(allowed))
    listed = F.when(F.size(names) == 0, F.lit("none")).otherwise(
        F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))
    )
    return (
        judged.where(~F.array_contains("exceptions", ref))
        .withColumn("denied", denied)
        .withColumn("allowed", F.try_element_at("layer_rules", layer))
        .withColumn("ref_schema", F.try_element_at(parts, F.lit(-2)))
        .withColumn("kind", F.when(F.col("denied").isNotNull(), F.lit(DEPRECATED)).when(crosses, F.lit(VIOLATION)))
        .where(F.col("kind").isNotNull())
        .withColumn("hint", hint)
        .select(
            "repo",
            "job_dir",
            F.col("path").alias("file"),
            F.col("line_no").alias("line"),
            "occ",
            "ref",
            F.coalesce("denied", "ref_schema").alias("schema"),
            "kind",
            F.when(
                F.col("kind") == DEPRECATED,
                F.concat(
                    F.lit("references deprecated schema "), "denied",
                    F.coalesce(F.concat(F.lit(" — migrate to "), "hint"), F.lit("")),
                ),
            )
            .otherwise(
                F.concat(
                    F.lit("layer "), layer, F.lit(" may not reference "), "ref_schema",
                    F.lit(" (allowed: "), listed, F.lit(")"),
                )
            )
            .alias("message"),
        )
    )


def deprecated_refs(refs: DataFrame, policy: DataFrame) -> DataFrame:
    return arch_findings(refs, policy).where(F.col("kind") == DEPRECATED)


def layer_violations(refs: DataFrame, policy: DataFrame) -> DataFrame:
    return arch_findings(refs, policy).where(F.col("kind") == VIOLATION)


def compliance_summary(findings: DataFrame) -> DataFrame:
    """Per job: layer violations, which fail it, and deprecated references, which are debt."""
    return (
        findings.groupBy("repo", "job_dir")
        .agg(
            F.count_if(F.col("kind") == VIOLATION).alias("n_violations"),
            F.count_if(F.col("kind") == DEPRECATED).alias("n_deprecated"),
        )
        .withColumn("ok", F.col("n_violations") == 0)
    )
