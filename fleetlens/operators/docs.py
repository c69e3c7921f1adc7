"""Documentation completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.skew import lookup_join


#: Names that one pattern over the text can't spell; each is looked for by itself.
_ODD = {"header_fields": r"(?U)[\n:=]|^\s|\s\z", "doc_fields": r"(?U)[\n*]"}


def odd_fields(required: DataFrame, column: str) -> list[str]:
    """Required names of a configuration column that no pattern over all names can spell. Ordinary names never count here."""
    names = required.select(F.explode(column).alias("f")).where(F.col("f").rlike(_ODD[column])).distinct()
    return sorted(r["f"] for r in names.collect())


def _and_odd(names: Column, text: Column, odd: Sequence[str], before: str, after: str) -> Column:
    return F.concat(names, *[F.when(text.rlike(before + X.quoted(f) + after), F.array(F.lit(f))).otherwise(F.array().cast("array<string>")) for f in odd])


def doc_labels(docs: DataFrame, odd: Sequence[str] = ()) -> DataFrame:
    """(repo, job_dir, labels): the ``**Label**:`` names of a doc that have a value. Rules are held against these names, so texts
    meet no join."""
    text = F.col("text")
    labels = F.array_distinct(F.regexp_extract_all(text, F.lit(P.DOC_LABEL), F.lit(1)))
    return docs.select(
        "repo", "job_dir", _and_odd(labels, text, odd, r"(?md)^\*\*", rf"\*\*:{P.SPACE}*{P.NON_SPACE}").alias("labels")
    )


def header_names(text: Column, odd: Sequence[str] = ()) -> Column:
    """The ``# FIELD:`` names of a notebook's text, whose line ends are all ``\\n``."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(P.HEADER_KEY), F.lit(1)))
    return _and_odd(names, text, odd, rf"(?md)^#{P.SPACE}*", rf"{P.SPACE}*[:=]")


def notebook_names(files: DataFrame, odd: Sequence[str] = ()) -> DataFrame:
    """(repo, job_dir, path, names) of the notebooks directly in a job folder."""
    notebooks = files.where(X.is_direct_notebook()).select("repo", "job_dir", "path", X.one_line_end(F.col("text")).alias("book"))
    return notebooks.select("repo", "job_dir", "path", header_names(F.col("book"), odd).alias("names"))


def best_headers(names: DataFrame, required: DataFrame) -> DataFrame:
    """Per job with a notebook directly in its folder: the required header fields of the notebook that
    has most of them, the first by path on a tie. At most the configured fields per row."""
    ruled = lookup_join(names, required.select("repo", "header_fields"), ["repo"], "inner").withColumn(
        "present", F.filter("header_fields", lambda f: F.array_contains("names", f))
    )
    best = F.struct((-F.size("present")).alias("rank"), X.path_order(F.col("path")).alias("place"))
    return ruled.groupBy("repo", "job_dir").agg(F.min_by("present", best).alias("present"))


def doc_lint(folders: DataFrame, docs: DataFrame, files: DataFrame, required: DataFrame) -> DataFrame:
    """Problems of each job's documentation: (repo, job_dir, problem)."""
    labels = doc_labels(docs, odd_fields(required, "doc_fields"))
    return doc_problems(folders, labels, notebook_names(files, odd_fields(required, "header_fields")), required)


def doc_problems(folders: DataFrame, labels: DataFrame, names: DataFrame, required: DataFrame) -> DataFrame:
    """The same from the names that docs and notebooks have."""
    jobs = lookup_join(folders.select("repo", "job_dir"), required, ["repo"], "inner")
    state = jobs.join(labels, ["repo", "job_dir"], "left").join(best_headers(names, required), ["repo", "job_dir"], "left")
    blank = F.filter("doc_fields", lambda f: ~F.array_contains("labels", f))
    doc_problems = F.when(F.col("labels").isNull(), F.array(F.lit("missing claude.md"))).otherwise(
        F.transform(blank, lambda f: F.concat(F.lit("claude.md missing **"), f, F.lit("**")))
    )
    header_problems = F.when(
        F.col("present").isNull(), F.array(F.lit("no .py notebook found to check header"))
    ).otherwise(
        F.transform(
            F.filter("header_fields", lambda f: ~F.array_contains(F.col("present"), f)),
            lambda f: F.concat(F.lit("notebook header missing # "), f),
        )
    )
    return state.select("repo", "job_dir", F.explode(F.concat(doc_problems, header_problems)).alias("problem"))


def doc_coverage(folders: DataFrame, problems: DataFrame) -> DataFrame:
    """Per repository: jobs, jobs without a problem, jobs without a doc, problems."""
    per_job = problems.groupBy("repo", "job_dir").agg(
        F.count("*").alias("n"), F.count_if(F.col("problem") == "missing claude.md").alias("no_doc")
    )
    return (
        folders.select("repo", "job_dir")
        .join(per_job, ["repo", "job_dir"], "left")
        .groupBy("repo")
        .agg(
            F.count("*").alias("n_jobs"),
            F.count_if(F.col("n").isNull()).alias("n_documented"),
            F.count_if(F.col("no_doc") > 0).alias("n_without_doc"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_problems"),
        )
    )
