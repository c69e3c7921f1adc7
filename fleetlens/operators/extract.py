"""What can be read off one file at a time. All functions are narrow up to the named aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.pyhelpers import syntax_batches
from ..functions.skew import lookup_join
from .docs import header_names


def source_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    keep = [c for c in files.columns if c not in ("text", "n_bytes")]
    plain = files.select(*keep, X.one_line_end(F.col("text")).alias("text"))
    return plain.select(*keep, F.posexplode(X.lines(F.col("text"))).alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).alias("line_no"), "line"
    )


# Facts for the catalog -------------------------------------------------------------------------
def _names(text: Column) -> Column:
    """Names after a SQL keyword, in code only: comments cut, import lines dropped."""
    code = F.regexp_replace(F.regexp_replace(X.one_line_end(text), P.LINE_COMMENT, ""), P.IMPORT_LINE_BODY, "")
    return F.regexp_extract_all(code, F.lit(P.CATALOG_REF), F.lit(1))


def _all_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(f"{P.WORD}+"), F.lit(0)))


def _dollar_names(text: Column) -> Column:
    """``$``-joined names; most texts have none."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"[\p{L}\p{N}_$]*\$[\p{L}\p{N}_$]*"), F.lit(0))
    return F.when(F.contains(text, F.lit("$")), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _notebook() -> Column:
    """Text of a notebook directly in the job folder, else null."""
    return F.when(X.is_direct_notebook(), X.one_line_end(F.col("text")))


def _header(fields: Column) -> Column:
    """STATUS and LAST_UPDATED among the header fields; null when it has neither. The first
    value of each counts."""

    def value(key: str) -> Column:
        own = F.filter(fields, lambda f: F.regexp_extract(f, P.HEADER_FIELD, 1) == key)
        return X.strip(F.regexp_extract(F.get(own, F.lit(0)), P.HEADER_FIELD, 2))

    return F.when(F.size(fields) > 0, F.struct(value("STATUS").alias("status"), value("LAST_UPDATED").alias("last_updated")))


def _denied(deny: DataFrame) -> DataFrame:
    """Denied schemas, a row per repository: ``plain`` names by their upper-case word, ``joined`` ones (with ``$``) by pattern. Of
    spellings that differ only in case the last configured one is reported. What is no identifier can't name a schema: it is a finding of
    the configuration audit and matches nothing."""
    upper = F.col("schema")
    tail = F.when(upper.endswith("$"), F.lit(f"(?={P.WORD})")).otherwise(F.lit(P.WORD_END))
    pattern = F.concat(F.lit(P.WORD_START + r"\Q"), upper, F.lit(r"\E"), tail)
    terms = deny.where(F.col("term").rlike(P.IDENTIFIER)).groupBy("repo", "schema").agg(F.max_by("term", "ord").alias("term"))
    listed = lambda condition, *fields: F.collect_list(F.when(condition, F.struct(*fields)))
    return terms.groupBy("repo").agg(
        listed(~upper.contains("$"), upper.alias("key"), "term").alias("plain"),
        listed(upper.contains("$"), pattern.alias("pattern"), "term").alias("joined"),
    )


def _with_mentions(parsed: DataFrame, deny: DataFrame) -> DataFrame:
    """``words`` and ``dollars`` of a file become the terms among them that its repository denies. Only lists of words meet
    the rules, and only hits go on."""
    ruled = lookup_join(parsed, _denied(deny), ["repo"])
    hits = F.array_intersect("words", F.coalesce(F.transform("plain", lambda p: p["key"]), F.array().cast("array<string>")))
    found = X.computed_once(ruled, hits=hits)
    plain = F.transform(F.filter("plain", lambda p: F.array_contains("hits", p["key"])), lambda p: p["term"])
    joined = F.transform(
        F.filter("joined", lambda p: F.exists("dollars", lambda s: F.rlike(s, p["pattern"]))), lambda p: p["term"]
    )
    none = F.array().cast("array<string>")
    terms = F.concat(F.when(F.size("hits") > 0, plain).otherwise(none), F.when(F.size("dollars") > 0, F.coalesce(joined, none)).otherwise(none))
    return found.withColumn("terms", terms).drop("words", "dollars", "plain", "joined", "hits")


def _place(files: DataFrame, **parsed: Column) -> DataFrame:
    """(repo, job_dir, ext_rank, place) and what was parsed from the text of each file."""
    return files.select(
        "repo",
        "job_dir",
        F.when(F.col("ext") == "sql", 0).otherwise(1).alias("ext_rank"),
        X.path_order(F.col("path")).alias("place"),
        *[column.alias(name) for name, column in parsed.items()],
    )


def _header_fields() -> Column:
    return F.regexp_extract_all(_notebook(), F.lit(P.HEADER_FIELD), F.lit(0))


def _by_job(parsed: DataFrame) -> DataFrame:
    """(repo, job_dir, files): what was read off each file of a folder, SQL files before Python files, in path order.

    A row per file is dealt out by folder and put together there. Merging before that would sort every task's rows, which saves
    nothing where the files of a folder are read in many tasks.
    """
    kept = [c for c in parsed.columns if c not in ("repo", "job_dir")]
    dealt = parsed.repartition("repo", "job_dir")
    return dealt.groupBy("repo", "job_dir").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("files"))


def _all_of(name: str) -> Column:
    """What all files of a folder list under a name, file by file."""
    return F.flatten(F.transform("files", lambda f: F.coalesce(f[name], F.array().cast("array<string>"))))


def _first_header() -> Column:
    return F.get(F.filter(F.transform("files", lambda f: f["header"]), lambda h: h.isNotNull()), F.lit(0))


def _flags() -> Column:
    return F.array_sort(F.array_distinct(_all_of("terms")))


def job_facts(files: DataFrame, deny: DataFrame) -> DataFrame:
    """Objects, header and denied schemas of every job, from one scan of the texts:
    (repo, job_dir, status, last_updated, objects, flags). ``objects`` holds the distinct
    names of one folder and ``flags`` at most the repository's deny list."""
    text = F.col("text")
    parsed = _place(files, names=_names(text), words=_all_words(text), dollars=_dollar_names(text), header=_header(_header_fields()))
    found = _by_job(_with_mentions(parsed, deny))
    facts = X.computed_once(found, header=_first_header(), objects=X.distinct_fold_case(_all_of("names")), flags=_flags())
    return facts.where("header is not null or size(objects) > 0 or size(flags) > 0").select(
        "repo", "job_dir", "header.status", "header.last_updated", "objects", "flags"
    )


def status_facts(files: DataFrame, deny: DataFrame) -> DataFrame:
    """(repo, job_dir, status, flags) as ``job_facts`` gives them, from one scan that looks for no objects."""
    text = F.col("text")
    parsed = _place(files, words=_all_words(text), dollars=_dollar_names(text), header=_header(_header_fields()))
    facts = X.computed_once(_by_job(_with_mentions(parsed, deny)), header=_first_header(), flags=_flags())
    return facts.where("header is not null or size(flags) > 0").select("repo", "job_dir", "header.status", "flags")


def object_lists(files: DataFrame) -> DataFrame:
    """(repo, job_dir, objects): the objects of every job as ``job_facts`` lists them, where nothing else is needed."""
    found = _by_job(_place(files, names=_names(F.col("text"))))
    return X.computed_once(found, objects=X.distinct_fold_case(_all_of("names"))).where("size(objects) > 0").select("repo", "job_dir", "objects")


def mention_lists(files: DataFrame, deny: DataFrame) -> DataFrame:
    """(repo, job_dir, flags): the same for denied schemas."""
    return deprecated_mentions(files, deny).groupBy("repo", "job_dir").agg(F.array_sort(F.collect_list("term")).alias("flags"))


def object_refs(files: DataFrame) -> DataFrame:
    """Data objects of every job in their first casing."""
    return object_lists(files).select("repo", "job_dir", F.explode("objects").alias("object")).select(
        "repo", "job_dir", F.lower("object").alias("object_key"), "object"
    )


def deprecated_mentions(files: DataFrame, deny: DataFrame) -> DataFrame:
    """Denied schemas named anywhere in a job's texts, comments included."""
    text = F.col("text")
    parsed = files.select("repo", "job_dir", _all_words(text).alias("words"), _dollar_names(text).alias("dollars"))
    return _with_mentions(parsed, deny).select("repo", "job_dir", F.explode("terms").alias("term")).distinct()


def notebook_headers(files: DataFrame) -> DataFrame:
    """STATUS and LAST_UPDATED of the first notebook that carries either."""
    found = X.computed_once(_by_job(_place(files, header=_header(_header_fields()))), header=_first_header())
    return found.where("header is not null").select("repo", "job_dir", "header.status", "header.last_updated")


# Policy references -----------------------------------------------------------------------------
def declared_layer(files: DataFrame) -> DataFrame:
    """First layer a file declares."""
    layer = F.upper(X.first_group(F.col("text"), P.LAYER_DECLARATION))
    return files.select("repo", "job_dir", "path", layer.alias("layer")).where(F.col("layer").isNotNull())


def policy_refs(files: DataFrame) -> DataFrame:
    """Every reference a policy looks at, with its line and the layer its file declares. Comments count,
    import lines do not; quotes are dropped."""
    numbered = source_lines(
        files.select(
            "repo", "job_dir", "path", "text",
            F.upper(X.first_group(F.col("text"), P.LAYER_DECLARATION)).alias("layer"),
        )
    )
    refs = F.regexp_extract_all("line", F.lit(P.POLICY_REF), F.lit(1))
    found = numbered.where(~F.col("line").rlike(P.IMPORT_LINE)).select(
        "repo", "job_dir", "path", "layer", "line_no", F.posexplode(refs).alias("occ", "raw")
    )
    return _named_parts(found)


def _named_parts(found: DataFrame) -> DataFrame:
    return found.withColumn("ref", X.without_quotes(F.col("raw"))).withColumn("parts", F.split(F.upper("ref"), r"\.")).drop("raw")


def file_facts(files: DataFrame, odd_headers: Sequence[str] = ()) -> DataFrame:
    """All that the gate reads off a file's text with patterns, from one scan, in one row: the layer it declares, its references by
    line, install lines and header names (null but for notebooks directly in a job folder). Files that say nothing of this are
    left out, notebooks never."""
    text = F.col("plain")
    refs = lambda line: F.when(
        ~line.rlike(P.IMPORT_LINE), F.regexp_extract_all(line, F.lit(P.POLICY_REF), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))
    by_line = F.transform("lines", lambda line, i: F.struct((i + 1).alias("line_no"), refs(line).alias("raw")))
    is_py = F.col("ext") == "py"
    # Each is read several times below.
    plain = X.computed_once(files.select("repo", "job_dir", "path", "ext", "text"), plain=X.one_line_end(F.col("text")))
    cut = X.computed_once(plain, lines=X.lines(text))
    found = X.computed_once(cut, refs=F.filter(by_line, lambda r: F.size(r["raw"]) > 0))
    return found.select(
        "repo", "job_dir", "path", "ext", F.upper(X.first_group(F.col("text"), P.LAYER_DECLARATION)).alias("layer"),
        "refs",
        F.when(is_py, _install_args(text)).alias("installs"),
        F.when(X.is_direct_notebook(), header_names(text, odd_headers)).alias("names"),
    ).where(is_py | (F.size("refs") > 0))


def policy_refs_of(facts: DataFrame) -> DataFrame:
    """``policy_refs`` from file facts."""
    lines = facts.select("repo", "job_dir", "path", "layer", F.explode("refs").alias("r"))
    return _named_parts(lines.select("repo", "job_dir", "path", "layer", "r.line_no", F.posexplode("r.raw").alias("occ", "raw")))


# Documentation, installs, syntax -----------------------------------------------------------------
def _doc_field(text: Column, label: str) -> Column:
    return X.strip(X.first_group(text, rf"(?md)^\*\*{label}\*\*:{P.SPACE}*(.+)$"))


def job_doc_fields(docs: DataFrame) -> DataFrame:
    """Name and labelled fields of a job doc. White space after a label may span lines, so an empty
    field takes the text that follows it."""
    text = F.col("text")
    title = F.coalesce(X.first_group(text, P.DOC_JOB_TITLE), X.first_group(text, P.DOC_TITLE))
    return docs.select(
        "repo",
        "job_dir",
        X.strip(title).alias("name"),
        _doc_field(text, "Purpose").alias("purpose"),
        _doc_field(text, "Schedule").alias("schedule"),
        _doc_field(text, "Business Owner").alias("owner"),
        _doc_field(text, "Status").alias("status"),
        "content_sha256",
    )


def _install_args(text: Column) -> Column:
    """What follows ``pip install`` on each line."""
    return F.regexp_extract_all(text, F.lit(P.PIP_INSTALL), F.lit(1))


def pip_requirements(files: DataFrame) -> DataFrame:
    """Distinct (job, package, version) of notebook installs; version is null where none is pinned."""
    notebooks = files.where(F.col("ext") == "py")
    return requirements(notebooks.select("repo", "job_dir", _install_args(X.one_line_end(F.col("text"))).alias("installs")))


def requirements(notebooks: DataFrame) -> DataFrame:
    """The same from the install lines of notebooks (repo, job_dir, installs)."""
    arg = F.col("arg")
    tokens = (
        notebooks.select("repo", "job_dir", F.explode("installs").alias("args"))
        .select("repo", "job_dir", F.explode(F.split("args", f"{P.SPACE}+")).alias("arg"))
        .where((arg != "") & ~arg.startswith("-"))
    )
    pinned = arg.rlike(P.PIP_PINNED)
    named = arg.rlike(P.PIP_NAME) & (F.lower(arg) != "pip")
    return (
        tokens.where(pinned | named)
        .select(
            "repo",
            "job_dir",
            X.package_name(F.when(pinned, F.regexp_extract(arg, P.PIP_PINNED, 1)).otherwise(arg)).alias("package"),
            F.when(pinned, F.regexp_extract(arg, P.PIP_PINNED, 2)).alias("version"),
        )
        .distinct()
    )


def syntax_findings(files: DataFrame) -> DataFrame:
    """Notebooks that do not parse even without their magic lines. Parsed, never run."""
    # The same lines without shell and package magic; the line numbers stay.
    bare = F.regexp_replace(X.unix_newlines(F.col("text")), P.MAGIC_LINE, "#")
    notebooks = files.where(F.col("ext") == "py").select("repo", "job_dir", "path", "text", bare.alias("bare"))
    return notebooks.mapInArrow(
        syntax_batches, "repo string, job_dir string, path string, line bigint, msg string"
    )
