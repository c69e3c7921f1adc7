"""Secret-shaped values and private terms in texts. Input: (repo, path, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.skew import settled_lookup
from .extract import source_lines

#: Terms tested in one generated expression; a longer list is tested in several.
TERMS_PER_EXPRESSION = 100


def scannable(files: DataFrame) -> DataFrame:
    """Without binary file kinds and cache folders."""
    parts = X.path_parts(F.col("path"))
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in P.SCAN_SKIP_DIRS]))
    suffix = F.lower(F.regexp_extract(X.file_name(F.col("path")), r"(?<=.)\.([^.]*)$", 1))
    return files.where(~skipped & ~suffix.isin(P.BINARY_SUFFIXES))


def _shape(text: Column, needle: str, pattern: str) -> Column:
    return F.contains(text, F.lit(needle)) & text.rlike(pattern) if needle else text.rlike(pattern)


def secret_shape_scan(files: DataFrame, shapes: Sequence[tuple[str, str, str]] = tuple(P.SECRET_SHAPES)) -> DataFrame:
    """One hit per (line, shape). The shapes are a fixed list, so they are literals of one expression
    and no join is needed."""
    lines = source_lines(files.select("repo", "path", "text"))
    hits = F.array_compact(
        F.array(*[F.when(_shape(F.col("line"), needle, p), F.lit(label)) for label, needle, p in shapes])
    )
    return lines.select(
        "repo", "path", "line_no", F.explode(hits).alias("shape"),
        X.strip(F.col("line")).alias("snippet"),
    )


def denylist_scan(files: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(repo, path, line_no, n_terms) of lines with private terms. Never the term, never the line."""
    patterns = [f"(?iud:{t})" for t in terms]
    union = "|".join(patterns) or r"\A(?!\A)"
    lines = source_lines(files.select("repo", "path", "text")).where(F.col("line").rlike(union))
    chunks = [patterns[i : i + TERMS_PER_EXPRESSION] for i in range(0, len(patterns), TERMS_PER_EXPRESSION)]
    counted = lines.withColumn("n_terms", F.lit(0))
    for chunk in chunks:
        tests = F.array(*[F.col("line").rlike(p) for p in chunk])
        counted = counted.withColumn("n_terms", F.col("n_terms") + F.size(F.filter(tests, lambda t: t)))
    return counted.select("repo", "path", "line_no", "n_terms")


#: Length of the pieces by which terms and lines find each other.
PIECE = 4


def _folded(c: Column) -> Column:
    """One spelling for all that a pattern takes for equal when case does not count."""
    return F.replace(F.upper(F.lower(c)), F.lit("\u0307"), F.lit(""))


def _literals(term: Column) -> Column:
    """Literal texts of which every match of a pattern holds one: the longest literal run of each alternative. An alternative inside
    brackets, and characters that may be left out, promise nothing."""
    gap = "\x00"
    bare = F.regexp_replace(term, r"(?s)\(.*\)(?:[?*+]|\{[^}]*\})*", gap)
    bare = F.regexp_replace(bare, r"\[(?:\\.|[^\]\\])+\](?:[?*+]|\{[^}]*\})*", gap)
    # What a quantifier may leave out goes, an escaped mark stands for itself, any other escape and any other sign for something.
    bare = F.regexp_replace(bare, r"(?:\\.|[^\\])(?:[?*]|\{[^}]*\})[?+]?", gap)
    bare = F.regexp_replace(bare, r"\+", gap)
    bare = F.regexp_replace(bare, r"\\[A-Za-z0-9]", gap)
    bare = F.regexp_replace(bare, r"(?<!\\)[.^$]", gap)
    ways = F.when(F.contains(term, F.lit("(")) | F.contains(term, F.lit("[")), F.array(F.replace(bare, F.lit("|"), F.lit(gap)))).otherwise(F.split(bare, r"(?<!\\)\|"))

    def longest(way: Column) -> Column:
        runs = F.transform(F.split(F.regexp_replace(way, r"\\(.)", "$1"), gap), _folded)
        return F.aggregate(runs, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))

    return F.transform(ways, longest)


def denylist_pieces(terms: DataFrame) -> DataFrame:
    """(only_repo, term, piece) of terms (repo, term): for each alternative of a term a piece that its matches hold; null where one has
    no literal run that is long enough. A null repo means all."""
    own = terms.where(F.coalesce("term", F.lit("")) != "").select(F.col("repo").alias("only_repo"), "term").distinct()
    pieces = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - (PIECE - 1)), lambda i: F.substr(run, i, F.lit(PIECE)))
    # Of a run's pieces the one with the smallest hash, which spreads terms over pieces.
    one = lambda run: F.when(F.length(run) >= PIECE, F.array_min(F.transform(pieces(run), lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p"))))["p"])
    held = own.withColumn("held", F.transform(_literals(F.col("term")), one))
    safe = ~F.exists("held", lambda p: p.isNull())
    return held.select("only_repo", "term", F.explode(F.when(safe, F.array_distinct("held")).otherwise(F.array(F.lit(None).cast("string")))).alias("piece"))


def denylist_table_scan(files: DataFrame, terms: DataFrame) -> DataFrame:
    """As ``denylist_scan`` with a table of terms (repo, term), of any length and with lists of their own for repositories.

    A term is tested on the lines that hold a piece of its literal text, found by a join on pieces. The pieces
    of terms are written and counted first: few are sent to all tasks, so that the pieces of lines stay where they are, more are merged. A term without such a text is tested on every line.
    """
    pieces = settled_lookup(denylist_pieces(terms), "denied-pieces")
    lines = source_lines(files.select("repo", "path", "text"))
    # One pass over a line: a cut by place would count its characters from the start for every piece.
    cut = F.array_distinct(F.regexp_extract_all(_folded(F.col("line")), F.lit(rf"(?s)(?=(.{{{PIECE}}}))"), F.lit(1)))
    cells = lines.select("repo", "path", "line_no", "line", F.explode(cut).alias("piece"))
    own = F.col("only_repo").isNull() | (F.col("only_repo") == F.col("repo"))
    met = cells.join(pieces.where("piece is not null"), "piece").where(own)
    loose = pieces.where("piece is null").select("only_repo", "term")
    columns = ["repo", "path", "line_no", "line", "term"]
    candidates = met.select(*columns)
    if not loose.isEmpty():
        candidates = candidates.unionByName(lines.join(loose, own, "inner").select(*columns))
    found = candidates.where(F.rlike("line", F.concat(F.lit("(?iud:"), "term", F.lit(")"))))
    return found.groupBy("repo", "path", "line_no").agg(F.count_distinct("term").cast("int").alias("n_terms"))


def read_denylist(lines: Sequence[str]) -> list[str]:
    """Terms of a denylist file: blank lines and ``#`` comments dropped."""
    return [line.strip() for line in lines if line.strip() and not line.lstrip().startswith("#")]
