"""Column expressions the operators share. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

DASH = "—"


def either(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{P.SPACE}+|{P.SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{P.SPACE}+\z", "")


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def one_line_end(text: Column) -> Column:
    """The text with every line end as ``\\n``. Most texts have no other and pass unchanged."""
    return F.when(text.rlike(P.OTHER_EOL), F.regexp_replace(text, rf"\r\n|{P.OTHER_EOL}", "\n")).otherwise(text)


def lines(text: Column) -> Column:
    """Lines of a text whose line ends are all ``\\n``; a final line end opens no further line, and an
    empty text has no line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null (not '') when nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def path_order(path: Column) -> Column:
    """Sort key of a path, folder by folder: the separator sorts before every other character."""
    return F.translate(path, "/", "\x01")


def resolved_path(path: Column) -> Column:
    """Path without ``.`` and ``..`` steps; an absolute path stays absolute."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def key_number(ticket: Column) -> Column:
    """Number of a job key as (how many digits, the digits), which sorts like the number however long it is; a key
    without a number counts as 0."""
    digits = F.ltrim(F.regexp_extract(ticket, r"-([0-9]+)", 1), F.lit("0"))
    return F.struct(F.length(digits).alias("size"), digits.alias("digits"))


def is_hundredth_key(ticket: Column) -> Column:
    """Whether the number of a job key is divisible by 100."""
    digits = key_number(ticket)["digits"]
    return F.endswith(digits, F.lit("00")) | (digits == "")


def key_pattern(prefixes: Column) -> Column:
    """Per-row pattern of a job key: one of the configured prefixes and a number, else the default."""
    quoted = F.transform(prefixes, lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    return F.when(
        F.coalesce(F.size(prefixes), F.lit(0)) > 0,
        F.concat(F.lit("(?:"), F.array_join(quoted, "|"), F.lit(r")-\p{Nd}+")),
    ).otherwise(F.lit(P.DEFAULT_JOB_KEY))


def job_key(folder: Column, prefixes: Column | None = None) -> Column:
    """Job key found anywhere in a folder name; null when there is none."""
    if prefixes is None:
        return F.nullif(F.regexp_extract(folder, P.DEFAULT_JOB_KEY, 0), F.lit(""))
    return F.regexp_substr(folder, key_pattern(prefixes))


def quoted(literal: str) -> str:
    """A text as a pattern that matches just it."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def is_direct_notebook() -> Column:
    """Whether a row of files is a notebook directly in its job folder."""
    parts = path_parts(F.col("path"))
    return (F.col("ext") == "py") & (F.array_position(parts, F.col("job_dir")) == F.size(parts) - 1)


def without_quotes(c: Column) -> Column:
    return F.translate(c, "`\"", "")


def dequoted(c: Column) -> Column:
    """Shell text without its quote characters."""
    return F.translate(c, "'\"", "")


def schema_part(ref: Column) -> Column:
    """Segment before the last of a dotted name; 'object' for a bare name."""
    parts = F.split(ref, r"\.")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit("object"))


def is_task_ref(ref: Column) -> Column:
    """Whether a text names a scheduled task and may stand in SQL; false for null, and with a line end behind the name."""
    return F.coalesce(ref.rlike(P.TASK_REF), F.lit(False))


def node_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[:\\/]", ".")


def table_cell(c: Column) -> Column:
    """Text for a cell of a Markdown table."""
    escaped = F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    return strip(F.replace(escaped, F.lit("\n"), F.lit(" ")))


def url_path(c: Column) -> Column:
    """Percent-encoding of a path: letters, digits, ``_.-~`` and ``/`` stay."""
    out = F.url_encode(c)
    for encoded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def package_name(c: Column) -> Column:
    """Normalised package name: extras dropped, runs of ``-_.`` to one dash, lower case."""
    return F.lower(F.regexp_replace(F.substring_index(c, "[", 1), "[-_.]+", "-"))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and columns read without repeating their expression: Spark copies a
    plain column's expression into every filter on it, but not that of a generator's output."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once: a lambda that mentions an expression computes
    it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_fold_case(arr: Column) -> Column:
    """Distinct values ignoring case, first casing kept, ordered by the folded value. Values that come again as they are go first, and
    the rest is sorted by generated code: ``array_sort`` would call a comparing function for every step."""
    ranked = F.sort_array(
        F.transform(F.array_distinct(arr), lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v")))
    )
    first = lambda rows: F.filter(
        rows, lambda row, i: (i == 0) | (F.get(rows, i - 1)["k"] != row["k"])
    )
    return let(ranked, lambda rows: F.transform(first(rows), lambda row: row["v"]))
