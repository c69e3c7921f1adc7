"""Strict JSON as VARIANT columns.

Spark's own parser ignores what follows a value, and a VARIANT holds ``1.0`` as ``1``. Here a text counts as JSON only as a whole, and
numbers with a fraction or an exponent, wide whole numbers, ``NaN`` and ``Infinity`` are kept as marked strings, so that ``1.0`` stays
different from ``1`` and nothing is rounded. Of keys that occur twice the last one counts (a session setting, ``session.DEFAULTS``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

#: Begins a string that stands for a number. Texts of definitions do not begin with this control character.
MARK = "\x01"
_STRING = r'"(?:[^"\\]|\\.)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![ \t\n\r]*:)"
_TOKEN = rf'(?s){_STRING}|{_NUMBER}|-?Infinity|NaN|[^"0-9NI-]+|.'
_SPECIAL = r"\A-?(?:[0-9]+(?=[.eE])[0-9.eE+-]+|[0-9]{19,}|Infinity)\z|\ANaN\z"
#: Texts that may hold such a number. In others nothing has to be marked.
_MAY_HOLD = r"[0-9][.eE]|[0-9]{19}|NaN|Infinity"
_FALSY = ["null", "false", '""', "0", "[]", "{}", '"\\u00010.0"', '"\\u0001-0.0"']


def _marked(raw: Column) -> Column:
    """The text with its special numbers as marked strings, in one spelling for each value."""
    wide = lambda t: t.rlike(r"\A-?[0-9]+\z")
    spelled = lambda t: F.when(wide(t), t).otherwise(t.try_cast("double").cast("string"))
    tokens = F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0))
    said = F.transform(tokens, lambda t: F.when(t.rlike(_SPECIAL), F.concat(F.lit('"\\u0001'), spelled(t), F.lit('"'))).otherwise(t))
    return F.when(raw.rlike(_MAY_HOLD), F.array_join(said, "")).otherwise(raw)


def parsed(raw: Column) -> Column:
    """The JSON value of a whole text, null where it is none."""
    # The value stands in a list before a string that no text holds by chance: what follows a value breaks the list.
    seal = F.md5(raw)

    def whole(both: Column) -> Column:
        sealed = (F.size(both.try_cast("array<variant>")) == 2) & (F.try_variant_get(both, "$[1]", "string") == seal)
        return F.when(sealed, F.try_variant_get(both, "$[0]", "variant"))

    return X.let(F.try_parse_json(F.concat(F.lit("["), _marked(raw), F.lit(', "'), seal, F.lit('"]'))), whole)


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def member(value: Column, key: str) -> Column:
    """A member of an object, null where there is none. A JSON null is a value."""
    return F.when(is_object(value), F.try_variant_get(value, f"$.{key}", "variant"))


def string(value: Column) -> Column:
    """A JSON string, null for any other value."""
    plain = F.try_variant_get(value, "$", "string")
    return F.when((F.schema_of_variant(value) == "STRING") & ~F.startswith(plain, F.lit(MARK)), plain)


def truthy(value: Column) -> Column:
    """Whether a value is there and neither null, false, zero nor empty."""
    return F.coalesce(~F.to_json(value).isin(_FALSY), F.lit(False))


def to_text(value: Column) -> Column:
    """A value as JSON text with sorted keys, numbers unmarked and a blank behind each separator."""
    plain = F.regexp_replace(F.to_json(value), r'"\\u0001([^"]*)"', "$1")
    tokens = F.regexp_extract_all(plain, F.lit(rf'(?s){_STRING}|[^",:]+|[,:]'), F.lit(0))
    spaced = F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), "")
    return F.when(F.startswith(plain, F.lit("[")) | F.startswith(plain, F.lit("{")), spaced).otherwise(plain)


def members(rows: DataFrame, value: str, key: str = "key", item: str = "item") -> DataFrame:
    """A row for each member of the objects in a column, without that column; rows without an object give none."""
    opened = rows.where(is_object(F.col(value)))
    exploded = opened.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer()).select(F.col("key").alias(key), F.col("value").alias(item)))
    return exploded.drop(value)
