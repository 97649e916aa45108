"""Casts of text that do not rely on failing.

``try_cast`` of a text that is no number raises and catches an exception, which
costs some microseconds per value.  Where many values may not parse, a pattern
sorts them out first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Texts that can be read as each type; white space around is allowed.
READABLE = {
    "integer": r"^\s*[+-]?[0-9]+\s*$",
    "double": r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$",
    "boolean": r"^\s*(?i:true|t|yes|y|1|false|f|no|n|0)\s*$",
}
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _pattern(target: str) -> str | None:
    if target in INTEGRAL:
        return READABLE["integer"]
    return READABLE["double"] if target in ("float", "double") else READABLE.get(target)


def parse(value: Column, dtype: T.DataType, target: str) -> Column:
    """The value as the target type, NULL where it cannot be read."""
    pattern = _pattern(target)
    cast = value.try_cast(target)
    if isinstance(dtype, T.StringType) and pattern is not None:
        return F.when(value.rlike(pattern), cast)
    return cast


def parse_int(text: Column) -> Column:
    return parse(text, T.StringType(), "int")
