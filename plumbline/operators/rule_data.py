"""Limits of rules as data, so that one scan counts any number of rules.

A bound, a list of allowed values or a length is not compiled into the query.
Each row gives one entry for every column that has such rules, and the entries
are joined with the broadcast table of limits.  Only pairs that break a rule reach
the aggregate, which sums them in every task: what is shuffled is one row per
broken rule and task.  Neither the plan nor the generated code grows with the
rules, but with the columns that have some.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.columns import quoted
from plumbline.functions.frames import local_frame

#: Types of columns by the slot of an entry that holds their values.
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType)
#: Longer lists are compiled, as a hash set.
LISTED = 100
#: Entries of this number count rows.
ROWS = -1

_LIMITS = T.StructType(
    [
        T.StructField("entry", T.IntegerType()),
        T.StructField("rule", T.IntegerType()),
        T.StructField("any", T.BooleanType()),
        T.StructField("low_whole", T.LongType()),
        T.StructField("high_whole", T.LongType()),
        T.StructField("listed_whole", T.ArrayType(T.LongType())),
        T.StructField("low_real", T.DoubleType()),
        T.StructField("high_real", T.DoubleType()),
        T.StructField("listed_real", T.ArrayType(T.DoubleType())),
        T.StructField("low_text", T.StringType()),
        T.StructField("high_text", T.StringType()),
        T.StructField("listed_text", T.ArrayType(T.StringType())),
    ]
)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Limits:
    """What the values of a slot must keep to; None is no limit, and an empty list allows nothing.

    Slots: ``whole``, ``real`` and ``text`` for values, ``length`` for the length of
    their text, ``missing`` for a rule that missing values break.
    """

    slot: str
    low: int | float | str | None = None
    high: int | float | str | None = None
    listed: tuple | None = None

    def broken(self, value: Column) -> Column:
        """The same as a Column."""
        if self.slot == "missing":
            return value.isNull()
        if self.slot == "length":
            value = F.length(value.cast("string"))
        if self.listed is not None:
            return ~value.isin(list(self.listed)) if self.listed else value.isNotNull()
        tests = [] if self.low is None else [value < F.lit(self.low)]
        if self.high is not None:
            tests.append(value > F.lit(self.high))
        return reduce(or_, tests, F.lit(False))


def slot_of(dtype: T.DataType) -> str | None:
    """The slot of a column's values; None for types whose rules are compiled."""
    if isinstance(dtype, WHOLE):
        return "whole"
    if isinstance(dtype, REAL):
        return "real"
    return "text" if isinstance(dtype, T.StringType) else None


def _as_float(value: int | float) -> float:
    """Numbers beyond those of a double are infinite."""
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def number_literal(value: int | float) -> Column:
    """A number as a literal, also where it does not fit into 64 bits."""
    if isinstance(value, int) and not _LEAST <= value <= _MOST:
        return F.lit(Decimal(value)) if abs(value) < 10**38 else F.lit(_as_float(value))
    return F.lit(value)


def whole_limits(slot: str, low: int | float | None, high: int | float | None) -> Limits:
    """Limits of integers, exact for any numbers; NaN is above all of them.

    A bound that every value breaks, whatever its size, becomes an empty list.
    """
    if low is not None:
        if low != low or low > _MOST:
            return Limits(slot, listed=())
        low = None if low <= _LEAST else math.ceil(low)
    if high is not None:
        if high < _LEAST:
            return Limits(slot, listed=())
        high = None if high != high or high >= _MOST else math.floor(high)
    return Limits(slot, low, high)


def real_limits(low: int | float | None, high: int | float | None) -> Limits:
    return Limits("real", *(None if b is None else _as_float(b) for b in (low, high)))


def listed_limits(slot: str, values: Sequence) -> Limits:
    """Allowed values of a slot; numbers that no value of the slot can equal drop out."""
    if slot == "whole":
        values = [int(v) for v in values if math.isfinite(_as_float(v)) and v == int(v) and _LEAST <= v <= _MOST]
    elif slot == "real":
        values = [_as_float(v) for v in values]
    return Limits(slot, listed=tuple(dict.fromkeys(values)))


def as_data(limits: Limits | None) -> bool:
    return limits is not None and len(limits.listed or ()) <= LISTED


def _limit_row(entry: int, rule: int, limits: Limits | None) -> dict:
    """A row of the limits table; without limits, each true entry breaks the rule."""
    row = {"entry": entry, "rule": rule}
    if limits is None or limits.slot == "missing":
        return row | {"any": True}
    kind = "whole" if limits.slot == "length" else limits.slot
    listed = None if limits.listed is None else list(limits.listed)
    return row | {f"low_{kind}": limits.low, f"high_{kind}": limits.high, f"listed_{kind}": listed}


def _entry(number: int, column: str, slot: str) -> str:
    value = {
        "whole": f"CAST({column} AS bigint)",
        "length": f"CAST(length(CAST({column} AS string)) AS bigint)",
        "real": f"CAST({column} AS double)",
        "text": f"CAST({column} AS string)",
        "missing": f"{column} IS NULL",
    }
    kind = "whole" if slot == "length" else slot
    parts = [f"{value[slot]} AS {k}" if k == kind else f"CAST(NULL AS {t}) AS {k}" for k, t in _SLOTS.items()]
    return f"struct({number} AS entry, {', '.join(parts)})"


_SLOTS = {"missing": "boolean", "whole": "bigint", "real": "double", "text": "string"}
_BROKEN = " OR ".join(
    ["(any AND missing)"] + [f"{k} < low_{k} OR {k} > high_{k} OR NOT array_contains(listed_{k}, {k})" for k in ("whole", "real", "text")]
)


def count_broken(clean: DataFrame, limits: Sequence[tuple[int, str, Limits]], conditions: Sequence[tuple[int, Column]]) -> DataFrame:
    """One row with ``counts``: violations by the number of the rule, without zeros; rows are counted as rule ROWS.

    ``limits`` has numbers of rules, their columns and limits; ``conditions`` numbers
    and Columns that are true for a broken rule.  One scan counts all of them.
    """
    entries: dict[tuple[str, str], int] = {}
    rows = [_limit_row(ROWS, ROWS, None)]
    for rule, column, limit in limits:
        number = entries.setdefault((column, limit.slot), len(entries))
        rows.append(_limit_row(number, rule, limit))
    parts = [f"struct({ROWS} AS entry, true AS missing, {', '.join(f'CAST(NULL AS {t}) AS {k}' for k, t in _SLOTS.items() if k != 'missing')})"]
    parts += [_entry(number, quoted(column), slot) for (column, slot), number in entries.items()]
    listed = F.expr(f"array({', '.join(parts)})")
    if conditions:
        empty = [F.lit(None).cast(t).alias(k) for k, t in _SLOTS.items() if k != "missing"]
        first = len(entries)
        rows += [_limit_row(first + i, rule, None) for i, (rule, _) in enumerate(conditions)]
        listed = F.concat(
            listed,
            F.array(
                *[
                    F.struct(F.lit(first + i).alias("entry"), F.coalesce(condition, F.lit(False)).alias("missing"), *empty)
                    for i, (_, condition) in enumerate(conditions)
                ]
            ),
        )
    table = local_frame(clean.sparkSession, rows, _LIMITS)
    broken = clean.select(F.inline(listed)).join(F.broadcast(table), "entry").where(_BROKEN)
    counted = broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.map_from_entries(F.collect_list(F.struct("rule", "n"))).alias("counts"))
