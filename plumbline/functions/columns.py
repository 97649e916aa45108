"""Column references, missing-value handling and schema selectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Names that mark a label column, in the order they are tried.
LABEL_NAMES = ("label", "target", "class", "attack", "y")

# Fragments of a column name that mark a date or time column.
DATETIME_NAME_PARTS = ("date", "time", "timestamp")

TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> str:
    """A name as SQL text, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Reference a top-level column by its exact name."""
    return F.col(quoted(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that one test covers both.

    ``nanvl`` states the column once; a CASE would state it twice, and whatever
    expression stands behind it would be generated twice.
    """
    dtype = dtype_of(df, name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(ref(name), F.lit(None).cast(dtype))
    return ref(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)):
        return ref(name).isNull() | F.isnan(ref(name))
    return ref(name).isNull()


def missing_sql(df: DataFrame, name: str) -> str:
    """``is_missing`` as SQL text, for expressions over many columns."""
    number = isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType))
    return f"{quoted(name)} IS NULL" + f" OR isnan({quoted(name)})" * number


def normalise_missing(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float and double column."""
    floats = {f.name: f.dataType.simpleString() for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    present_sql = {c: f"nanvl({quoted(c)}, CAST(NULL AS {kind})) AS {quoted(c)}" for c, kind in floats.items()}
    return df.selectExpr(*[present_sql.get(c, quoted(c)) for c in df.columns])


def groupable(df: DataFrame, name: str) -> Column:
    """A form of the column that GROUP BY and DISTINCT accept.

    Maps and variants cannot be grouped, so they become JSON text; map entries
    are sorted first because their order carries no meaning.
    """
    dtype = dtype_of(df, name)
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(ref(name))))
    if isinstance(dtype, T.VariantType):
        return F.to_json(ref(name))
    return ref(name)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans are categorical."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame, by: str = "name") -> list[str]:
    """Date and time columns, found by a fragment of their name or by type."""
    if by == "type":
        return [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL_TYPES)]
    if by == "name":
        return [c for c in df.columns if any(part in c.lower() for part in DATETIME_NAME_PARTS)]
    raise ValueError(f"by must be 'name' or 'type', not {by!r}")


def label_column(df: DataFrame, label_col: str | None = None) -> str | None:
    """The given label column, or the first column with a conventional label name."""
    if label_col is not None:
        return label_col if label_col in df.columns else None
    return next((c for c in df.columns if c.lower() in LABEL_NAMES), None)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {', '.join(absent)}")


def chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]
