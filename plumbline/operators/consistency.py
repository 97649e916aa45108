"""Consistency of records, value types and distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.columns import normalise_missing, numeric_columns, ref, string_columns
from plumbline.functions.frames import (
    HEAVY_COLUMNS_PER_STAGE,
    LIGHT_COLUMNS_PER_STAGE,
    WIDE_COLUMNS,
    cells,
    local_frame,
    per_column,
    rate,
)
from plumbline.operators.duplicates import duplicate_rows

# The classes a text value is sorted into, tried in this order.
VALUE_CLASSES = {
    "int": r"^[+-]?[0-9]+$",
    "float": r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$",
    "bool": r"^([tT][rR][uU][eE]|[fF][aA][lL][sS][eE])$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+([zZ]|[+-][0-9:]+)?)?$",
}
OTHER_CLASS = "string"


def record_consistency(df: DataFrame, digest: bool = False) -> DataFrame:
    """Share of rows that repeat no earlier row; an empty table is consistent."""
    return duplicate_rows(df, digest).select(
        "duplicate_rows",
        "row_count",
        F.coalesce(100 * (1 - F.col("duplicate_rate")), F.lit(100.0)).alias("record_consistency"),
    )


def value_class(value: Column) -> Column:
    """The class of a text value: int, float, bool, date or string."""
    chosen = F.lit(OTHER_CLASS)
    for name, pattern in reversed(VALUE_CLASSES.items()):
        chosen = F.when(value.rlike(pattern), F.lit(name)).otherwise(chosen)
    return F.when(value.isNotNull(), chosen)


def _class_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: the count of each class and the number of classes met."""
    names = [*VALUE_CLASSES, OTHER_CLASS]
    if len(columns) > WIDE_COLUMNS:
        return _class_cells(df, columns, names)
    # The class is computed once per value and then counted five ways.
    classed = df.select(*[value_class(ref(c)).alias(c) for c in columns])
    wide = per_column(
        classed,
        columns,
        lambda _, c: {f"n_{k}": F.count_if(ref(c) == F.lit(k)) for k in names},
        LIGHT_COLUMNS_PER_STAGE // len(names),
    )
    counts = F.array(
        *[F.struct(F.lit(k).alias("value_class"), F.col(f"n_{k}").alias("cnt")) for k in names]
    )
    return wide.select("column_name", F.filter(counts, lambda e: e.cnt > 0).alias("counts"))


def _class_cells(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``_class_table`` of a wide table, by position."""
    classed = cells(df, columns).select("pos", value_class(F.col("value")).alias("k")).where("k IS NOT NULL")
    by_class = classed.groupBy("pos", "k").agg(F.count(F.lit(1)).alias("cnt"))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("k")).alias("place")
    entry = F.struct(place, F.col("k").alias("value_class"), F.col("cnt"))
    counts = by_class.groupBy("pos").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    listed = [{"pos": i, "column_name": c} for i, c in enumerate(columns)]
    every = local_frame(df.sparkSession, listed, T.StructType.fromDDL("pos int, column_name string"))
    plain = F.transform("found", lambda e: F.struct(e["value_class"].alias("value_class"), e["cnt"].alias("cnt")))
    none = F.array().cast("array<struct<value_class:string,cnt:bigint>>")
    return every.join(counts, "pos", "left").select("column_name", F.coalesce(plain, none).alias("counts"))


def value_class_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value_class, cnt) of the non-null values of text columns."""
    columns = string_columns(df) if columns is None else list(columns)
    return (
        _class_table(df, columns)
        .select("column_name", F.explode("counts").alias("e"))
        .select("column_name", "e.value_class", "e.cnt")
    )


def mixed_type_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Value classes of the text columns that hold more than one class."""
    columns = string_columns(df) if columns is None else list(columns)
    return (
        _class_table(df, columns)
        .filter(F.size("counts") > 1)
        .select("column_name", F.explode("counts").alias("e"))
        .select("column_name", "e.value_class", "e.cnt")
    )


def format_consistency(df: DataFrame) -> DataFrame:
    """Share of columns that hold one class of values."""
    total = F.lit(len(df.columns)).cast("bigint")
    texts = string_columns(df)
    mixed = F.lit(0).cast("bigint")
    if texts:
        mixed = _class_table(df, texts).agg(F.count_if(F.size("counts") > 1)).scalar()
    return df.sparkSession.range(1).select(
        mixed.alias("mixed_columns"),
        total.alias("column_count"),
        (100 * (1 - rate(mixed, total))).alias("format_consistency"),
    )


def json_field_types(df: DataFrame, json_col: str) -> DataFrame:
    """Types met per top-level field of a JSON text column (field, value_type, cnt).

    Text that is not a JSON object is counted once under a NULL field.
    """
    docs = df.filter(ref(json_col).isNotNull()).select(F.try_parse_json(ref(json_col)).alias("doc"))
    fields = df.sparkSession.tvf.variant_explode_outer(F.col("doc").outer())
    return (
        docs.lateralJoin(fields)
        .groupBy(F.col("key").alias("field"), F.schema_of_variant("value").alias("value_type"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _shape(_: DataFrame, c: str) -> Mapping[str, Column]:
    v = ref(c).cast("double")
    return {
        "n": F.count(v),
        "mean": F.avg(v),
        "std": F.stddev_samp(v),
        "g1": F.skewness(v),
        "g2": F.kurtosis(v),
    }


def distribution_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, and std / mean, per column.

    A constant column has both at zero, as far as n allows them at all.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    clean = normalise_missing(df)
    wide = per_column(clean, columns, _shape, HEAVY_COLUMNS_PER_STAGE)
    n = F.col("n").cast("double")
    flat = F.col("std") == 0
    skewness = F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    kurtosis = (
        (n - 1)
        / F.nullif((n - 2) * (n - 3), F.lit(0.0))
        * ((n + 1) * F.col("g2") + 6)
    )
    return wide.select(
        "column_name",
        F.when(F.col("n") >= 3, F.when(flat, F.lit(0.0)).otherwise(skewness)).alias("skewness"),
        F.when(F.col("n") >= 4, F.when(flat, F.lit(0.0)).otherwise(kurtosis)).alias("kurtosis"),
        F.try_divide(F.col("std"), F.col("mean")).alias("cv"),
    )
