"""Rule suggestions from the data, to be approved by a person."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.columns import dtype_of, normalise_missing, numeric_columns, ref, string_columns
from plumbline.functions.frames import HEAVY_COLUMNS_PER_STAGE, local_frame, per_column, union_all
from plumbline.operators.consistency import value_class_counts
from plumbline.operators.frequency import value_frequency
from plumbline.operators.rules import TYPE_NAMES
from plumbline.sources.rules import SYNTACTIC_TABLE

# The dtype rule suggested for text that is all of one class.
CLASS_TYPES = {"int": "int64", "float": "float64", "bool": "bool", "date": "datetime64[ns]"}


def _suggestion(frame: DataFrame, rule_type: str, specification: Column, why: Column) -> DataFrame:
    return frame.select(
        F.concat(F.lit(f"{rule_type}:"), "column_name").alias("rule_id"),
        F.col("column_name").alias("field"),
        F.lit(rule_type).alias("rule_type"),
        specification.alias("specification"),
        why.alias("description"),
        F.lit("").alias("standard_reference"),
        F.lit(False).alias("approved"),
    )


def _bounds(df: DataFrame, columns: list[str], value) -> DataFrame:
    def metrics(_: DataFrame, c: str) -> Mapping[str, Column]:
        return {"low": F.min(value(c)), "high": F.max(value(c))}

    return per_column(df, columns, metrics).filter(F.col("low").isNotNull())


def suggest_rules(df: DataFrame, max_enum: int = 20) -> DataFrame:
    """A rule table with nothing approved.

    range from the extremes of numeric columns; enum for text columns of at most
    ``max_enum`` values that all repeat; length from the extremes of text
    lengths; not_null for columns without a missing value; dtype from the
    column type, or from the text class if there is one only.
    """
    clean = normalise_missing(df)
    numbers, texts = numeric_columns(df), string_columns(df)
    parts = []

    bounds = F.to_json(F.struct(F.col("low").alias("min"), F.col("high").alias("max")))
    whole = [c for c in numbers if isinstance(dtype_of(df, c), T.IntegralType)]
    broken = [c for c in numbers if c not in whole]
    for columns, kind in ((whole, "bigint"), (broken, "double")):
        if columns:
            seen = _bounds(clean, columns, lambda c, k=kind: ref(c).cast(k))
            parts.append(_suggestion(seen, "range", bounds, F.lit("extremes seen in the data")))

    if texts:
        lengths = _bounds(clean, texts, lambda c: F.length(ref(c)))
        parts.append(_suggestion(lengths, "length", bounds, F.lit("text lengths seen in the data")))

        # The sketch only spares columns of many values the count of each; its
        # standard error is 5%, and ten times that are allowed for.
        rough = per_column(
            clean,
            texts,
            lambda _, c: {"n": F.approx_count_distinct(ref(c))},
            HEAVY_COLUMNS_PER_STAGE * 2,
        )
        few = [r.column_name for r in rough.collect() if r.n <= max_enum * 1.5 + 10]
        if few:
            values = value_frequency(clean, few)
            fit = (
                values.groupBy("column_name")
                .agg(F.count(F.lit(1)).alias("n"), F.min("cnt").alias("least"))
                .filter((F.col("n") <= max_enum) & (F.col("least") > 1))
            )
            listed = (
                values.join(F.broadcast(fit), "column_name")
                .groupBy("column_name")
                .agg(F.to_json(F.array_sort(F.collect_list("value"))).alias("specification"))
            )
            parts.append(
                _suggestion(
                    listed, "enum", F.col("specification"), F.lit("few values, all repeated")
                )
            )
        classes = (
            value_class_counts(clean, texts)
            .groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("n"), F.first("value_class").alias("only"))
            .filter((F.col("n") == 1) & F.col("only").isin(list(CLASS_TYPES)))
        )
        names = F.create_map(*[F.lit(x) for pair in CLASS_TYPES.items() for x in pair])
        parts.append(
            _suggestion(
                classes, "dtype", F.try_element_at(names, F.col("only")), F.lit("all text of one class")
            )
        )

    full = per_column(clean, clean.columns, lambda _, c: {"n": F.count(ref(c))}).filter(
        (F.col("n") == F.col("row_count")) & (F.col("n") > 0)
    )
    parts.append(_suggestion(full, "not_null", F.lit("true"), F.lit("no missing value seen")))

    spark_names = {v: k for k, v in reversed(TYPE_NAMES.items())}
    typed = [
        {"column_name": c, "dtype": spark_names[t]}
        for c, t in df.dtypes
        if c in numbers and t in spark_names
    ]
    if typed:
        schema = T.StructType(
            [T.StructField("column_name", T.StringType()), T.StructField("dtype", T.StringType())]
        )
        parts.append(
            _suggestion(
                local_frame(df.sparkSession, typed, schema),
                "dtype",
                F.col("dtype"),
                F.lit("type of the column"),
            )
        )
    return union_all(parts).select(*SYNTACTIC_TABLE.fieldNames())
