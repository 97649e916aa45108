"""Completeness of cells, columns, records, labels and classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import is_missing, label_column, missing_sql, ref
from plumbline.functions.frames import WIDE_COLUMNS, rate
from plumbline.operators.frequency import label_distribution


def completeness_metrics(df: DataFrame) -> Mapping[str, Column]:
    """Row and cell counts as aggregates, to be fused with others into one scan."""
    zero = F.lit(0).cast("bigint")
    missing = [is_missing(df, c) for c in df.columns]
    row_complete = ~F.array_contains(F.array(*missing), True) if missing else F.lit(True)
    cells_missing = [F.count_if(m) for m in missing]
    return {
        "row_count": F.count(F.lit(1)),
        "complete_rows": F.count_if(row_complete),
        "null_cells": _total([zero, *cells_missing]),
        "complete_columns": _total([zero, *[F.when(m == 0, 1).otherwise(0) for m in cells_missing]]),
    }


def _total(terms: list[Column]) -> Column:
    """The sum as a balanced tree, as deep as the logarithm of the number of columns."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


# Positions that stand for a row and for a row without a missing value.
_ROW, _COMPLETE_ROW = -1, -2


def wide_completeness(df: DataFrame) -> DataFrame:
    """``completeness_metrics`` of a wide table, in one scan and one row.

    The missing cells of a row are an array of positions, and their partial sums by
    position are what is shuffled, so no expression grows with the columns but a
    list of their names.
    """
    flags = df.select(F.expr(f"array({', '.join(missing_sql(df, c) for c in df.columns)})").alias("missing"))
    positions = F.expr(
        f"concat(array({_ROW}), IF(array_contains(missing, true), "
        f"filter(transform(missing, (x, i) -> IF(x, i, null)), i -> i IS NOT NULL), array({_COMPLETE_ROW})))"
    )
    counted = flags.select(F.explode(positions).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
    of = {
        "row_count": F.sum(F.when(F.col("pos") == _ROW, F.col("n"))),
        "complete_rows": F.sum(F.when(F.col("pos") == _COMPLETE_ROW, F.col("n"))),
        "null_cells": F.sum(F.when(F.col("pos") >= 0, F.col("n"))),
        "complete_columns": len(df.columns) - F.count_if(F.col("pos") >= 0),
    }
    return counted.agg(*[F.coalesce(m, F.lit(0)).cast("bigint").alias(k) for k, m in of.items()])


def completeness(df: DataFrame) -> DataFrame:
    """Value, feature and record completeness in one scan and one row.

    A table without cells is complete; one without columns has no feature score.
    """
    columns = F.lit(len(df.columns)).cast("bigint")
    if len(df.columns) > WIDE_COLUMNS:
        counted = wide_completeness(df)
    else:
        counted = df.agg(*[m.alias(k) for k, m in completeness_metrics(df).items()])
    counted = counted.withColumn("total_cells", F.col("row_count") * columns)
    return counted.select(
        "row_count",
        columns.alias("column_count"),
        "null_cells",
        "total_cells",
        "complete_columns",
        "complete_rows",
        F.coalesce(100 * (1 - rate(F.col("null_cells"), F.col("total_cells"))), F.lit(100.0)).alias(
            "value_completeness"
        ),
        (100 * rate(F.col("complete_columns"), columns)).alias("feature_completeness"),
        F.coalesce(100 * rate(F.col("complete_rows"), F.col("row_count")), F.lit(100.0)).alias(
            "record_completeness"
        ),
    )


def value_completeness(df: DataFrame) -> DataFrame:
    return completeness(df).select("null_cells", "total_cells", "value_completeness")


def feature_completeness(df: DataFrame) -> DataFrame:
    return completeness(df).select("complete_columns", "column_count", "feature_completeness")


def record_completeness(df: DataFrame) -> DataFrame:
    return completeness(df).select("complete_rows", "row_count", "record_completeness")


def value_occurrence_completeness(df: DataFrame, label_col: str | None = None) -> DataFrame:
    """Share of the labels expected under equal class sizes that are there.

    With E = labels / classes it is 100 * sum(min(count, E)) / (E * classes).
    """
    classes = label_distribution(df, label_col)
    totals = classes.agg(
        F.sum("cnt").alias("labels"), F.count(F.lit(1)).alias("classes")
    )
    expected = totals.select(rate(F.col("labels"), F.col("classes"))).scalar()
    return (
        classes.agg(
            F.count(F.lit(1)).alias("classes"),
            F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("labels"),
            F.sum(F.least(F.col("cnt").cast("double"), expected)).alias("covered"),
        )
        .select(
            "classes",
            "labels",
            rate(F.col("labels"), F.col("classes")).alias("expected_per_class"),
            (100 * rate(F.col("covered"), F.col("labels"))).alias("value_occurrence_completeness"),
        )
    )


def labelled(df: DataFrame, label_col: str, unlabeled_values: Sequence = ()) -> Column:
    """True where a label is given and is none of the placeholder values."""
    given = ~is_missing(df, label_col)
    placeholders = [v for v in unlabeled_values if v is not None]
    return given & ~ref(label_col).isin(placeholders) if placeholders else given


def label_completeness(
    df: DataFrame, label_col: str | None = None, unlabeled_values: Sequence = ()
) -> DataFrame:
    """Share of rows that carry a label."""
    label = label_column(df, label_col)
    if label is None:
        raise ValueError("no label column: name one with label_col")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(labelled(df, label, unlabeled_values)).alias("labelled_rows"),
    ).select(
        "row_count",
        "labelled_rows",
        (100 * rate(F.col("labelled_rows"), F.col("row_count"))).alias("label_completeness"),
    )
