"""Diversity of labels, categories and time-series components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.columns import (
    datetime_columns,
    dtype_of,
    normalise_missing,
    numeric_columns,
    ref,
    require_columns,
    string_columns,
)
from plumbline.functions.frames import local_frame, rate
from plumbline.operators.frequency import label_distribution, value_frequency
from plumbline.operators.quantiles import GATHER_LIMIT, bracket_bounds, bracket_pairs, values_at_ranks

MINIMUM_SERIES = 10


def label_richness(df: DataFrame, label_col: str | None = None) -> DataFrame:
    return label_distribution(df, label_col).agg(
        F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("labels"),
    )


def label_abundance(df: DataFrame, label_col: str | None = None) -> DataFrame:
    """Share of each class among the labelled rows."""
    classes = label_distribution(df, label_col)
    total = classes.agg(F.sum("cnt")).scalar()
    return classes.select("label", "cnt", rate(F.col("cnt"), total).alias("abundance"))


def label_imbalance(df: DataFrame, label_col: str | None = None) -> DataFrame:
    """Smallest and largest class share and their ratio."""
    return label_distribution(df, label_col).agg(
        rate(F.min("cnt"), F.sum("cnt")).alias("min_abundance"),
        rate(F.max("cnt"), F.sum("cnt")).alias("max_abundance"),
        rate(F.max("cnt"), F.min("cnt")).alias("imbalance_ratio"),
    )


def category_size_diversity(df: DataFrame, label_col: str | None = None) -> DataFrame:
    """Share of classes that hold less than half of the labelled rows."""
    classes = label_distribution(df, label_col)
    total = classes.agg(F.sum("cnt")).scalar()
    return classes.agg(
        F.count(F.lit(1)).alias("classes"),
        F.count_if(F.col("cnt") * 2 < total).alias("classes_below_half"),
    ).select(
        "classes",
        "classes_below_half",
        (100 * rate(F.col("classes_below_half"), F.col("classes"))).alias("category_size_diversity"),
    )


def feature_diversity(
    df: DataFrame, columns: Sequence[str] | None = None, max_columns: int | None = None, k: int = 5
) -> DataFrame:
    """Distinct values and the k largest shares per text column, for tables without a label.

    All text columns are taken unless ``columns`` or ``max_columns`` narrow them.
    """
    columns = string_columns(df)[:max_columns] if columns is None else list(columns)
    counts = value_frequency(df, columns)
    totals = counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum("cnt").alias("non_null")
    )
    ranked = Window.partitionBy("column_name").orderBy(F.col("cnt").desc(), F.col("value").asc())
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .join(totals, "column_name")
        .select(
            "column_name",
            "unique_count",
            F.col("rank").cast("bigint").alias("rank"),
            "value",
            rate(F.col("cnt"), F.col("non_null")).alias("share"),
        )
    )


def time_series_indicators(df: DataFrame, by: str = "name") -> DataFrame:
    return df.agg(
        F.lit(",".join(datetime_columns(df, by))).alias("datetime_columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.count(F.lit(1)).alias("row_count"),
    )


def _order_parts(df: DataFrame, name: str) -> list[Column]:
    """Doubles that order rows as the column does, each part breaking ties of the last.

    A BIGINT or DECIMAL can hold more digits than a double, hence a second part
    with the rest.  NULLs come first.
    """
    dtype, c = dtype_of(df, name), ref(name)
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        parts = [F.timestamp_diff("MICROSECOND", epoch, c)]
    elif isinstance(dtype, T.TimestampType):
        parts = [F.unix_micros(c)]
    elif isinstance(dtype, T.DateType):
        parts = [F.unix_date(c)]
    elif isinstance(dtype, (T.LongType, T.DecimalType)):
        parts = [c, c - c.cast("double").cast(dtype)]
    elif isinstance(dtype, T.NumericType):
        parts = [c]
    else:
        raise ValueError(f"order by a numeric, date or timestamp column, not {name} {dtype}")
    return [F.coalesce(p.cast("double"), F.lit(float("-inf"))) for p in parts]


HALVES = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("non_null", T.LongType()),
        T.StructField("first_mean", T.DoubleType()),
        T.StructField("second_mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("trend", T.BooleanType()),
    ]
)


def trend_component(
    df: DataFrame,
    order_by: Sequence[str],
    column: str | None = None,
    gather_limit: int = GATHER_LIMIT,
) -> DataFrame:
    """Compare the mean of the first half of the rows with that of the second half.

    The halves are split at row floor(n / 2) of the non-null values in the given
    order.  The row at the split is found by exact rank selection, one key after
    the other as long as ties cross the split, and then becomes a literal in a
    plain aggregate; no global sort or row number is needed.  Rows that tie on
    all keys are ordered by value.
    """
    require_columns(df, order_by)
    column = column or next(iter(numeric_columns(df)), None)
    if column is None:
        return local_frame(df.sparkSession, [], HALVES)
    clean = normalise_missing(df).filter(ref(column).isNotNull())
    keys = [p for name in order_by for p in _order_parts(clean, name)]
    value = ref(column).cast("double")
    names = [f"k{i}" for i in range(len(keys))] + ["v"]
    rows = clean.select(*[k.alias(n) for k, n in zip([*keys, value], names, strict=True)])

    total = rows.agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        bracket_bounds(F.col("k0"), [0.5]).alias("middle"),
    ).first()
    if total.n < MINIMUM_SERIES:
        row = {"column_name": column, "non_null": total.n, "std": total.std, "trend": False}
        return local_frame(df.sparkSession, [row], HALVES)

    wanted = total.n // 2
    tied, first, open_rows, rest = F.lit(True), F.lit(False), total.n, wanted
    brackets = {"k0": bracket_pairs(total.middle)}
    names_left = list(names)
    while names_left and rest and (names_left == names or open_rows > gather_limit):
        name = names_left.pop(0)
        pivot = values_at_ranks(
            rows.filter(tied).select(name), {name: [rest]}, {name: open_rows}, gather_limit, brackets
        )[name, rest]
        first = first | (tied & (ref(name) < F.lit(pivot.value)))
        tied = tied & (ref(name) == F.lit(pivot.value))
        rest, open_rows, brackets = rest - pivot.below, pivot.equal, None
    sums = rows.agg(
        F.sum(F.when(first, F.col("v"))).alias("first"), F.sum("v").alias("all")
    ).first()
    first_sum = sums["first"] or 0.0
    if rest and names_left:
        # Few rows tie at the split; the first of them by the other keys belong to the first half.
        first_sum += (
            rows.filter(tied).orderBy(*names_left).limit(rest).agg(F.sum("v").alias("s")).first().s
        )
    elif rest:
        # All keys tie, and so does the value, the last of them.
        first_sum += rest * pivot.value
    first_mean = first_sum / wanted
    second_mean = (sums["all"] - first_sum) / (total.n - wanted)
    row = {
        "column_name": column,
        "non_null": total.n,
        "first_mean": first_mean,
        "second_mean": second_mean,
        "std": total.std,
        "trend": total.std > 0 and abs(first_mean - second_mean) > 0.5 * total.std,
    }
    return local_frame(df.sparkSession, [row], HALVES)


def component_richness(
    df: DataFrame,
    order_by: Sequence[str],
    by: str = "name",
    column: str | None = None,
    gather_limit: int = GATHER_LIMIT,
) -> DataFrame:
    """Time-series components met, of trend, seasonal, cyclical and irregular.

    A date column stands for seasonal; cyclical is never detected.
    """
    halves = trend_component(df, order_by, column, gather_limit)
    enough = F.col("non_null") >= MINIMUM_SERIES
    found = halves.select(
        F.col("trend").alias("trend"),
        (enough & F.lit(bool(datetime_columns(df, by)))).alias("seasonal"),
        (enough & (F.coalesce("std", F.lit(0.0)) > 0)).alias("irregular"),
    )
    score = sum(F.col(c).cast("int") for c in ("trend", "seasonal", "irregular"))
    return found.withColumn(
        "component_richness", F.round(100 * score.cast("double") / 4, 1)
    )
