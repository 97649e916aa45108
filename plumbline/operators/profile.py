"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.columns import (
    TEMPORAL_TYPES,
    chunks,
    dtype_of,
    groupable,
    is_missing,
    label_column,
    normalise_missing,
    numeric_columns,
    ref,
    require_columns,
)
from plumbline.functions.frames import (
    HEAVY_COLUMNS_PER_STAGE,
    LIGHT_COLUMNS_PER_STAGE,
    WIDE_COLUMNS,
    local_frame,
    number_text,
    per_column,
    rate,
    union_all,
)
from plumbline.operators.duplicates import duplicate_rows
from plumbline.operators.frequency import class_balance, label_distribution, top_values, unique_counts
from plumbline.operators.quantiles import GATHER_LIMIT, quantiles
from plumbline.operators.rule_data import Limits, count_broken

COLUMN_PROFILE = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("null_rate", T.DoubleType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("q25", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("q75", T.DoubleType()),
        T.StructField("outlier_count", T.LongType()),
    ]
)


QUARTILES = (0.25, 0.5, 0.75)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
    )


def table_profile(df: DataFrame, digest: bool = False) -> DataFrame:
    return duplicate_rows(df, digest).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "duplicate_rows",
        "duplicate_rate",
    )


COLUMN_TYPES = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("position", T.IntegerType()),
    ]
)


def column_types(df: DataFrame) -> DataFrame:
    """Type and place of each column, and how many of its values are given."""
    named = [{"column_name": n, "data_type": t, "position": i} for i, (n, t) in enumerate(df.dtypes, 1)]
    types = local_frame(df.sparkSession, named, COLUMN_TYPES)
    given = per_column(df, df.columns, lambda d, c: {"non_null": F.count_if(~is_missing(d, c))})
    return types.join(given, "column_name").select(*COLUMN_TYPES.fieldNames(), "non_null")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells (NULL or NaN) of each column."""
    columns = list(df.columns if columns is None else columns)
    require_columns(df, columns)
    counted = per_column(df, columns, lambda d, c: {"null_count": F.count_if(is_missing(d, c))})
    return counted.select(
        "column_name", "null_count", rate(F.col("null_count"), F.col("row_count")).alias("null_rate")
    )


def _moments(df: DataFrame, c: str) -> Mapping[str, Column]:
    v = ref(c).cast("double")
    return {
        "non_null": F.count(v),
        "min_value": F.min(v),
        "max_value": F.max(v),
        "mean": F.avg(v),
        "std": F.stddev_samp(v),
    }


def outlier_fences(quartiles: Mapping[str, Sequence[float | None]]) -> dict[str, tuple[float, float]]:
    """Bounds 1.5 IQR outside the quartiles; none where the IQR is zero."""
    fences = {}
    for c, (q1, *_, q3) in quartiles.items():
        if q1 is not None and q3 - q1 != 0:
            fences[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return fences


def _outlier_counts(
    clean: DataFrame, columns: Sequence[str], fences: Mapping[str, tuple[float, float]]
) -> dict[str, int]:
    fenced = [c for c in columns if c in fences]
    limits = {c: Limits("real", *fences[c]) for c in fenced}
    counts = dict.fromkeys(columns, 0)
    if len(fenced) > WIDE_COLUMNS:
        found = count_broken(clean, [(i, c, limits[c]) for i, c in enumerate(fenced)], []).first()["counts"]
        return counts | {c: found.get(i, 0) for i, c in enumerate(fenced)}
    for group in chunks(fenced, LIGHT_COLUMNS_PER_STAGE):
        broken = [F.count_if(limits[c].broken(ref(c).cast("double"))) for c in group]
        counts |= dict(zip(group, clean.agg(*[m.alias(f"n{i}") for i, m in enumerate(broken)]).first()))
    return counts


def _moments_and_quartiles(
    clean: DataFrame, columns: Sequence[str], approx: bool, gather_limit: int
) -> dict[str, dict]:
    if not columns:
        return {}
    facts = {
        r.column_name: r.asDict()
        for r in per_column(
            clean, columns, _moments, HEAVY_COLUMNS_PER_STAGE
        ).collect()
    }
    counts = {c: facts[c]["non_null"] for c in columns}
    quartiles = quantiles(
        clean, columns, QUARTILES, counts, gather_limit=gather_limit, approx=approx
    )
    for c in columns:
        facts[c] |= dict(zip(("q25", "median", "q75"), quartiles[c], strict=True))
    return facts


def numeric_facts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    gather_limit: int = GATHER_LIMIT,
) -> dict[str, dict]:
    """Moments, quartiles and outlier counts by column.

    One scan for moments, two as a rule for exact quartiles and one for
    outliers, whose bounds are literals by then.  Each reads the numeric
    columns only.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    clean = normalise_missing(df)
    facts = _moments_and_quartiles(clean, columns, approx, gather_limit)
    fences = outlier_fences({c: (f["q25"], f["q75"]) for c, f in facts.items()})
    outliers = _outlier_counts(clean, columns, fences)
    return {c: f | {"outlier_count": outliers[c]} for c, f in facts.items()}


NUMERIC_PROFILE = T.StructType(
    [COLUMN_PROFILE["column_name"], T.StructField("non_null", T.LongType())]
    + [f for f in COLUMN_PROFILE if f.name in ("min_value", "max_value", "mean", "std", "q25", "median", "q75")]
)


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    gather_limit: int = GATHER_LIMIT,
) -> DataFrame:
    """Count, min, max, mean, sample deviation and quartiles of numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    facts = _moments_and_quartiles(normalise_missing(df), columns, approx, gather_limit)
    return local_frame(df.sparkSession, list(facts.values()), NUMERIC_PROFILE)


def iqr_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    gather_limit: int = GATHER_LIMIT,
) -> DataFrame:
    """Values strictly outside the IQR fences; zero where the IQR is zero."""
    columns = numeric_columns(df) if columns is None else list(columns)
    clean = normalise_missing(df)
    quartiles = quantiles(
        clean, columns, (0.25, 0.75), gather_limit=gather_limit, approx=approx
    )
    outliers = _outlier_counts(clean, columns, outlier_fences(quartiles))
    rows = [
        {"column_name": c, "q25": low, "q75": high, "outlier_count": outliers[c]}
        for c, (low, high) in quartiles.items()
    ]
    wanted = ("column_name", "q25", "q75", "outlier_count")
    return local_frame(df.sparkSession, rows, T.StructType([COLUMN_PROFILE[c] for c in wanted]))


def column_profile(df: DataFrame, approx: bool = False, gather_limit: int = GATHER_LIMIT) -> DataFrame:
    """The full profile of every column, with numeric figures where they apply."""
    numbers = numeric_facts(df, approx=approx, gather_limit=gather_limit)
    types = dict(df.dtypes)
    base = null_profile(df).join(unique_counts(df, approx=approx), "column_name")
    numeric = local_frame(
        df.sparkSession,
        list(numbers.values()),
        T.StructType([COLUMN_PROFILE["column_name"], *COLUMN_PROFILE.fields[5:]]),
    )
    type_names = local_frame(
        df.sparkSession,
        [{"column_name": c, "data_type": t} for c, t in types.items()],
        T.StructType(COLUMN_PROFILE.fields[:2]),
    )
    return (
        base.join(type_names, "column_name")
        .join(numeric, "column_name", "left")
        .select(*COLUMN_PROFILE.fieldNames())
    )


def redundancy_metrics(df: DataFrame, c: str) -> Mapping[str, Column]:
    """Enough to tell a constant or empty column without counting distinct values.

    The extremes of text and nested values cannot be kept in a hash aggregate,
    which would make the whole scan slower, so those of a 64-bit hash are taken:
    all of the values would have to collide to look constant.
    """
    value = groupable(df, c)
    if not isinstance(dtype_of(df, c), (T.NumericType, T.BooleanType, *TEMPORAL_TYPES)):
        value = F.when(value.isNotNull(), F.xxhash64(value))
    return {
        "null_count": F.count_if(ref(c).isNull()),
        "constant": F.coalesce(F.min(value) == F.max(value), F.lit(False)),
    }


def redundant_columns(df: DataFrame) -> DataFrame:
    """Columns that carry no information: all missing, or one value only.  One scan, no shuffle."""
    clean = normalise_missing(df)
    reason = F.when(F.col("null_count") == F.col("row_count"), F.lit("all_null")).when(
        F.col("constant") & (F.col("null_count") == 0), F.lit("constant")
    )
    return (
        per_column(clean, clean.columns, redundancy_metrics)
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("column_name", "null_count", "reason")
    )


def sample_rows(df: DataFrame, order_by: Sequence[str], k: int = 5) -> DataFrame:
    """The first k rows in a stated order."""
    require_columns(df, order_by)
    return df.orderBy(*[ref(c) for c in order_by]).limit(k)


def profile_lines(
    df: DataFrame,
    label_col: str | None = None,
    order_by: Sequence[str] = (),
    sample: int = 5,
    approx: bool = False,
    top_classes: int = 50,
) -> DataFrame:
    """The profile as numbered text lines (line_no, text).

    The ``top_classes`` largest classes of the label have a line each, and the
    number of the others is given; ``label_distribution`` has them all.
    """

    def text(section: int, frame: DataFrame, order: Column, line: Column) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"), order.cast("string").alias("key"), line.alias("text")
        )

    percent = lambda c: F.format_string("%.1f%%", F.coalesce(c, F.lit(0.0)) * 100)
    shape = table_profile(df)
    none = F.lit("")
    parts = [
        text(
            0,
            shape,
            F.lit("0"),
            F.format_string("Dataset: %d rows x %d columns", "row_count", "column_count"),
        ),
        text(
            1,
            shape,
            F.lit("0"),
            F.concat(
                F.format_string("Duplicate rows: %d (", "duplicate_rows"),
                percent(F.col("duplicate_rate")),
                F.lit(")"),
            ),
        ),
    ]
    label = label_column(df, label_col)
    if label is not None:
        distribution = label_distribution(df, label)
        classes = distribution.orderBy(F.col("cnt").desc(), "label").limit(top_classes)
        others = distribution.agg((F.count(F.lit(1)) - top_classes).alias("n")).filter("n > 0")
        parts += [
            text(2, shape, F.lit("0"), F.lit(f"Label column: '{label}'")),
            text(
                3,
                classes,
                F.concat(F.lpad(F.lit(10**18) - F.col("cnt"), 20, "0"), "label"),
                F.format_string("  class %s: %d", "label", "cnt"),
            ),
            # Behind the digits that the keys of classes start with.
            text(3, others, F.lit("~"), F.format_string("  and %d smaller classes", "n")),
            text(
                4,
                class_balance(df, label),
                F.lit("0"),
                F.concat(
                    F.lit("Class balance (min/max): "),
                    number_text("%.3f", F.col("class_balance")),
                ),
            ),
        ]
    positions = column_types(df).select("column_name", "position")
    top = top_values(df, k=5) if len(numeric_columns(df)) < len(df.columns) else None
    columns = column_profile(df, approx=approx).join(positions, "column_name")
    if top is not None:
        listed = top.groupBy("column_name").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s.value), ", "
            ).alias("top")
        )
        columns = columns.join(listed, "column_name", "left")
    else:
        columns = columns.withColumn("top", F.lit(None).cast("string"))
    numeric_line = F.format_string(
        "range [%s, %s], mean=%s, outliers=%d, unique=%d",
        F.col("min_value").cast("string"),
        F.col("max_value").cast("string"),
        F.format_string("%.3g", "mean"),
        "outlier_count",
        "unique_count",
    )
    other_line = F.format_string("unique=%d, top=[%s]", "unique_count", F.coalesce("top", none))
    parts += [
        text(5, shape, F.lit("0"), F.lit("Column profiles:")),
        text(
            6,
            columns,
            F.lpad(F.col("position").cast("string"), 6, "0"),
            F.concat(
                F.format_string("  %s [%s]: ", "column_name", "data_type"),
                percent(F.col("null_rate")),
                F.lit(" null, "),
                F.when(F.col("mean").isNotNull(), numeric_line).otherwise(other_line),
            ),
        ),
    ]
    if order_by:
        row = F.to_json(F.struct(*[ref(c) for c in df.columns if _printable(df, c)]))
        parts += [
            text(7, shape, F.lit("0"), F.lit("Sample rows:")),
            text(8, sample_rows(df, order_by, sample), row, F.concat(F.lit("  "), row)),
        ]
    return number_lines(union_all(parts))


def _printable(df: DataFrame, name: str) -> bool:
    return not isinstance(dtype_of(df, name), T.BinaryType)


def number_lines(parts: DataFrame) -> DataFrame:
    """Number lines by section and key.  There is one line per column, rule or class that is shown."""
    numbered = F.row_number().over(Window.partitionBy().orderBy("section", "key"))
    return parts.select(numbered.cast("bigint").alias("line_no"), "text").orderBy("line_no")
