"""Value frequencies, distinct counts, top values and label distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline.functions.columns import (
    dtype_of,
    groupable,
    label_column,
    normalise_missing,
    numeric_columns,
    ref,
    require_columns,
)
from plumbline.functions.frames import local_frame, per_column, rate, union_all


def _family(dtype: T.DataType) -> T.DataType | None:
    """The common type under which columns can share one unpivot."""
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    if isinstance(dtype, (T.StringType, T.MapType, T.VariantType)):
        return T.StringType()
    return dtype


def typed_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> list[DataFrame]:
    """Non-null value counts (column_name, value, cnt), one frame per value type.

    Columns of one type are unpivoted together, so numbers are hashed and
    shuffled as numbers.  Copies of a value are summed before the shuffle, which
    keeps a hot value from loading one task.
    """
    columns = list(df.columns if columns is None else columns)
    require_columns(df, columns)
    df = normalise_missing(df)
    families: dict[str, tuple[T.DataType, list[str]]] = {}
    for c in columns:
        family = _family(dtype_of(df, c))
        families.setdefault(family.simpleString(), (family, []))[1].append(c)
    frames = []
    for family, members in families.values():
        if len(members) == 1:
            long = df.select(
                F.lit(members[0]).alias("column_name"),
                groupable(df, members[0]).cast(family).alias("value"),
            )
        else:
            typed = df.select(*[groupable(df, c).cast(family).alias(c) for c in members])
            long = typed.unpivot([], [ref(c) for c in members], "column_name", "value")
        frames.append(
            long.filter(F.col("value").isNotNull())
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("cnt"))
        )
    return frames


def value_frequency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, cnt) with values as text, NULL and NaN left out."""
    return union_all(
        [
            f.select("column_name", _text(f).alias("value"), "cnt")
            for f in typed_frequencies(df, columns)
        ]
    )


def _text(frame: DataFrame):
    """Text form of the value column; arrays and structs as JSON."""
    if isinstance(dtype_of(frame, "value"), (T.ArrayType, T.StructType)):
        return F.to_json(F.col("value"))
    return F.col("value").cast("string")


def unique_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """Distinct non-null values of each column."""
    columns = list(df.columns if columns is None else columns)
    require_columns(df, columns)
    if approx:
        clean = normalise_missing(df)
        return per_column(
            clean,
            columns,
            lambda d, c: {"unique_count": F.approx_count_distinct(groupable(d, c))},
        ).select("column_name", "unique_count")
    counted = union_all(
        [
            f.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
            for f in typed_frequencies(df, columns)
        ]
    )
    # An all-null column has no frequency row but still has a count: zero.
    every = local_frame(
        df.sparkSession,
        [{"column_name": c} for c in columns],
        T.StructType([T.StructField("column_name", T.StringType())]),
    )
    return every.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count")
    )


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = 10, sketch: bool = False
) -> DataFrame:
    """The k most frequent values of each column, by default of the non-numeric ones.

    Ties go to the smaller value.  Spark keeps k rows per column and task before the
    window's shuffle, so no task sees all values of a column.

    With ``sketch``, distinct values are not shuffled at all: a sketch names
    candidates in one scan, a second one counts them exactly, and the sketch's error
    bound proves that no other value belongs to the first k.  Columns for which it
    does not, as their values are about equally frequent, are counted in full.
    """
    if columns is None:
        numeric = set(numeric_columns(df))
        columns = [c for c in df.columns if c not in numeric]
    require_columns(df, columns)
    if not sketch:
        return _ranked(value_frequency(df, columns), k)
    proven = _proven_top(normalise_missing(df), columns, k)
    rest = [c for c in columns if c not in proven]
    rows = [
        {"column_name": c, "rank": i, "value": value, "cnt": n}
        for c, top in proven.items()
        for i, (value, n) in enumerate(top, 1)
    ]
    found = local_frame(df.sparkSession, rows, TOP_VALUES)
    return found.unionByName(_ranked(value_frequency(df, rest), k)) if rest else found


TOP_VALUES = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("cnt", T.LongType()),
    ]
)
CANDIDATES = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())])
# Values that a sketch holds; a value that it does not report has at most ERROR / SKETCHED of the rows.
# The sketch's own bound is 3.5 over the size of its table, at least 4/3 of SKETCHED; what is not reported may have twice that.
SKETCHED, ERROR = 50_000, 5.25


def _ranked(frequencies: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("column_name").orderBy(F.col("cnt").desc(), F.col("value").asc())
    return (
        frequencies.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("column_name", F.col("rank").cast("bigint").alias("rank"), "value", "cnt")
    )


def _sketchable(dtype: T.DataType) -> bool:
    """Types whose values and texts correspond one to one."""
    return isinstance(dtype, (T.IntegralType, T.StringType, T.BooleanType, T.DateType))


def _proven_top(clean: DataFrame, columns: Sequence[str], k: int) -> dict[str, list[tuple[str, int]]]:
    """The first k (value, count) of each column for which candidates of a sketch are proven to hold them."""
    able = [c for c in columns if _sketchable(dtype_of(clean, c))]
    if not able:
        return {}
    text = [ref(c).cast("string") for c in able]
    asked = min(4 * k + 16, SKETCHED)
    seen = clean.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(t).alias(f"n{i}") for i, t in enumerate(text)],
        *[F.call_function("approx_top_k", t, F.lit(asked), F.lit(SKETCHED)).alias(f"top{i}") for i, t in enumerate(text)],
    ).first()
    candidates = [
        {"pos": i, "value": x["item"]} for i in range(len(able)) for x in seen[f"top{i}"] or () if x["item"] is not None
    ]
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), t.alias("value")) for i, t in enumerate(text)])
    wanted = F.broadcast(local_frame(clean.sparkSession, candidates, CANDIDATES))
    counted = clean.select(F.inline(entries)).join(wanted, ["pos", "value"]).groupBy("pos", "value").agg(F.count(F.lit(1)).alias("cnt"))
    found: dict[int, list[tuple[str, int]]] = {i: [] for i in range(len(able))}
    for row in counted.collect():
        found[row["pos"]].append((row["value"], row["cnt"]))
    proven = {}
    for i, c in enumerate(able):
        rows, total = seen[f"n{i}"], seen["total"]
        # Texts compare by their bytes, as in Spark.
        top = sorted(found[i], key=lambda x: (-x[1], x[0].encode()))
        complete = sum(n for _, n in top) == rows
        reported = seen[f"top{i}"] or ()
        # What is cut off from a full list has no higher estimate than its last item, and estimates are not too low.
        others = max(ERROR / SKETCHED * total, reported[-1]["count"] if len(reported) >= asked else 0)
        if complete or len(top) >= k and top[k - 1][1] > others:
            proven[c] = top[:k]
    return proven


def _label(df: DataFrame, label_col: str | None) -> str:
    found = label_column(df, label_col)
    if found is None:
        raise ValueError("no label column: name one with label_col")
    return found


def label_distribution(df: DataFrame, label_col: str | None = None) -> DataFrame:
    """Rows per class (label, cnt), label as text, NULL left out."""
    (frame,) = typed_frequencies(df, [_label(df, label_col)])
    return frame.select(_text(frame).alias("label"), "cnt")


def class_balance(df: DataFrame, label_col: str | None = None) -> DataFrame:
    """Smallest class over largest class, NULL without labels."""
    return label_distribution(df, label_col).agg(
        F.min("cnt").alias("min_count"),
        F.max("cnt").alias("max_count"),
        rate(F.min("cnt"), F.max("cnt")).alias("class_balance"),
    )
