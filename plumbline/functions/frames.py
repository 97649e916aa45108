"""Small result frames and per-column aggregation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.columns import chunks, quoted

# One generated method holds all aggregates of a stage, and the JVM leaves
# methods above 8 kB of bytecode uncompiled.  Four columns of moments (20
# aggregates) stay below that; eight run six times slower.  Splitting costs no
# extra I/O on columnar files, as every part reads only its own columns.
HEAVY_COLUMNS_PER_STAGE = 4
LIGHT_COLUMNS_PER_STAGE = 24
# Beyond this number, columns are aggregated by position: their cells become rows
# that are summed in every task, and no expression has a term for every column.
WIDE_COLUMNS = 200

_ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def local_frame(spark: SparkSession, rows: Sequence[Mapping], schema: T.StructType) -> DataFrame:
    """A driver-side table of bounded size (one row per column, rule or dimension).

    Going through Arrow gives a LocalTableScan, so that the optimizer knows
    its size and no Python worker is started.
    """
    arrow_schema = pa.schema(
        [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in schema]
    )
    plain = [
        {
            f.name: list(r[f.name].items())
            if isinstance(f.dataType, T.MapType) and r.get(f.name) is not None
            else r.get(f.name)
            for f in schema
        }
        for r in rows
    ]
    return spark.createDataFrame(pa.Table.from_pylist(plain, schema=arrow_schema), schema)


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    metrics: Callable[[DataFrame, str], Mapping[str, Column]],
    per_stage: int = LIGHT_COLUMNS_PER_STAGE,
) -> DataFrame:
    """Aggregate every column and return one row per column.

    ``metrics`` gives the aggregates of a column by result name, for a frame and the
    name of the column in it.  The result holds column_name, row_count and those
    names.  The scan is cut by columns; that of a wide table is cut by types only.
    """
    if not columns:
        raise ValueError("no columns to aggregate")
    if len(columns) > WIDE_COLUMNS:
        return _per_position(df, columns, metrics)
    parts = []
    for group in chunks(list(columns), per_stage):
        named = {(i, k): m for i, c in enumerate(group) for k, m in metrics(df, c).items()}
        wide = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            *[m.alias(f"m{i}_{k}") for (i, k), m in named.items()],
        )
        rows = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("row_count"),
                *[F.col(f"m{i}_{k}").alias(k) for (j, k) in named if j == i],
            )
            for i, c in enumerate(group)
        ]
        parts.append(wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return union_all(parts)


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pos, value) of the cells of columns of one type."""
    return df.select(F.posexplode(F.expr(f"array({', '.join(map(quoted, columns))})")).alias("pos", "value"))


def _per_position(
    df: DataFrame, columns: Sequence[str], metrics: Callable[[DataFrame, str], Mapping[str, Column]]
) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(types[c].json(), []).append(c)
    parts = []
    for group in by_type.values():
        rows = cells(df, group)
        wanted = {"row_count": F.count(F.lit(1))} | dict(metrics(rows, "value"))
        named = [m.alias(k) for k, m in wanted.items()]
        found = rows.groupBy("pos").agg(*named)
        # A table without rows has no groups, but its aggregates have values all the same.
        empty = rows.limit(0).agg(F.struct(*named)).scalar()
        names = local_frame(
            df.sparkSession,
            [{"pos": i, "column_name": c} for i, c in enumerate(group)],
            T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("column_name", T.StringType())]),
        )
        filled = [
            F.when(F.col("row_count").isNull(), empty.getField(k)).otherwise(F.col(k)).alias(k) for k in wanted
        ]
        parts.append(names.join(F.broadcast(found), "pos", "left").select("column_name", *filled))
    return union_all(parts)


def run_together(
    spark: SparkSession, tasks: Mapping[str, Callable[[], object]]
) -> dict[str, object]:
    """Run independent Spark jobs side by side, so that one fills the gaps of another."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        started = {
            name: pool.submit(inheritable_thread_target(spark)(task))
            for name, task in tasks.items()
        }
        return {name: future.result() for name, future in started.items()}


def number_text(pattern: str, value: Column) -> Column:
    """A formatted number, N/A for NULL, which format_string would print in part."""
    return F.when(value.isNotNull(), F.format_string(pattern, value)).otherwise(F.lit("N/A"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
