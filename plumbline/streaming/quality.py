"""Windowed rule results on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.functions.columns import dtype_of, ref
from plumbline.operators.windowed import windowed_quality
from plumbline.sources.rules import SemanticRule, SyntacticRule


def utc_instant(column: Column) -> Column:
    """A timestamp without zone as an instant, read as UTC whatever the session zone."""
    return F.timestamp_micros(
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    )


def utc_wall_clock(column: Column) -> Column:
    """An instant as a timestamp without zone, in UTC."""
    micros = F.unix_micros(column)
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def stream_quality(
    stream: DataFrame,
    event_time: str,
    watermark: str,
    width: str = "1 day",
    rules: DataFrame | Sequence[SyntacticRule] = (),
    row_rules: Sequence[SemanticRule] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Windowed rule results of a stream; rows later than the watermark are dropped.

    State is one row of counters per open window and slice.  A watermark needs
    instants, so a timestamp without zone is read as UTC.
    """
    if isinstance(dtype_of(stream, event_time), T.TimestampNTZType):
        stream = stream.withColumn(event_time, utc_instant(ref(event_time)))
    marked = stream.withWatermark(event_time, watermark)
    return windowed_quality(marked, event_time, width, rules, row_rules, by)


def write_closed_windows(
    results: DataFrame, path: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Append each window to Parquet once the watermark has passed it.

    Takes what is there and stops; run again to go on.  The checkpoint lies in
    the folder of the results, in a sub-folder that readers skip, unless one is
    given; one folder of results goes with one checkpoint.
    """
    return (
        results.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option(
            "checkpointLocation",
            checkpoint or f"{path.rstrip('/')}/_checkpoint",
        )
        .trigger(availableNow=True)
        .start()
    )
