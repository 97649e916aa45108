"""Sinks for result tables and the report text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result table as parquet, json (one record a line) or csv, so that ``read_table`` reads it back.

    In CSV an empty text cannot be told from a missing one, and is read as missing.
    """
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        # A quote is doubled, and white space at the ends of a cell is kept.
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.save(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write report lines in order as one text file.  A report has a few hundred lines."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("text").write.mode(mode).text(path)
