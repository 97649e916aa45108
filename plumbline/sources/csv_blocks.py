"""CSV files with quoted line breaks, read by many tasks.

A line break ends a record only if the quotes before it are even in number.  Every
task reads blocks of a file as lines and gives each line the parity of the quotes
before it in its block.  The parities of blocks, one row each, add up to the parity
with which each block begins, and so the records' true boundaries are known.  A
record on one line is parsed where it was read; only lines of records that span
several are shuffled, to be put together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions.columns import quoted

_LINES = "file string, block long, n long, odd int, quotes int, even_starts long, odd_starts long, value string"


def _numbered(quote: str):
    """Lines of a task with their place in the block, the parity before them, and the records begun up to them.

    Records are numbered for a block that begins outside of quotes and for one that
    begins inside.  Blocks come one after another, lines in their order.
    """

    def run(batches):
        block, lines, odd, begun = None, 0, 0, [0, 0]
        for batch in batches:
            file, start, value = batch.columns
            places = np.array([f"{f}\0{s}" for f, s in zip(file.to_pylist(), start.to_pylist())], object)
            cuts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else []
            for i, j in zip(cuts, [*cuts[1:], len(places)]):
                if places[i] != block:
                    block, lines, odd, begun = places[i], 0, 0, [0, 0]
                text = value.slice(i, j - i)
                own = np.asarray(pc.count_substring(text, quote).fill_null(0), np.int64) % 2
                before = (odd + np.append(0, np.cumsum(own)[:-1])) % 2
                starts = [begun[k] + np.cumsum(before == k) for k in (0, 1)]
                numbers = lines + np.arange(j - i)
                arrays = [file.slice(i, j - i), start.slice(i, j - i), numbers, before.astype(np.int32), own.astype(np.int32), *starts]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), text], names=[x.split()[0] for x in _LINES.split(", ")])
                lines, odd, begun = lines + j - i, int(before[-1] + own[-1]) % 2, [int(s[-1]) for s in starts]

    return run


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, inside, owner, last): whether a block begins inside of quotes, and the record that is open there."""
    by_block = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max("even_starts").alias("even"), F.max("odd_starts").alias("odd")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_block.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)) == 1)
    begun = F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))
    own = F.when(begun > 0, F.struct(F.col("block").alias("owner"), begun.alias("last")))
    return placed.withColumn("open", F.last(own, ignorenulls=True).over(before)).select(
        "file", F.col("block"), "inside", "open.owner", "open.last"
    )


def csv_records(spark: SparkSession, path: str | Sequence[str], quote: str = '"') -> DataFrame:
    """Records of CSV files as text, header lines included.  Columns: file, block, number, value.

    ``block`` is the offset of the block in which a record begins, ``number`` counts
    its records from 1.  A file whose quotes do not come out even has one record from
    the last odd one on.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    placed = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = placed.mapInArrow(_numbered(quote), _LINES)
    # One row for each block of a file; the size of blocks bounds them.
    known = lines.join(F.broadcast(_blocks(lines)), ["file", "block"])
    number = F.when(F.col("inside"), F.col("odd_starts")).otherwise(F.col("even_starts"))
    begins = (F.col("odd") == 1) == F.col("inside")
    whole = begins & (F.col("quotes") == 0)
    single = known.where(whole).select("file", "block", number.alias("number"), "value")
    parts = known.where(~whole).select(
        "file",
        F.when(number == 0, F.col("owner")).otherwise(F.col("block")).alias("at"),
        F.when(number == 0, F.col("last")).otherwise(number).alias("number"),
        F.struct("block", "n", "value").alias("part"),
    )
    texts = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["value"])
    joined = parts.groupBy("file", F.col("at").alias("block"), "number").agg(F.array_join(texts, "\n").alias("value"))
    return single.unionByName(joined)


def _without_return(value: Column) -> Column:
    return F.regexp_replace(value, r"\r\z", "")


def read_csv_blocks(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ",", quote: str = '"'
) -> DataFrame:
    """Files with a header line as text columns, quoted line breaks kept; empty cells are NULL.

    A quote inside of a quoted cell is doubled.  Blank lines are left out.  Line
    breaks inside of cells stay as they are, also where lines end with ``\\r\\n``,
    which the reader of whole files turns into ``\\n`` there.
    """
    records = csv_records(spark, path, quote)
    rows = records.where(~((F.col("block") == 0) & (F.col("number") == 1)))
    schema = ", ".join(f"{quoted(c)} string" for c in columns)
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    text = rows.select(_without_return(F.col("value")).alias("value")).where("value <> ''")
    return text.select(F.from_csv("value", schema, options).alias("r")).select("r.*")
