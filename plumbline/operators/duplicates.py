"""Copies of rows, found without shuffling the rows that have none."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from plumbline.functions.columns import groupable, normalise_missing, quoted
from plumbline.functions.frames import local_frame

#: Hashes that come twice are broadcast up to this number, 16 bytes each.
BROADCAST_HASHES = 500_000
_KEYS = ["digest1", "digest2"]

DUPLICATES = T.StructType(
    [
        T.StructField("row_count", T.LongType()),
        T.StructField("duplicate_rows", T.LongType()),
        T.StructField("duplicate_rate", T.DoubleType()),
    ]
)


def row_digest(df: DataFrame, seed: int) -> str:
    """A 64-bit hash of a row as SQL text; it tells by the column which values are NULL."""
    nulls = ", ".join(f"{quoted(c)} IS NULL" for c in df.columns)
    return f"xxhash64({seed}, array({nulls}), {', '.join(map(quoted, df.columns))})"


def comparable(df: DataFrame) -> DataFrame:
    """The columns in a form that GROUP BY accepts, NaN as NULL."""
    clean = normalise_missing(df)
    odd = {f.name for f in clean.schema if isinstance(f.dataType, (T.MapType, T.VariantType))}
    return clean.withColumns({c: groupable(clean, c) for c in odd}) if odd else clean


def digest_groups(rows: DataFrame) -> DataFrame:
    """Comparable rows by a 128-bit hash (digest1, digest2, cnt); equal rows have the same one."""
    hashed = rows.selectExpr(*(f"{row_digest(rows, seed)} AS digest{seed}" for seed in (1, 2)))
    return hashed.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("cnt"))


def _copies_among(rows: DataFrame, repeated: DataFrame) -> int:
    """Copies among the rows whose hash is repeated, by all columns."""
    names = [f"c{i}" for i in range(len(rows.columns))]
    hashes = [f"{row_digest(rows, seed)} AS digest{seed}" for seed in (1, 2)]
    keyed = rows.selectExpr(*(f"{quoted(c)} AS {n}" for c, n in zip(rows.columns, names)), *hashes)
    groups = keyed.join(repeated, _KEYS, "left_semi").groupBy(*_KEYS, *names)
    return groups.agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.sum("more")).first()[0] or 0


def duplicate_rows(df: DataFrame, digest: bool = False) -> DataFrame:
    """Rows equal on all columns to another row, the first of each not counted.

    Rows are counted by a 128-bit hash first, copies summed before the shuffle, so
    that no column of the table is shuffled.  Only rows whose hash comes twice are
    then compared on all columns, NULLs being equal.  With ``digest`` the hash
    decides alone, with a collision chance below 1e-14 at 1e12 rows.
    """
    rows, counted = comparable(df), Observation("duplicates")
    if not df.columns:
        n = df.count()
        return _result(df, n, max(0, n - 1))
    groups = digest_groups(rows)
    if digest:
        n, copies = groups.agg(F.sum("cnt"), F.sum(F.col("cnt") - 1)).first()
        return _result(df, n or 0, copies or 0)
    found = groups.observe(counted, F.sum("cnt").alias("rows"))
    repeated = found.where(F.col("cnt") > 1).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        hashes, copies = repeated.agg(F.count(F.lit(1)), F.sum(F.col("cnt") - 1)).first()
        if hashes:
            few = repeated.drop("cnt")
            copies = _copies_among(rows, F.broadcast(few) if hashes <= BROADCAST_HASHES else few)
        return _result(df, counted.get["rows"] or 0, copies or 0)
    finally:
        repeated.unpersist()


def _result(df: DataFrame, rows: int, copies: int) -> DataFrame:
    row = {"row_count": rows, "duplicate_rows": copies, "duplicate_rate": copies / rows if rows else None}
    return local_frame(df.sparkSession, [row], DUPLICATES)
