"""Readers by file format, and dataset metadata."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.columns import ref
from plumbline.functions.frames import local_frame
from plumbline.sources.csv_blocks import read_csv_blocks
from plumbline.sources.excel import read_excel

# Formats by file suffix.
FORMATS = {
    ".csv": "csv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "jsonl",
    ".xlsx": "excel",
}

# Texts in a CSV file that stand for a missing value.
MISSING_TOKENS = (
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Types that text columns are tried for, in order, and what their values look like.
TEXT_TYPES = {
    "bigint": r"[+-]?\d+",
    "double": r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?",
    "boolean": r"(?i:true|false)",
    "date": r"\d{4}-\d\d-\d\d",
    "timestamp": r"\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d(?::\d\d(?:\.\d+)?)?)?",
}

# Metadata keys; the first seven speak for the credibility of the source.
METADATA_KEYS = (
    "source_name",
    "source_url",
    "collection_method",
    "documentation_url",
    "creation_date",
    "anonymization",
    "license",
    "last_updated",
    "feature_collection_period",
)


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | str | None = None,
    missing: Sequence[str] = MISSING_TOKENS,
    split: bool = False,
    **options,
) -> DataFrame:
    """Read a file or folder; the format comes from the suffix unless given.

    Formats are csv (with header), parquet, json (array of records), jsonl and
    excel (.xlsx).  A schema saves the extra pass that inferring types takes.
    CSV cells that equal one of ``missing`` are NULL unless a schema is given.
    Quoted line breaks keep a CSV file in one task.  ``multiLine=False`` lets Spark
    split files that have none, ``split=True`` splits any with a header; of the
    options, that one knows ``sep`` and ``quote`` only.
    """
    suffix = PurePosixPath(str(path)).suffix.lower()
    kind = format or FORMATS.get(suffix)
    if kind not in FORMATS.values():
        raise ValueError(f"Unsupported file format: {format or suffix}")
    if kind == "excel":
        return read_excel(spark, str(path), schema=schema, **options)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        # A doubled quote is a quote, and quoted line breaks are kept; the caller's options win.
        plain = {"header": True, "multiLine": True, "escape": '"'} | options
        text = spark.read.options(**plain)
        if split:
            names = text.csv(str(path)).columns
            cells = read_csv_blocks(spark, str(path), names, **options)
            if schema is None:
                return typed(without_tokens(cells, missing))
            wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            renamed = cells.toDF(*wanted.fieldNames())
            return renamed.select(*[ref(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])
        if schema is not None:
            return text.schema(schema).csv(str(path))
        return typed(without_tokens(text.csv(str(path)), missing))
    if kind == "json":
        df = reader.option("multiLine", True).json(str(path))
        if schema is None and _by_column(df):
            raise ValueError("JSON by column is not read; write an array of records")
        return df
    if kind == "jsonl":
        return reader.json(str(path))
    return reader.parquet(str(path))


def without_tokens(df: DataFrame, missing: Sequence[str]) -> DataFrame:
    """Text cells that stand for a missing value become NULL."""
    tokens = [F.lit(t) for t in missing]
    if not tokens:
        return df
    return df.select(*[F.when(~ref(c).isin(*tokens), ref(c)).alias(c) for c in df.columns])


def typed(df: DataFrame) -> DataFrame:
    """Text columns as the first type that all their values can be cast to, found in one pass."""
    fits = [
        F.every(
            ref(c).isNull() | F.when(ref(c).rlike(rf"\A(?:{p})\z"), ref(c).try_cast(k).isNotNull()).otherwise(False)
        ).alias(f"{i}_{k}")
        for i, c in enumerate(df.columns)
        for k, p in TEXT_TYPES.items()
    ]
    filled = [F.count(ref(c)).alias(f"{i}_n") for i, c in enumerate(df.columns)]
    if not fits:
        return df
    found = df.agg(*fits, *filled).first()
    chosen = [
        next((k for k in TEXT_TYPES if found[f"{i}_n"] and found[f"{i}_{k}"]), "string") for i in range(len(df.columns))
    ]
    return df.select(*[ref(c).cast(k).alias(c) for c, k in zip(df.columns, chosen)])


def _by_column(df: DataFrame) -> bool:
    """One record of columns, as {name: {row: value}} or {name: [values]}, in place of records."""
    kinds = [f.dataType for f in df.schema]
    by_row = [isinstance(k, T.StructType) and k.names and all(n.isdigit() for n in k.names) for k in kinds]
    return bool(kinds) and (all(by_row) or all(isinstance(k, T.ArrayType) for k in kinds) and len(df.take(2)) == 1)


def metadata_frame(spark: SparkSession, metadata: str | Mapping[str, object]) -> DataFrame:
    """One row of text columns, one per metadata key, from JSON text or a mapping.

    Keys beyond the known ones come along in ``extra``.
    """
    given = json.loads(metadata) if isinstance(metadata, str) else dict(metadata)
    text = {k: None if v is None else str(v) for k, v in given.items()}
    row = {k: text.get(k) for k in METADATA_KEYS}
    row["extra"] = {k: v for k, v in text.items() if k not in METADATA_KEYS}
    schema = T.StructType(
        [T.StructField(k, T.StringType()) for k in METADATA_KEYS]
        + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
    )
    return local_frame(spark, [row], schema)


def metadata_column(df: DataFrame, json_col: str) -> DataFrame:
    """Metadata rows from a column of JSON text, one row per dataset."""
    parsed = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.StringType()))
    kept = [c for c in df.columns if c != json_col]
    return df.withColumn("_meta", parsed).select(
        *kept, *[F.try_element_at("_meta", F.lit(k)).alias(k) for k in METADATA_KEYS]
    )
