"""Excel workbooks as a distributed source: one task per file.

Spark has no reader for .xlsx, which is a zip of XML parts, so this is the one
place that runs Python in tasks.  A worksheet holds 1,048,576 rows at most,
which bounds what a task reads.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.columns import ref
from plumbline.functions.frames import HEAVY_COLUMNS_PER_STAGE, per_column
from plumbline.operators.consistency import VALUE_CLASSES, value_class

# Built-in number formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}

# Day zero of serial dates; it takes the missing 29 February 1900 into account.
EPOCH = dt.datetime(1899, 12, 30)


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(element: ElementTree.Element) -> str:
    return "".join(e.text or "" for e in element.iter() if _tag(e) == "t")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for e in root.iter():
        if _tag(e) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower()
            if re.search("[ymdhs]", code):
                dates.add(int(e.get("numFmtId", -1)))
    formats = [
        int(x.get("numFmtId", 0)) for e in root.iter() if _tag(e) == "cellXfs" for x in e
    ]
    return {i for i, f in enumerate(formats) if f in dates}


def _column_index(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _texts(cell)
    raw = next((e.text for e in cell if _tag(e) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n":
        if int(cell.get("s", -1)) in dates:
            return (EPOCH + dt.timedelta(days=float(raw))).isoformat(sep=" ")
        number = float(raw)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return raw


def _worksheets(book: zipfile.ZipFile) -> list[str]:
    """Parts of the worksheets, in the order of the workbook, or by number where it lists none."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = {e.get("Id"): e.get("Target", "") for e in links}
        listed = []
        for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
            if _tag(e) == "sheet":
                link = next((v for k, v in e.attrib.items() if k.endswith("}id")), None)
                part = target.get(link, "")
                listed.append(part.lstrip("/") if part.startswith("/") else f"xl/{part}")
        # A chart can be a sheet as well, but has no rows.
        listed = [part for part in listed if part in names and "chartsheets/" not in part]
        if listed:
            return listed
    return sorted(
        (n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)),
        key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1]).group()),
    )


def sheet_rows(content: bytes, sheet: int) -> Iterator[list[str | None]]:
    """The rows of one worksheet as text, streamed from the XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_texts(e) for e in root if _tag(e) == "si"]
        sheets = _worksheets(book)
        dates = _date_styles(book)
        with book.open(sheets[sheet]) as part:
            for _, element in ElementTree.iterparse(part):
                if _tag(element) != "row":
                    continue
                cells: dict[int, str | None] = {}
                for i, cell in enumerate(e for e in element if _tag(e) == "c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else i
                    cells[at] = _value(cell, shared, dates)
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                element.clear()


def column_names(header: list[str | None]) -> list[str]:
    """Names of the columns: blank ones are numbered from 0 by place, repeated ones from 1."""
    names: list[str] = []
    for i, name in enumerate(header):
        base = name if name else f"Unnamed: {i}"
        free, n = base, 0
        while free in names:
            n += 1
            free = f"{base}.{n}"
        names.append(free)
    return names


def _inferred(texts: DataFrame) -> DataFrame:
    """Cast each text column to the type of the one class that all of its values have."""
    classed = texts.select(
        *[F.struct(ref(c).alias("v"), value_class(ref(c)).alias("k")).alias(c) for c in texts.columns]
    )

    def metrics(_: DataFrame, c: str):
        counts = {k: F.count_if(ref(c)["k"] == F.lit(k)) for k in VALUE_CLASSES}
        return counts | {"given": F.count(ref(c)["v"]), "fits": F.count(ref(c)["v"].try_cast("bigint"))}

    chosen = {}
    for r in per_column(classed, texts.columns, metrics, HEAVY_COLUMNS_PER_STAGE).collect():
        if not r.given:
            kind = "string"
        elif r["int"] == r.given:
            # Longer digit strings do not fit and stay text.
            kind = "bigint" if r.fits == r.given else "string"
        elif r["int"] + r["float"] == r.given:
            kind = "double"
        elif r["bool"] == r.given:
            kind = "boolean"
        else:
            kind = "timestamp_ntz" if r["date"] == r.given else "string"
        chosen[r.column_name] = kind
    return texts.select(*[ref(c).try_cast(chosen[c]).alias(c) for c in texts.columns])


def read_excel(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sheet: int = 0
) -> DataFrame:
    """Read a workbook or a folder of workbooks; the first row names the columns.

    Columns are those of the schema, or of all workbooks in the order of their
    paths; each workbook is matched by its own header.  Columns without a name
    and repeated names are numbered.
    """
    suffix = "*.[xX][lL][sS][xX]"
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                names = column_names(next(sheet_rows(bytes(content), sheet), []))
                yield pd.DataFrame({"path": path, "name": names, "position": range(len(names))})

    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is not None:
        names = schema.fieldNames()
    else:
        listed = files.select("path", "content").mapInPandas(headers, "path string, name string, position int")
        seen = listed.groupBy("name").agg(F.min(F.struct("path", "position")).alias("at")).orderBy("at")
        names = [r["name"] for r in seen.collect()]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                lines = sheet_rows(bytes(content), sheet)
                header = column_names(next(lines, []))
                at = [header.index(n) if n in header else None for n in names]
                block = []
                for line in lines:
                    block.append(
                        [line[i] if i is not None and i < len(line) else None for i in at]
                    )
                    if len(block) == 10_000:
                        yield pd.DataFrame(block, columns=names, dtype=object)
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=names, dtype=object)

    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    texts = files.select("content").mapInPandas(rows, text_schema)
    if schema is not None:
        return texts.select(*[ref(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
    return _inferred(texts)
