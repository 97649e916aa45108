import datetime as dt
import random
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.sources.csv_blocks import csv_records
from plumbline.streaming.quality import utc_instant, utc_wall_clock

ROWS = [(1, "a", 1.5), (2, "b", None), (3, None, 2.0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "i int, s string, x double")


def plain(df):
    return sorted((tuple(r) for r in df.select("i", "s", "x").collect()), key=repr)


def test_round_trips(spark, frame, tmp_path):
    for fmt in ("csv", "parquet", "json"):
        pl.write_table(frame.coalesce(1), str(tmp_path / fmt), fmt)
    assert plain(pl.read_table(spark, str(tmp_path / "csv"), "csv")) == sorted(ROWS, key=repr)
    assert plain(pl.read_table(spark, str(tmp_path / "parquet"), "parquet")) == sorted(ROWS, key=repr)
    assert plain(pl.read_table(spark, str(tmp_path / "json"), "jsonl")) == sorted(ROWS, key=repr)


def test_suffix_decides(spark, tmp_path):
    records = [{"i": i, "s": s, "x": x} for i, s, x in ROWS]
    (tmp_path / "a.JSON").write_text(json.dumps(records, indent=1))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "a.csv").write_text("i,s,x\n1,a,1.5\n2,b,\n3,,2.0\n")
    for name in ("a.JSON", "a.jsonl", "a.csv"):
        assert plain(pl.read_table(spark, str(tmp_path / name))) == sorted(ROWS, key=repr)
    with pytest.raises(ValueError):
        pl.read_table(spark, str(tmp_path / "a.xml"))


def test_schema_spares_inference(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,s\n1,2\n")
    df = pl.read_table(spark, str(tmp_path / "a.csv"), schema="i string, s string")
    assert df.dtypes == [("i", "string"), ("s", "string")]


def workbook(path, header, rows):
    """A small .xlsx with shared strings, inline strings, booleans and dates."""
    shared = list(dict.fromkeys(header))

    def cell(ref, value):
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, dt.date):
            serial = (value - dt.date(1899, 12, 30)).days
            return f'<c r="{ref}" s="1"><v>{serial}</v></c>'
        if value in shared:
            return f'<c r="{ref}" t="s"><v>{shared.index(value)}</v></c>'
        if isinstance(value, str):
            return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
        return f'<c r="{ref}"><v>{value}</v></c>'

    lines = "".join(
        f'<row r="{n}">' + "".join(cell(f"{chr(65 + i)}{n}", v) for i, v in enumerate(row)) + "</row>"
        for n, row in enumerate([header, *rows], 1)
    )
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{lines}</sheetData></worksheet>")
        items = "".join(f"<si><t>{s}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>{items}</sst>")
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )


def test_excel_folder(spark, tmp_path):
    header = ["i", "s", "x", "ok", "day"]
    workbook(tmp_path / "a.xlsx", header, [[1, "a", 1.5, True, dt.date(2024, 2, 29)], [2, None, None, False, None]])
    workbook(tmp_path / "b.xlsx", ["s", "i"], [["z", 7]])
    df = pl.read_table(spark, str(tmp_path), "excel")
    assert df.dtypes == [
        ("i", "bigint"),
        ("s", "string"),
        ("x", "double"),
        ("ok", "boolean"),
        ("day", "timestamp_ntz"),
    ]
    rows = {r.i: r for r in df.collect()}
    assert rows[1].day == dt.datetime(2024, 2, 29) and rows[1].x == 1.5 and rows[2].ok is False
    assert (rows[7].s, rows[7].x) == ("z", None)
    typed = pl.read_table(spark, str(tmp_path / "a.xlsx"), schema="i int, day date")
    assert typed.orderBy("i").first().day == dt.date(2024, 2, 29)


def test_metadata(spark):
    row = pl.metadata_frame(spark, '{"source_name": "x", "creation_date": 2024, "owner": "me"}').first()
    assert (row.source_name, row.creation_date, row.extra) == ("x", "2024", {"owner": "me"})
    df = spark.createDataFrame([(1, '{"license": "CC"}')], "id int, meta string")
    assert pl.metadata_column(df, "meta").first().license == "CC"


@pytest.fixture(scope="module")
def events(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i), float(i % 10)) for i in range(100)]
    return spark.createDataFrame(rows, "id int, ts timestamp_ntz, v double")


RULES = [pl.SyntacticRule("v", "range", {"max": 7}, rule_id="v")]


def test_utc_conversions_are_inverse(events):
    back = events.select((utc_wall_clock(utc_instant(F.col("ts"))) == F.col("ts")).alias("same"))
    assert back.filter("same").count() == 100


def streamed(spark, path, out, checkpoint):
    stream = spark.readStream.schema("id int, ts timestamp_ntz, v double").parquet(path)
    query = pl.write_closed_windows(pl.stream_quality(stream, "ts", "2 hours", "1 day", RULES), out, checkpoint)
    query.awaitTermination()
    columns = ["window_start", "violations", "total"]
    return sorted(
        tuple(r) for r in spark.read.parquet(out).withColumn("window_start", utc_wall_clock(F.col("window_start"))).select(columns).collect()
    )


def test_stream_equals_batch_and_drops_late_rows(spark, events, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    events.coalesce(1).write.parquet(source)
    batch = pl.windowed_quality(events, "ts", "1 day", RULES)
    expected = sorted(
        (r.window_start, r.violations, r.total) for r in batch.collect() if r.window_end <= dt.datetime(2024, 1, 5, 1)
    )
    assert streamed(spark, source, out, mark) == expected and len(expected) == 4
    late = spark.createDataFrame(
        [(500, dt.datetime(2024, 1, 1, 5), 99.0), (501, dt.datetime(2024, 1, 7), 99.0)], events.schema
    )
    late.coalesce(1).write.mode("append").parquet(source)
    later = streamed(spark, source, out, mark)
    assert later[:4] == expected
    assert later[4] == (dt.datetime(2024, 1, 5), 2, 4)


def test_slices_add_up_to_the_whole(spark, events):
    df = events.withColumn("kind", F.col("id") % 3)
    whole = pl.check_rules(df, RULES).first()
    parts = pl.sliced_quality(df, ["kind"], RULES).collect()
    assert sum(r.violations for r in parts) == whole.violations
    assert sum(r.total for r in parts) == whole.total and len(parts) == 3


def test_csv_keeps_quoted_line_breaks_and_knows_missing_tokens(spark, tmp_path):
    path = str(tmp_path / "quoted.csv")
    with open(path, "w") as f:
        f.write('id,text,x\n1,"a ""b""\nc",1.5\n2,NA,NULL\n3,"",2\n')
    df = pl.read_table(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "text": "string", "x": "double"}
    assert sorted(map(tuple, df.collect())) == [(1, 'a "b"\nc', 1.5), (2, None, None), (3, None, 2.0)]


def test_json_by_column_is_refused(spark, tmp_path):
    path = tmp_path / "columns.json"
    path.write_text('{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}')
    with pytest.raises(ValueError, match="by column"):
        pl.read_table(spark, str(path))


def test_excel_keeps_every_column(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", ["k", "v"], [[1, "x"]])
    workbook(tmp_path / "b.XLSX", ["k", None, "v", "v", "extra"], [[2, "blank", "y", "z", "1234567890123456789"]])
    df = pl.read_table(spark, str(tmp_path), "excel")
    assert df.columns == ["k", "v", "Unnamed: 1", "v.1", "extra"]
    assert dict(df.dtypes)["extra"] == "bigint"
    rows = {r.k: tuple(r) for r in df.collect()}
    assert rows[1] == (1, "x", None, None, None)
    assert rows[2] == (2, "y", "blank", "z", 1234567890123456789)


def test_csv_sink_reads_back_exactly(spark, tmp_path):
    rows = [(1, 'say "so", then'), (2, "two\nlines"), (3, "  ends  "), (4, None), (5, "back\\slash"), (6, "")]
    path = str(tmp_path / "texts.csv")
    pl.write_table(spark.createDataFrame(rows, "id long, text string"), path, "csv")
    # As in any CSV file, a text of no characters is a missing one.
    assert sorted(map(tuple, pl.read_table(spark, path).collect())) == [*rows[:-1], (6, None)]


def csv_text(draw, rows):
    """Lines of cells, some quoted with line breaks, separators and doubled quotes inside."""
    cells = ["plain", "", '"two\nlines"', '"a ""quoted"" word"', '"x,y"', '"\n\n"', '"long\r\n' + "line of text\n" * 9 + '"', "é", '""""', '"\n"""']
    return "id,a,b\n" + "".join(f"{i},{draw.choice(cells)},{draw.choice(cells)}\n" for i in range(rows))


@pytest.mark.parametrize("block", [64, 700, 10_000])
def test_split_csv_is_the_same_as_one_task(spark, tmp_path, block):
    draw = random.Random(block)
    for k in range(2):
        (tmp_path / f"part{k}.csv").write_bytes(csv_text(draw, 60).encode())
    path = str(tmp_path)
    whole = pl.read_table(spark, path, "csv", missing=())
    wanted = sorted(map(tuple, whole.collect()), key=repr)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        split = pl.read_table(spark, path, "csv", missing=(), split=True)
        assert split.columns == whole.columns and split.dtypes == whole.dtypes
        assert sorted(map(tuple, split.collect()), key=repr) == wanted and len(wanted) == 120
        records = csv_records(spark, path)
        assert records.rdd.getNumPartitions() > 1 and records.where("block > 0").count() > 0 or block == 10_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_split_csv_edges(spark, tmp_path):
    path = str(tmp_path / "a.csv")

    def read(text, **options):
        with open(path, "wb") as f:
            f.write(text.encode())
        return pl.read_table(spark, path, split=True, **options)

    lines = read("id,text\r\n1,a\r\n\r\n2,\"b\r\nc\"\r\n")
    # A line break inside of a cell is as in the file, where one task would write \r\n as \n.
    assert sorted(map(tuple, lines.collect())) == [(1, "a"), (2, "b\r\nc")]
    assert read("id,text\n").count() == 0
    df = read('id;text\n1;\'a\n"b\'\n', sep=";", quote="'", schema="n int, s string")
    assert [tuple(r) for r in df.collect()] == [(1, 'a\n"b')]
    assert sorted(r.id for r in read("id,text\n1,NA\n2,x").collect()) == [1, 2]
