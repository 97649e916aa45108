import math

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

import plumbline as pl
from plumbline.operators import frequency
from plumbline.operators.quantiles import values_at_ranks


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [
            (1, 1.0, "a", True, [1]),
            (2, float("nan"), "b", False, [2]),
            (2, None, "b", True, [2]),
            (3, 5.0, None, None, None),
            (1, 1.0, "a", True, [1]),
        ],
        "i int, x double, s string, b boolean, arr array<int>",
    )


def by_name(df):
    return {r.column_name: r for r in df.collect()}


def test_nan_and_null_are_missing(frame):
    nulls = by_name(pl.null_profile(frame))
    assert nulls["x"].null_count == 2 and nulls["s"].null_count == 1
    assert pl.completeness(frame).first().null_cells == 5
    x = by_name(pl.numeric_profile(frame))["x"]
    assert (x.non_null, x.max_value, x.mean) == (3, 5.0, 7 / 3)


def test_booleans_are_categorical(frame):
    assert pl.numeric_columns(frame) == ["i", "x"]
    top = pl.top_values(frame, ["b"]).collect()
    assert [(r.value, r.cnt) for r in top] == [("true", 3), ("false", 1)]


def test_profile_of_every_column(frame):
    profile = by_name(pl.column_profile(frame))
    assert profile["i"].unique_count == 3 and profile["arr"].unique_count == 2
    assert profile["s"].mean is None and profile["b"].data_type == "boolean"


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (None, 1)], "a int, b int")
    for digest in (False, True):
        row = pl.duplicate_rows(df, digest).first()
        assert (row.duplicate_rows, row.duplicate_rate) == (1, 0.25)


def test_duplicates_of_negative_zero_nan_maps(spark):
    df = spark.createDataFrame(
        [(0.0, {"a": 1, "b": 2}), (-0.0, {"b": 2, "a": 1}), (float("nan"), None), (None, None)],
        "x double, m map<string,int>",
    )
    for digest in (False, True):
        assert pl.duplicate_rows(df, digest).first().duplicate_rows == 2


def test_adding_a_duplicate_counts_one_more(frame):
    before = pl.duplicate_rows(frame).first().duplicate_rows
    after = pl.duplicate_rows(frame.union(frame.filter("i = 3"))).first().duplicate_rows
    assert after == before + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, s string, label string, d date")
    assert pl.duplicate_rows(df).first().asDict() == {
        "row_count": 0,
        "duplicate_rows": 0,
        "duplicate_rate": None,
    }
    assert pl.value_completeness(df).first().value_completeness == 100.0
    assert pl.record_completeness(df).first().record_completeness == 100.0
    assert pl.record_consistency(df).first().record_consistency == 100.0
    assert by_name(pl.numeric_profile(df))["a"].median is None
    assert pl.value_occurrence_completeness(df).first().value_occurrence_completeness is None
    assert pl.class_balance(df).first().class_balance is None
    assert pl.trend_component(df, ["a"]).first().trend is False
    assert {r.unique_count for r in pl.unique_counts(df).collect()} == {0}


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame(
        [(None, 7.0, 1), (None, 7.0, 2), (None, 7.0, 3), (None, 7.0, None)],
        "a double, c double, v int",
    )
    redundant = {r.column_name: r.reason for r in pl.redundant_columns(df).collect()}
    assert redundant == {"a": "all_null", "c": "constant"}
    stats = by_name(pl.distribution_stats(df))
    assert (stats["c"].skewness, stats["c"].kurtosis, stats["c"].cv) == (0.0, 0.0, 0.0)
    assert stats["a"].skewness is None and stats["v"].kurtosis is None
    assert by_name(pl.iqr_outliers(df))["c"].outlier_count == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_shape_of_constant_columns(spark, n):
    df = spark.range(n).select(F.lit(3.0).alias("c"))
    row = pl.distribution_stats(df).first()
    s = pd.Series([3.0] * n)
    assert (row.skewness is None) == math.isnan(s.skew())
    assert (row.kurtosis is None) == math.isnan(s.kurt())


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], ["a.b", "c d`e"])
    assert by_name(pl.column_profile(df))["a.b"].unique_count == 2
    assert pl.redundant_columns(df).count() == 0
    assert pl.duplicate_rows(df).first().duplicate_rows == 0
    rule = pl.SyntacticRule("a.b", "range", {"max": 1})
    assert pl.check_rules(df, [rule]).first().violations == 1


def test_selectors(spark):
    df = spark.createDataFrame([], "sentiment int, `update` string, ts timestamp, Target int, y int")
    assert pl.datetime_columns(df) == ["sentiment", "update"]
    assert pl.datetime_columns(df, by="type") == ["ts"]
    assert pl.label_column(df) == "Target"
    assert pl.label_column(df, "y") == "y"
    with pytest.raises(ValueError):
        pl.datetime_columns(df, by="guess")


@pytest.mark.parametrize("limit", [1, 7, 100, 10**9])
def test_quantiles_match_pandas(spark, limit):
    df = spark.range(0, 5000, 1, 7).select(
        (F.pmod(F.hash("id"), F.lit(997)) - 300).cast("double").alias("h"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1e-3).alias("hot"),
        (F.col("id") % 2).alias("two"),
        F.exp((F.col("id") % 700).cast("double")).alias("wide"),
        F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id")).alias("gaps"),
        F.when(F.col("id") == 5, float("inf")).otherwise(F.col("id")).cast("double").alias("inf"),
    )
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = pl.quantiles(df, df.columns, probabilities, gather_limit=limit)
    table = df.toPandas()
    for c in df.columns:
        expected = table[c].quantile(probabilities).tolist()
        if c == "inf":
            # Pandas interpolates from infinity to infinity, which gives NaN.
            assert found[c].pop() == float("inf") and math.isnan(expected.pop())
        assert found[c] == pytest.approx(expected, rel=1e-12), c


def test_rank_of_hot_value_needs_no_gathering(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 9000, 1.0).otherwise(F.col("id")).alias("v"))
    ranked = values_at_ranks(df, {"v": [10, 8999, 9000]}, {"v": 10_000}, gather_limit=10)
    assert ranked["v", 10].value == ranked["v", 8999].value == 1.0
    assert (ranked["v", 10].below, ranked["v", 10].equal) == (0, 9000)
    assert ranked["v", 9000].value == 9000.0


def test_approximate_quantiles_are_close(spark):
    df = spark.range(10_000)
    (median,) = pl.quantiles(df, ["id"], [0.5], approx=True)["id"]
    assert abs(median - 5000) < 50


def test_outliers_match_pandas(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 100, -90, 28.5]], "v double")
    s = df.toPandas().v
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    expected = ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    assert pl.iqr_outliers(df).first().outlier_count == expected


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "s string")
    rows = pl.top_values(df, k=2).orderBy("rank").collect()
    assert [(r.rank, r.value, r.cnt) for r in rows] == [(1, "c", 2), (2, "a", 1)]


def test_profile_lines_are_complete(frame):
    lines = [r.text for r in pl.profile_lines(frame, order_by=["i"]).collect()]
    assert lines[0] == "Dataset: 5 rows x 5 columns"
    assert any("i [int]" in t for t in lines) and any("arr [array<int>]" in t for t in lines)
    assert lines.index("Sample rows:") < len(lines) - 1


def test_partitioning_changes_nothing(frame):
    before = by_name(pl.column_profile(frame))
    for n in (1, 16):
        after = by_name(pl.column_profile(frame.repartition(n)))
        for c, row in before.items():
            moved = after[c].asDict()
            for k, v in row.asDict().items():
                assert moved[k] == (pytest.approx(v) if isinstance(v, float) else v)


def test_mixed_types(spark):
    df = spark.createDataFrame(
        [("1", "a", "1"), ("2.5", "b", "2"), ("true", None, "3"), ("2024-01-01 10:00:00", "c", "-4"), ("x", "d", "+5")],
        "m string, s string, i string",
    )
    counts = {(r.column_name, r.value_class): r.cnt for r in pl.mixed_type_columns(df).collect()}
    assert counts == {("m", k): 1 for k in ("int", "float", "bool", "date", "string")}
    row = pl.format_consistency(df).first()
    assert row.mixed_columns == 1 and row.format_consistency == pytest.approx(200 / 3)
    assert pl.format_consistency(spark.range(3)).first().format_consistency == 100.0


def test_json_field_types(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": "x", "b": 2.5}',), (None,), ("no json",)], "j string")
    found = {(r.field, r.value_type): r.cnt for r in pl.json_field_types(df, "j").collect()}
    assert found[("a", "BIGINT")] == 1 and found[("a", "STRING")] == 1
    assert found[(None, None)] == 1
    assert ("b", "DECIMAL(2,1)") in found


def test_large_integers_keep_apart(spark):
    df = spark.createDataFrame([(2**62,), (2**62 + 1,)], "k bigint")
    assert pl.unique_counts(df).first().unique_count == 2


def test_profile_lines_of_many_classes(spark):
    df = spark.range(1000).selectExpr("id % 70 AS label", "id AS x")
    lines = [r["text"] for r in pl.profile_lines(df, "label", top_classes=3).orderBy("line_no").collect()]
    shown = [x for x in lines if x.startswith("  class ")]
    assert shown == ["  class 0: 15", "  class 1: 15", "  class 10: 15"]
    assert lines[lines.index(shown[-1]) + 1] == "  and 67 smaller classes"


def test_sketched_top_values_equal_the_counted_ones(spark):
    rows = [(i % 7 if i % 3 else 0, f"v{i % 50 if i % 2 else i}", i, i % 5 == 0) for i in range(4000)] + [(None, None, None, None)] * 30
    df = spark.createDataFrame(rows, "few int, hot string, each long, flag boolean").withColumn("x", F.col("few") / 2)
    for k in (1, 3, 10):
        wanted = sorted(map(tuple, pl.top_values(df, df.columns, k).collect()), key=str)
        assert sorted(map(tuple, pl.top_values(df, df.columns, k, sketch=True).collect()), key=str) == wanted
    proven = frequency._proven_top(df, df.columns, 3)
    # Each value of ``each`` comes once, which no sketch of some of them can rank.
    assert {"few", "hot", "flag"} <= set(proven) and "x" not in proven
    assert pl.top_values(df.limit(0), df.columns, 3, sketch=True).count() == 0


def test_a_sketch_that_proves_nothing_is_not_believed(spark, monkeypatch):
    monkeypatch.setattr(frequency, "SKETCHED", 100)
    df = spark.range(20000).select(F.when(F.col("id") % 4 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("a"), F.col("id").cast("string").alias("b"))
    assert set(frequency._proven_top(df, ["a", "b"], 1)) == {"a"}
    assert [tuple(r) for r in pl.top_values(df, ["a", "b"], 1, sketch=True).collect()] == [("a", 1, "hot", 5000), ("b", 1, "0", 1)]
