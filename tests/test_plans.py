"""Plans that have to hold at scale."""

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.operators import duplicates
from plumbline.operators.duplicates import digest_groups
from workloads.tables import load

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lineitem(spark):
    return load(spark, SF_DIR, "lineitem")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_values_are_cut_before_the_shuffle(lineitem):
    text = plan(pl.top_values(lineitem))
    assert "10, Partial" in text and text.index("10, Final") < text.index("10, Partial")


def test_counts_are_summed_before_the_shuffle(lineitem):
    for df in (pl.value_frequency(lineitem), digest_groups(lineitem), pl.label_distribution(lineitem, "l_returnflag")):
        assert "partial_count(1)" in plan(df)


def test_scans_read_only_the_columns_asked_for(lineitem):
    text = plan(pl.null_profile(lineitem, ["l_tax", "l_discount"]))
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in text
    assert text.count("FileScan") == 1


def test_profiles_without_a_shuffle_of_rows(lineitem):
    for df in (
        pl.null_profile(lineitem),
        pl.completeness(lineitem),
        pl.redundant_columns(lineitem),
        pl.distribution_stats(lineitem),
        pl.mixed_type_columns(lineitem),
    ):
        text = plan(df)
        assert "hashpartitioning" not in text and "rangepartitioning" not in text


def test_constant_columns_stay_in_a_hash_aggregate(lineitem):
    text = plan(pl.redundant_columns(lineitem))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_digests_keep_rows_out_of_the_shuffle(lineitem):
    text = plan(digest_groups(lineitem))
    keys = text[text.index("Exchange hashpartitioning(") :].split("\n")[0]
    assert "l_" not in keys and "digest1" in keys
    assert text.count("Exchange") == 1


def test_hot_group_of_copies(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("text")
    )
    for digest in (False, True):
        assert pl.duplicate_rows(df, digest).first().duplicate_rows == 2999
    top = pl.top_values(df, k=1).first()
    assert (top.value, top.cnt) == ("copy", 3000)


def test_equal_hashes_of_unequal_rows_are_told_apart(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (None, None), (None, None), (3, "c")]
    df = spark.createDataFrame(rows, "i int, s string")
    monkeypatch.setattr(duplicates, "row_digest", lambda _, seed: f"CAST({seed} AS bigint)")
    assert pl.duplicate_rows(df).first().duplicate_rows == 3
    assert pl.duplicate_rows(df, digest=True).first().duplicate_rows == 7
    monkeypatch.setattr(duplicates, "BROADCAST_HASHES", 0)
    assert pl.duplicate_rows(df).first().duplicate_rows == 3


def test_a_thousand_rules_are_one_scan(lineitem):
    kinds = [("range", {"min": 0, "max": 10}), ("not_null", True), ("length", {"max": 3}), ("enum", [1, 2])]
    columns = ["l_orderkey", "l_quantity", "l_linenumber", "l_tax"]
    rules = [pl.SyntacticRule(c, *kind) for c in columns for kind in kinds] * 62
    rules += [pl.SyntacticRule("l_returnflag", "enum", ["A", "R"]), pl.SyntacticRule("l_linestatus", "format", "[A-Z]")]
    few, many = (plan(pl.check_rules(lineitem, r)) for r in (rules[-80:], rules))
    assert len(rules) == 994 and many.count("FileScan") == 1 and many.count("\n") == few.count("\n")
    assert "hashpartitioning(rule" in many and "BroadcastNestedLoopJoin" not in many


def test_temporal_rules_shuffle_their_rows_once(spark, lineitem):
    counted = pl.temporal_violations(lineitem, "l_shipdate", ["l_orderkey"], ["l_linenumber"])
    text = plan(counted)
    assert text.count("hashpartitioning(") == 1 and "rangepartitioning" not in text
    assert text.count("FileScan") == 1
