import random

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.operators import semantic
from plumbline.operators.semantic import temporal_violations

M = pl.SemanticRule


def check(df, rule, tables=None):
    return pl.check_semantic_rules(df, [rule], tables).first()


def test_cross_field_null_is_not_a_violation(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 2)], "a int, b int")
    row = check(df, M("r", "cross_field", ("a", "b"), expression="a <= b"))
    assert (row.violations, row.total, row.field) == (1, 3, "a,b")


def test_conditional(spark):
    df = spark.createDataFrame([("R", "F"), ("R", "O"), ("N", "O")], "a string, b string")
    rule = M("r", "domain_logic", ("a", "b"), condition="a = 'R'", expression="b = 'F'")
    assert check(df, rule).violations == 1


@pytest.mark.parametrize(
    ("rule", "status"),
    [
        (M("r", "cross_field", ("a",)), "unsupported_rule"),
        (M("r", "cross_field", ("nowhere",), expression="a > 1"), "column_missing"),
        (M("r", "cross_field", ("a",), expression="a >"), "invalid_expression"),
        (M("r", "cross_field", ("a",), expression="zzz > 1"), "invalid_expression"),
        (M("r", "cross_field", ("a",), expression="a + 1"), "invalid_expression"),
        (M("r", "temporal", ("a",)), "unsupported_rule"),
        (M("r", "temporal", ("a",), key_columns=("zz",), order_columns=("a",)), "column_missing"),
        (M("r", "referential", ("a",), ref_table="none"), "unsupported_rule"),
        (M("r", "guess", ("a",)), "unsupported_rule"),
    ],
)
def test_rules_that_cannot_run(spark, rule, status):
    df = spark.createDataFrame([(1,)], "a int")
    row = check(df, rule)
    assert (row.status, row.violations) == (status, None)


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_temporal_against_plain_python_with_a_hot_key(spark, partitions):
    rng = random.Random(partitions)
    rows = [
        (
            "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}",
            None if rng.random() < 0.02 else rng.randrange(300),
            None if rng.random() < 0.05 else rng.randrange(100),
        )
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "k string, seq int, v int")
    found = pl.temporal_violations(df, "v", ["k"], ["seq"], partitions).first()
    expected, last = 0, {}
    for k, seq, v in sorted((r for r in rows if None not in r)):
        expected += k in last and v < last[k]
        last[k] = v
    assert (found.violations, found.total) == (expected, 3000)


def test_temporal_cuts_a_hot_key_into_buckets(spark):
    df = spark.range(10000).select(F.floor(F.col("id") / 10000).alias("k"), F.col("id").alias("seq"), F.col("id").alias("v"))
    plan = pl.temporal_violations(df, "v", ["k"], ["seq"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key0" in plan and plan.count("hashpartitioning(") == 1
    columns = [F.col("id").alias("key0"), (F.col("id") / 2).alias("order0")]
    layout = semantic._layout(df.select(F.lit(1).alias("key0"), F.col("seq").alias("order0")), F.xxhash64("key0"), F.xxhash64("key0", "order0"), F.col("order0").cast("double"), F.lit(True), 4)
    assert len(layout.hot) == 1 and len(layout.bounds) == 4 * semantic.BUCKETS - 1 and not layout.repeated
    even = spark.range(10000).select(*columns)
    assert not semantic._layout(even, F.xxhash64("key0"), F.xxhash64(*even.columns), F.col("order0"), F.lit(True), 4).hot


def test_places_of_wall_clocks_ignore_zones(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        minutes = spark.range(0, 600, 10).select(F.expr("timestamp_ntz'2024-03-31 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0)").alias("order0"))
        places = [r.place for r in minutes.orderBy("order0").select(semantic._place(minutes, "order0").alias("place")).collect()]
        assert places == sorted(places) and len(set(places)) == 60
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "double", "decimal(30,2)", "boolean"])
def test_places_never_fall(spark, kind):
    ids = spark.range(-40, 400, 7).select(F.col("id").cast("int").alias("id"))
    values = {
        "string": F.concat(F.lit("é"), F.col("id").cast("string")),
        "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("id")),
        "timestamp": F.timestamp_seconds(F.col("id") * 86400.0),
        "timestamp_ntz": F.timestamp_seconds(F.col("id") * 86400.0).cast("timestamp_ntz"),
        "boolean": F.col("id") > 9,
    }
    df = ids.select(values.get(kind, F.col("id").cast(kind)).alias("order0"))
    rows = df.orderBy("order0").select("order0", semantic._place(df, "order0").alias("place")).collect()
    places = [r.place for r in rows]
    assert places == sorted(places) and None not in places
    keyed = df.withColumn("k", F.lit("x")).withColumn("v", F.lit(1))
    assert temporal_violations(keyed, "v", ["k"], ["order0"], 2).first().violations == 0


def test_referential_with_hot_and_null_keys(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 20 + [(None,)] * 5 + [(9,)] * 3, "fk int")
    ref = spark.createDataFrame([(1,), (1,), (2,), (None,)], "pk int")
    rule = M("r", "referential", ("fk",), ref_table="t", ref_columns=("pk",))
    row = check(df, rule, {"t": ref})
    assert (row.violations, row.total) == (3, 78)
    plan = pl.referential_violations(df, ["fk"], ref, ["pk"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [fk")


def test_referential_on_several_columns(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "x int, y string")
    ref = spark.createDataFrame([(1, "a")], "x int, y string")
    rule = M("r", "referential", ("x", "y"), ref_table="t")
    assert check(df, rule, {"t": ref}).violations == 1


def test_rule_kinds_together_keep_their_ids(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    rules = [
        M("t", "temporal", ("b",), key_columns=("a",), order_columns=("b",)),
        M("c", "cross_field", ("a", "b"), expression="a < b"),
        M("d", "domain_logic", ("a",), expression="a > 0"),
    ]
    found = {r.rule_id: r.rule_type for r in pl.check_semantic_rules(df, rules).collect()}
    assert found == {"S1": "temporal", "S2": "cross_field", "S3": "domain_logic"}


def test_field_stats(spark):
    df = spark.createDataFrame([(i, None if i < 2 else f"v{i % 3}") for i in range(10)], "o int, s string")
    rules = [M("r", "cross_field", ("s", "gone"))]
    (row,) = pl.semantic_field_stats(df, rules, ["o"]).collect()
    assert row.sample == ["v2", "v0", "v1", "v2", "v0"]
    assert (row.field, row.null_rate, row.unique_count) == ("s", 0.2, 3)


def test_keys_of_another_type_do_not_stop_the_check(spark):
    df = spark.createDataFrame([("abc",), ("1",)], "k string")
    known = spark.createDataFrame([(1,)], "id bigint")
    rule = pl.SemanticRule("r", "referential", ("k",), "", rule_id="r", ref_table="known", ref_columns=("id",))
    row = pl.check_semantic_rules(df, [rule], {"known": known}).first()
    assert (row.status, row.violations) == ("type_mismatch", None)
    with pytest.raises(ValueError):
        pl.violating_semantic_rows(df, rule, {"known": known})


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_violating_rows_of_temporal_rules_are_brute_force(spark, partitions):
    import random

    draw = random.Random(partitions)
    rows = [(draw.choice("aab"), draw.randrange(40), draw.randrange(9), i) for i in range(300)]
    rows += [("a", None, 3, 1000), (None, 2, 1, 1001), ("b", 3, None, 1002)]
    df = spark.createDataFrame(rows, "k string, o int, v int, id int")
    rule = pl.SemanticRule("t", "temporal", ("v",), "", rule_id="t", key_columns=("k",), order_columns=("o",))
    positions = sorted({r[:3] for r in rows if None not in r[:3]})
    broken = {q for p, q in zip(positions, positions[1:]) if p[0] == q[0] and q[2] < p[2]}
    found = pl.violating_semantic_rows(df, rule, partitions=partitions)
    assert sorted(r.id for r in found.collect()) == sorted(r[3] for r in rows if r[:3] in broken)
    checked = pl.check_semantic_rules(df, [rule], partitions=partitions).first()
    assert (checked.violations, checked.total) == (len(broken), len(rows))


def test_tied_hot_key_is_merged_before_the_shuffle(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), (F.col("id") % 7).alias("o"), F.lit(1).alias("v"))
    text = temporal_violations(df, "v", ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(" in text[text.rindex("Exchange hashpartitioning") :]
    assert temporal_violations(df, "v", ["k"], ["o"]).first().violations == 0
