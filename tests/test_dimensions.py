import datetime as dt

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.plans.catalogue import DIMENSIONS


def test_labels(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)] * 2, "label string")
    voc = pl.value_occurrence_completeness(df).first()
    assert voc.value_occurrence_completeness == pytest.approx(100 * (4 + 2) / 8)
    assert pl.label_completeness(df).first().label_completeness == 80.0
    assert pl.class_balance(df).first().class_balance == pytest.approx(1 / 3)
    assert pl.category_size_diversity(df).first().category_size_diversity == 50.0
    imbalance = pl.label_imbalance(df).first()
    assert (imbalance.max_abundance, imbalance.imbalance_ratio) == (0.75, 3.0)
    shares = {r.label: r.abundance for r in pl.label_abundance(df).collect()}
    assert shares == {"a": 0.75, "b": 0.25}


def test_half_is_not_below_half(spark):
    df = spark.createDataFrame([("a",), ("b",)], "label string")
    assert pl.category_size_diversity(df).first().classes_below_half == 0


def test_all_labels_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "label string")
    assert pl.label_richness(df).first().classes == 0
    assert pl.value_occurrence_completeness(df).first().value_occurrence_completeness is None
    assert pl.category_size_diversity(df).first().category_size_diversity is None


def test_label_is_required(spark):
    with pytest.raises(ValueError):
        pl.label_distribution(spark.range(3))


@pytest.mark.parametrize("limit", [1, 5, 10**6])
@pytest.mark.parametrize("ties", [1, 7, 400])
def test_trend_matches_pandas(spark, limit, ties):
    df = spark.range(0, 400, 1, 5).select(
        (F.col("id") / ties).cast("bigint").alias("day"),
        F.pmod(F.hash("id"), F.lit(1000)).alias("key"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 90 + F.col("id") * 0.3).alias("v"),
    )
    table = df.toPandas().dropna().sort_values(["day", "key", "v"])
    half = len(table) // 2
    row = pl.trend_component(df, ["day", "key"], "v", gather_limit=limit).first()
    assert row.first_mean == pytest.approx(table.v[:half].mean())
    assert row.second_mean == pytest.approx(table.v[half:].mean())
    gap = abs(table.v[:half].mean() - table.v[half:].mean())
    assert row.trend == (gap > 0.5 * table.v.std())


def test_trend_with_large_keys_and_dates(spark):
    df = spark.range(100).select(
        (F.lit(2**60) + F.col("id")).alias("big"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("day"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.col("id").cast("decimal(20,2)").alias("dec"),
        F.col("id").cast("double").alias("v"),
    )
    for key in ("big", "day", "ts", "dec", "v"):
        row = pl.trend_component(df.repartition(7), [key], "v").first()
        assert (row.first_mean, row.second_mean, row.trend) == (24.5, 74.5, True)
    with pytest.raises(ValueError):
        pl.trend_component(df.withColumn("s", F.lit("x")), ["s"], "v")


def test_components(spark):
    flat = spark.range(20).select(F.lit(1.0).alias("v"), F.col("id").alias("time"))
    row = pl.component_richness(flat, ["time"]).first()
    assert (row.trend, row.seasonal, row.irregular, row.component_richness) == (False, True, False, 25.0)
    short = spark.range(9).select(F.col("id").alias("time"))
    assert pl.component_richness(short, ["time"]).first().component_richness == 0.0


def test_feature_diversity(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "s string, t string")
    rows = {(r.column_name, r.value): r for r in pl.feature_diversity(df).collect()}
    assert rows["s", "a"].share == pytest.approx(2 / 3) and rows["t", "x"].share == 0.5
    assert {c for c, _ in rows} == {"s", "t"}
    assert {r.column_name for r in pl.feature_diversity(df, max_columns=1).collect()} == {"s"}


@pytest.mark.parametrize(
    ("period", "span"),
    [
        ("2018-2021", 3),
        ("2018 - 2021", 3),
        ("2020", 0),
        ("2018-01-2021-05", 3),
        ("unknown", None),
        ("n/a", None),
        ("", None),
        (None, None),
        ("about2018-2020", None),
    ],
)
def test_collection_span(spark, period, span):
    df = spark.createDataFrame([(period,)], "p string")
    assert df.select(pl.collection_span(F.col("p"))).first()[0] == span


@pytest.mark.parametrize(
    ("created", "updated", "age"),
    [
        ("2020", "2024-05-01", 2),
        ("2020", None, 6),
        ("2020", "", 6),
        ("2020", "soon", 6),
        ("2020", "unknown", 6),
        ("unknown", None, None),
        (None, "2025", 1),
    ],
)
def test_metadata_age(spark, created, updated, age):
    meta = pl.metadata_frame(spark, {"creation_date": created, "last_updated": updated})
    assert pl.metadata_age(meta, 2026).first().age_since_update_years == age


def test_bands(spark):
    df = spark.createDataFrame([(0,), (5,), (6,), (15,), (16,), (None,)], "a int")
    bands = [r[0] for r in df.select(pl.currentness_band(F.col("a"))).collect()]
    assert bands == [100.0, 100.0, 50.0, 50.0, 0.0, None]


def test_stale_rows_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(dt.date(2000, 1, 1),), (dt.date(2020, 1, 1),)], "d date").write.parquet(path)
    stale = pl.stale_rows(spark.read.parquet(path), "d", "2022-01-01", 5)
    assert [r.d.year for r in stale.collect()] == [2000]
    assert "LessThan(d,2017-01-01)" in stale._jdf.queryExecution().executedPlan().toString()


def evaluated(spark, **changes):
    df = spark.createDataFrame(
        [(i, float(i % 7), "ab"[i % 2], dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(50)],
        "k int, v double, label string, event_date date",
    )
    settings = dict(
        dataset_name="t",
        as_of_year=2024,
        syntactic_rules=[pl.SyntacticRule("v", "range", {"min": 0, "max": 5}, rule_id="v")],
        semantic_rules=[pl.SemanticRule("s", "cross_field", ("k", "v"), expression="k >= v")],
        order_by=["event_date"],
        event_time="event_date",
        metadata={"source_name": "x", "creation_date": "2021"},
    )
    return pl.evaluate(df, pl.EvaluationConfig(**(settings | changes)))


@pytest.fixture(scope="module")
def evaluation(spark):
    return evaluated(spark)


def test_every_dimension_is_there_once(evaluation):
    rows = evaluation.dimension_scores.collect()
    assert [r.dimension for r in rows] == [d for ds in DIMENSIONS.values() for d in ds]
    assert all(r.score is None or 0 <= r.score <= 100 for r in rows)
    assert all((r.passed is None) == (r.score is None) for r in rows)


def test_scores(evaluation):
    scores = {r.dimension: r.score for r in evaluation.dimension_scores.collect()}
    assert scores["syntactic_accuracy"] == pytest.approx(100 * (1 - 7 / 50))
    assert scores["semantic_accuracy"] == 100.0
    assert scores["data_accuracy_assurance"] == 25.0
    assert scores["relative_label_abundance"] == 100.0
    assert scores["component_richness"] == 75.0
    assert scores["source_credibility"] == pytest.approx(200 / 7)
    assert scores["feature_currentness"] == scores["record_currentness"] == 100.0
    for unset in ("data_model_accuracy", "label_richness", "value_credibility", "data_dictionary_credibility"):
        assert scores[unset] is None


def test_rollups(spark, evaluation):
    characteristics = pl.characteristic_scores(evaluation.dimension_scores)
    rows = {r.characteristic: r for r in characteristics.collect()}
    assert rows["currentness"].overall_score == 100.0 and rows["currentness"].priority == 2
    assert rows["currentness"].summary == "100.0% on average in currentness"
    weights = {c: 2 for c in rows}
    expected = sum(weights[c] * r.overall_score for c, r in rows.items()) / sum(weights.values())
    assert pl.overall_score(characteristics).first().overall_score == pytest.approx(expected)
    assert pl.score_matrix(evaluation.dimension_scores).count() == 6
    table = [r.characteristic for r in pl.score_table(characteristics).collect()]
    assert table == list(DIMENSIONS)


def test_zero_score_is_shown_and_none_is_not(spark):
    scores = spark.createDataFrame(
        [("accuracy", "a", 1, 1, 0.0, False), ("diversity", "b", 1, 2, None, None)],
        "characteristic string, dimension string, position int, priority int, score double, passed boolean",
    )
    rows = {r.characteristic: r for r in pl.score_table(pl.characteristic_scores(scores)).collect()}
    assert rows["accuracy"].score_text == "0.0%" and rows["diversity"].score_text == "N/A"
    assert rows["diversity"].summary == "No dimension could be scored."
    status = {r.dimension: r.status for r in pl.dimension_table(scores.withColumn("explanation", F.lit(""))).collect()}
    assert status == {"a": "FAIL", "b": "N/A"}


def test_formulas_thresholds_and_priorities_can_be_set(spark):
    df = spark.createDataFrame([(1,), (None,)], "v int")
    config = pl.EvaluationConfig(
        thresholds={"value_completeness": 40.0},
        priorities=pl.parse_priorities("accuracy=1, currentness = 3"),
        auto_priorities={"accuracy": 3, "diversity": 1},
    )
    e = pl.evaluate(df, config, overrides={"label_richness": F.lit(12.5)})
    rows = {r.dimension: r for r in e.dimension_scores.collect()}
    assert rows["value_completeness"].passed and not rows["record_completeness"].passed
    assert rows["label_richness"].score == 12.5
    priorities = {r.characteristic: (r.priority, r.origin) for r in pl.priority_table(spark, config).collect()}
    assert priorities["accuracy"] == (1, "user") and priorities["diversity"] == (1, "suggested")
    assert priorities["consistency"] == (2, "default")


def test_unknown_priority_warns():
    with pytest.warns(UserWarning):
        assert pl.parse_priorities("accuracy=1,beauty=2,diversity=x") == {"accuracy": 1}


def test_empty_table_can_be_evaluated(spark):
    df = spark.createDataFrame([], "k int, label string, day_date date")
    e = pl.evaluate(df, pl.EvaluationConfig(order_by=["k"], event_time="day_date", as_of_year=2024))
    scores = {r.dimension: r.score for r in e.dimension_scores.collect()}
    assert scores["value_completeness"] == 100.0 and scores["label_completeness"] is None
    assert pl.report_lines(e).count() > 30


def test_recommendations_and_clauses(evaluation):
    advice = pl.recommendations(evaluation).collect()
    assert {r.dimension for r in advice} == {
        r.dimension for r in evaluation.dimension_scores.filter("not passed").collect()
    }
    text = {r.dimension: r.recommendation for r in advice}["syntactic_accuracy"]
    assert "rule v on v" in text
    clauses = {r.clause: r.status for r in pl.compliance_matrix(evaluation).collect()}
    assert len(clauses) == 10
    assert clauses["Art. 10 free of errors"] == "gap" and clauses["Art. 17 erasure"] == "met"
    assert set(clauses.values()) <= {"met", "gap", "not_assessed"}


def test_report_has_all_sections_in_order(evaluation, spark, tmp_path):
    lines = pl.report_lines(evaluation)
    texts = [r.text for r in lines.collect()]
    heads = [t for t in texts if t.startswith("## ")]
    assert heads == [
        "## What was looked at",
        "## In one figure",
        "## Figures by characteristic, the most important first",
        "## What to mend",
        "## Clauses of the AI Act that the figures bear on",
        "## Clauses of the GDPR that the figures bear on",
    ]
    assert sum(t.startswith("### ") for t in texts) == 6 and sum(t.startswith("  * ") for t in texts) == 25
    path = str(tmp_path / "report")
    pl.write_report(lines, path)
    assert [r.value for r in spark.read.text(path).collect()] == texts


def test_completeness_of_a_wide_table(spark):
    df = spark.range(3).select(*[F.when(F.col("id") > 0, F.lit(i)).alias(f"c{i}") for i in range(600)])
    row = pl.completeness(df).first()
    assert (row.row_count, row.null_cells, row.complete_rows, row.complete_columns) == (3, 600, 2, 0)
