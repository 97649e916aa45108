"""From dimension scores to characteristics, an overall score, and clauses of law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbline.functions.frames import local_frame, number_text, rate
from plumbline.plans.catalogue import CHARACTERISTICS, MOST_DIMENSIONS
from plumbline.plans.config import DEFAULT_THRESHOLD, EvaluationConfig
from plumbline.plans.scores import Evaluation

# Weight of a priority in the overall score: 3 for the highest, 1 for the lowest.
LOWEST_PRIORITY = 3

# What each clause is judged by.
CLAUSES = {
    ("AI Act", "Art. 10 free of errors"): (
        "syntactic_accuracy",
        "semantic_accuracy",
        "risk_of_inaccuracy",
        "data_record_consistency",
    ),
    ("AI Act", "Art. 10 complete"): (
        "value_completeness",
        "value_occurrence_completeness",
        "feature_completeness",
        "record_completeness",
        "label_completeness",
    ),
    ("AI Act", "Art. 10 relevant"): ("data_model_accuracy", "feature_currentness"),
    ("AI Act", "Art. 10 sufficiently representative"): (
        "label_richness",
        "relative_label_abundance",
        "category_size_diversity",
        "value_occurrence_completeness",
    ),
    ("GDPR", "Art. 5(1)(c) data minimisation"): ("informative_columns",),
    ("GDPR", "Art. 5(1)(d) accuracy"): (
        "syntactic_accuracy",
        "semantic_accuracy",
        "record_currentness",
    ),
    ("GDPR", "Art. 5(1)(e) storage limitation"): ("record_currentness", "records_in_date"),
    ("GDPR", "Art. 5(1)(f) integrity"): ("data_record_consistency", "data_format_consistency"),
    ("GDPR", "Art. 16 rectification"): ("data_accuracy_assurance", "inaccurate_rows_identifiable"),
    ("GDPR", "Art. 17 erasure"): ("outdated_rows_identifiable",),
}


def priority_table(spark: SparkSession, config: EvaluationConfig) -> DataFrame:
    """The priority of each characteristic and where it comes from."""
    rows = [
        {
            "characteristic": c,
            "priority": config.priority(c),
            "origin": "user"
            if c in config.priorities
            else "suggested"
            if c in config.auto_priorities
            else "default",
        }
        for c in CHARACTERISTICS
    ]
    schema = T.StructType(
        [
            T.StructField("characteristic", T.StringType()),
            T.StructField("priority", T.IntegerType()),
            T.StructField("origin", T.StringType()),
        ]
    )
    return local_frame(spark, rows, schema)


def characteristic_scores(dimension_scores: DataFrame) -> DataFrame:
    """Plain mean of the scored dimensions; NULL where none is scored."""
    means = dimension_scores.groupBy("characteristic").agg(
        F.first("priority").alias("priority"),
        F.avg("score").alias("overall_score"),
        F.count("score").alias("dimensions_scored"),
    )
    summary = F.when(
        F.col("overall_score").isNotNull(),
        F.format_string("%.1f%% on average in %s", "overall_score", "characteristic"),
    ).otherwise(F.lit("No dimension could be scored."))
    return means.withColumn("summary", summary)


def overall_score(characteristics: DataFrame) -> DataFrame:
    """Mean of the characteristic scores, weighted by priority."""
    weight = F.when(
        F.col("overall_score").isNotNull(), F.lit(LOWEST_PRIORITY + 1) - F.col("priority")
    )
    return characteristics.agg(
        rate(F.sum(weight * F.col("overall_score")), F.sum(weight)).alias("overall_score"),
        F.count("overall_score").alias("characteristics_scored"),
    )


def check_requirements(
    dimension_scores: DataFrame, requirements: DataFrame, default_threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Judge scores by a requirement table (dimension, pass_threshold, priority).

    Dimensions without a requirement keep their priority and get the default mark.
    """
    stated = requirements.select(
        "dimension", "pass_threshold", F.col("priority").alias("required_priority")
    )
    mark = F.coalesce("pass_threshold", F.lit(default_threshold))
    return dimension_scores.join(stated, "dimension", "left").select(
        "characteristic",
        "dimension",
        "position",
        F.coalesce("required_priority", "priority").cast("int").alias("priority"),
        "score",
        mark.alias("pass_threshold"),
        (F.col("score") >= mark).alias("passed"),
    )


def nested_scores(dimension_scores: DataFrame) -> DataFrame:
    """One row per characteristic with its dimensions as an ordered array, for JSON sinks."""
    dimension = F.struct("position", "dimension", "score", "passed")
    return dimension_scores.groupBy("characteristic", "priority").agg(
        F.avg("score").alias("overall_score"),
        F.array_sort(F.collect_list(dimension)).alias("dimensions"),
    )


def _catalogue_order(column: str) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CHARACTERISTICS]), F.col(column)).cast("int")


def score_table(characteristics: DataFrame) -> DataFrame:
    """Characteristics by priority with displayable scores."""
    return (
        characteristics.withColumn("position", _catalogue_order("characteristic"))
        .select(
            "characteristic",
            "position",
            "priority",
            number_text("%.1f%%", F.col("overall_score")).alias("score_text"),
            "summary",
        )
        .orderBy("priority", "position")
    )


def dimension_table(dimension_scores: DataFrame) -> DataFrame:
    """Dimensions by priority with displayable scores and status."""
    status = (
        F.when(F.col("passed"), F.lit("PASS")).when(~F.col("passed"), F.lit("FAIL")).otherwise(F.lit("N/A"))
    )
    return (
        dimension_scores.withColumn("rank", _catalogue_order("characteristic"))
        .orderBy("priority", "rank", "position")
        .select(
            "characteristic",
            "priority",
            "dimension",
            "position",
            number_text("%.1f%%", F.col("score")).alias("score_text"),
            status.alias("status"),
            "explanation",
        )
    )


def score_matrix(dimension_scores: DataFrame) -> DataFrame:
    """Characteristics as rows, dimension positions as columns."""
    positions = list(range(1, MOST_DIMENSIONS + 1))
    return (
        dimension_scores.groupBy("characteristic")
        .pivot("position", positions)
        .agg(F.first("score"))
        .select("characteristic", *[F.col(f"`{p}`").alias(f"d{p}") for p in positions])
    )


def recommendations(evaluation: Evaluation, worst: int = 3) -> DataFrame:
    """One line per failed dimension, by priority, with what weighs most on it."""
    ranked = Window.partitionBy("dimension").orderBy(F.col("weight").desc(), "item")
    causes = (
        evaluation.evidence.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= worst)
        .groupBy("dimension")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s.item), "; "
            ).alias("causes")
        )
    )
    text = F.concat(
        F.lit("Raise "),
        F.replace("dimension", F.lit("_"), F.lit(" ")),
        F.lit(" from "),
        number_text("%.1f%%", F.col("score")),
        F.coalesce(F.concat(F.lit("; start with "), F.col("causes")), F.lit("")),
    )
    return (
        evaluation.dimension_scores.filter(~F.col("passed"))
        .join(causes, "dimension", "left")
        .select("priority", "characteristic", "dimension", "position", "score", "causes", text.alias("recommendation"))
        .orderBy("priority", _catalogue_order("characteristic"), "position")
    )


def indicators(evaluation: Evaluation) -> DataFrame:
    """Dimension scores and the further indicators that clauses refer to."""
    mark = evaluation.config.default_threshold
    further = {
        "informative_columns": 100 * (1 - rate(F.col("redundant_columns"), F.col("column_count"))),
        "records_in_date": 100 * (1 - rate(F.col("outdated_rows"), F.col("dated_rows"))),
        "inaccurate_rows_identifiable": F.when(F.col("evaluable_rules") > 0, 100.0),
        "outdated_rows_identifiable": F.when(F.col("dated_rows") > 0, 100.0),
    }
    rows = [
        F.struct(F.lit(k).alias("indicator"), v.alias("score"), (v >= mark).alias("passed"))
        for k, v in further.items()
    ]
    return evaluation.dimension_scores.select(
        F.col("dimension").alias("indicator"), "score", "passed"
    ).unionByName(evaluation.facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))


def compliance_matrix(evaluation: Evaluation) -> DataFrame:
    """The weakest indicator per clause.  An aid to review, not legal advice."""
    rows = [
        {"regulation": r, "clause": c, "indicator": i}
        for (r, c), inputs in CLAUSES.items()
        for i in inputs
    ]
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("regulation", "clause", "indicator")]
    )
    clauses = local_frame(evaluation.facts.sparkSession, rows, schema)
    status = (
        F.when(F.col("score").isNull(), F.lit("not_assessed"))
        .when(F.col("met"), F.lit("met"))
        .otherwise(F.lit("gap"))
    )
    return (
        clauses.join(indicators(evaluation), "indicator")
        .groupBy("regulation", "clause")
        .agg(F.min("score").alias("score"), F.bool_and("passed").alias("met"))
        .select("regulation", "clause", "score", status.alias("status"))
    )
