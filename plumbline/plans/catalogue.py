"""The quality characteristics and their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from plumbline.functions.frames import local_frame

# The dimensions of each characteristic in ISO/IEC 5259, in order.
DIMENSIONS = {
    "accuracy": (
        "syntactic_accuracy",
        "semantic_accuracy",
        "data_accuracy_assurance",
        "risk_of_inaccuracy",
        "data_accuracy_range",
        "data_model_accuracy",
    ),
    "completeness": (
        "value_completeness",
        "value_occurrence_completeness",
        "feature_completeness",
        "record_completeness",
        "label_completeness",
    ),
    "consistency": (
        "data_record_consistency",
        "distribution_of_data_values",
        "data_format_consistency",
        "semantic_consistency",
    ),
    "diversity": (
        "label_richness",
        "relative_label_abundance",
        "category_size_diversity",
        "component_richness",
    ),
    "credibility": (
        "value_credibility",
        "source_credibility",
        "data_dictionary_credibility",
        "data_model_credibility",
    ),
    "currentness": (
        "feature_currentness",
        "record_currentness",
    ),
}

CHARACTERISTICS = tuple(DIMENSIONS)
MOST_DIMENSIONS = max(len(d) for d in DIMENSIONS.values())


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [
        {"characteristic": c, "dimension": d, "position": i}
        for c, dimensions in DIMENSIONS.items()
        for i, d in enumerate(dimensions, 1)
    ]
    schema = T.StructType(
        [
            T.StructField("characteristic", T.StringType()),
            T.StructField("dimension", T.StringType()),
            T.StructField("position", T.IntegerType()),
        ]
    )
    return local_frame(spark, rows, schema)
