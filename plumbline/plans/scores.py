"""Dimension scores: the facts of a table, and a formula for each dimension.

The facts are gathered in few scans and amount to one row.  A formula is a
Column over that row, 0 to 100 or NULL where it does not apply; pass other
Columns to ``evaluate`` to override single formulas.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.columns import (
    datetime_columns,
    label_column,
    normalise_missing,
    numeric_columns,
    quoted,
    ref,
    string_columns,
)
from plumbline.functions.frames import local_frame, per_column, rate, run_together
from plumbline.operators.completeness import labelled
from plumbline.operators.consistency import distribution_stats, value_class_counts
from plumbline.operators.currentness import currentness_band, metadata_age
from plumbline.operators.diversity import component_richness
from plumbline.operators.frequency import label_distribution
from plumbline.operators.duplicates import duplicate_rows
from plumbline.operators.profile import iqr_outliers, redundancy_metrics
from plumbline.operators.rules import RULE_RESULTS, compile_all, count_isolated
from plumbline.operators.semantic import ROW_RULES, check_semantic_rules
from plumbline.plans.catalogue import DIMENSIONS
from plumbline.plans.config import EvaluationConfig
from plumbline.sources.readers import METADATA_KEYS, metadata_frame
from plumbline.sources.rules import SyntacticRule

SOURCE_KEYS = METADATA_KEYS[:7]

CONSISTENCY_RULES = ("cross_field", "temporal", "referential")
MODEL_RULES = ("dtype", "referential")

DIMENSION_SCORES = T.StructType(
    [
        T.StructField("characteristic", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Facts by name; counts are BIGINT, the rest DOUBLE.
COUNTS = (
    "row_count",
    "column_count",
    "null_cells",
    "complete_columns",
    "complete_rows",
    "covered_cells",
    "duplicate_rows",
    "mixed_columns",
    "numeric_cells",
    "outliers",
    "shaped_columns",
    "plain_columns",
    "dtype_rules",
    "dtype_passing",
    "model_rules",
    "model_passing",
    "has_label",
    "classes",
    "labels",
    "labelled_rows",
    "classes_below_half",
    "source_keys",
    "described_columns",
    "redundant_columns",
    "dated_rows",
    "outdated_rows",
    "age_since_update",
    "evaluable_rules",
)
MEASURES = (
    "syntactic_pass",
    "semantic_pass",
    "range_pass",
    "consistency_pass",
    "expected_pass",
    "min_abundance",
    "max_abundance",
    "covered_labels",
    "components",
    "mean_band",
)
FACTS = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)


@dataclass(frozen=True)
class Evaluation:
    """The small tables that an evaluation ends in.

    ``evidence`` holds (dimension, item, weight): what weighs on a dimension.
    """

    config: EvaluationConfig
    facts: DataFrame
    dimension_scores: DataFrame
    rule_results: DataFrame
    evidence: DataFrame


def _mean(values) -> float | None:
    values = list(values)
    return sum(values) / len(values) if values else None


def _scan_metrics(clean: DataFrame, config: EvaluationConfig, label: str | None) -> dict[str, Column]:
    """What one scan tells about whole rows, labels and ages."""
    filled = f"NOT array_contains(array({', '.join(f'{quoted(c)} IS NULL' for c in clean.columns)}), true)"
    metrics = {"row_count": F.count(F.lit(1)), "complete_rows": F.count_if(F.expr(filled if clean.columns else "true"))}
    if label is not None:
        metrics["labelled_rows"] = F.count_if(labelled(clean, label, config.unlabeled_values))
    if config.event_time is not None:
        band = currentness_band(
            F.lit(config.as_of_year) - F.year(ref(config.event_time)),
            config.short_years,
            config.long_years,
        )
        metrics |= {
            "dated_rows": F.count(band),
            "outdated_rows": F.count_if(band == 0.0),
            "mean_band": F.avg(band),
        }
    return metrics


def _label_facts(clean: DataFrame, label: str) -> dict:
    classes = label_distribution(clean, label)
    totals = classes.agg(F.sum("cnt").alias("labels"), F.count(F.lit(1)).alias("classes"))
    total = totals.select("labels").scalar()
    expected = totals.select(rate(F.col("labels"), F.col("classes"))).scalar()
    return (
        classes.agg(
            F.count(F.lit(1)).alias("classes"),
            F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("labels"),
            F.count_if(F.col("cnt") * 2 < total).alias("classes_below_half"),
            rate(F.min("cnt"), F.sum("cnt")).alias("min_abundance"),
            rate(F.max("cnt"), F.sum("cnt")).alias("max_abundance"),
            F.sum(F.least(F.col("cnt").cast("double"), expected)).alias("covered_labels"),
        )
        .first()
        .asDict()
    )


def gather(
    df: DataFrame, config: EvaluationConfig, tables: Mapping[str, DataFrame] | None = None
) -> tuple[dict, list[dict], list[dict]]:
    """The facts, the rule results and the evidence of a table."""
    spark = df.sparkSession
    clean = normalise_missing(df)
    label = label_column(df, config.label_col)
    expected = [
        SyntacticRule(
            r.column, "range", {"min": r.low, "max": r.high}, "expected range", "", f"expected:{i}"
        )
        for i, r in enumerate(config.expected_ranges, 1)
    ]
    row_rules = [r for r in config.semantic_rules if r.rule_type in ROW_RULES]
    other_rules = [r for r in config.semantic_rules if r.rule_type not in ROW_RULES]
    compiled = compile_all(clean, config.syntactic_rules, row_rules) + compile_all(clean, expected)

    numeric = numeric_columns(df)
    tasks = {
        "scan": lambda: clean.agg(*[m.alias(k) for k, m in _scan_metrics(clean, config, label).items()]).first().asDict(),
        "cells": lambda: per_column(clean, clean.columns, redundancy_metrics).collect() if clean.columns else [],
        "checked": lambda: count_isolated(clean, compiled),
        "duplicates": lambda: duplicate_rows(clean).first()["duplicate_rows"],
    }
    if numeric:
        tasks["outliers"] = lambda: iqr_outliers(clean, numeric).collect()
        tasks["shapes"] = lambda: distribution_stats(clean, numeric).collect()
    if string_columns(df):
        tasks["classes"] = lambda: value_class_counts(clean).collect()
    if other_rules:
        tasks["rules"] = lambda: check_semantic_rules(clean, other_rules, tables).collect()
    if label is not None:
        tasks["labels"] = lambda: _label_facts(clean, label)
    if config.order_by and datetime_columns(df, config.datetime_by):
        tasks["components"] = lambda: component_richness(
            clean, config.order_by, config.datetime_by
        ).first()
    done = run_together(spark, tasks)
    seen = done["scan"]
    rows = seen["row_count"]
    cells = {r.column_name: r for r in done["cells"]}
    nulls = {c: cells[c].null_count for c in clean.columns}
    results = done["checked"]
    is_expected = {f"expected:{i}" for i in range(1, len(expected) + 1)}
    expected_results = [r for r in results if r["rule_id"] in is_expected]
    results = [r for r in results if r["rule_id"] not in is_expected]
    results += [r.asDict() for r in done.get("rules", ())]
    semantic_types = {r.rule_type for r in config.semantic_rules}
    ran = [r for r in results if r["status"] == "ok"]
    syntactic = [r for r in ran if r["rule_type"] not in semantic_types]
    semantic = [r for r in ran if r["rule_type"] in semantic_types]

    outliers = {r.column_name: r.outlier_count for r in done.get("outliers", ())}
    shapes = done.get("shapes", ())
    shaped = [s for s in shapes if s.skewness is not None and s.kurtosis is not None]
    odd = [
        s
        for s in shaped
        if abs(s.skewness) > config.skewness_limit or abs(s.kurtosis) > config.kurtosis_limit
    ]
    classes: dict[str, int] = {}
    for r in done.get("classes", ()):
        classes[r.column_name] = classes.get(r.column_name, 0) + 1
    mixed = [c for c, n in classes.items() if n > 1]

    covered = dict.fromkeys(r["field"] for r in syntactic)
    dtype_rules = [r for r in ran if r["rule_type"] == "dtype"]
    model_rules = [r for r in ran if r["rule_type"] in MODEL_RULES]
    facts = {
        "row_count": rows,
        "column_count": len(df.columns),
        "null_cells": sum(nulls.values()),
        "complete_columns": sum(n == 0 for n in nulls.values()),
        "complete_rows": seen["complete_rows"],
        "covered_cells": sum(rows - nulls[c] for c in covered),
        "duplicate_rows": done["duplicates"],
        "mixed_columns": len(mixed),
        "numeric_cells": sum(rows - nulls[c] for c in numeric),
        "outliers": sum(outliers.values()),
        "shaped_columns": len(shaped),
        "plain_columns": len(shaped) - len(odd),
        "dtype_rules": len(dtype_rules),
        "dtype_passing": sum(r["violations"] == 0 for r in dtype_rules),
        "model_rules": len(model_rules),
        "model_passing": sum(r["violations"] == 0 for r in model_rules),
        "has_label": int(label is not None),
        "labelled_rows": seen.get("labelled_rows"),
        "source_keys": sum(bool(str(config.metadata.get(k) or "").strip()) for k in SOURCE_KEYS)
        if config.metadata
        else None,
        "described_columns": sum(bool(config.dictionary.get(c)) for c in df.columns)
        if config.dictionary
        else None,
        "redundant_columns": sum(
            nulls[c] == rows or (cells[c].constant and nulls[c] == 0)
            for i, c in enumerate(clean.columns)
        ),
        "dated_rows": seen.get("dated_rows"),
        "outdated_rows": seen.get("outdated_rows"),
        "mean_band": seen.get("mean_band"),
        "evaluable_rules": len(ran),
        "syntactic_pass": _mean(r["pass_rate"] for r in syntactic),
        "semantic_pass": _mean(r["pass_rate"] for r in semantic),
        "range_pass": _mean(r["pass_rate"] for r in syntactic if r["rule_type"] == "range"),
        "consistency_pass": _mean(
            r["pass_rate"] for r in semantic if r["rule_type"] in CONSISTENCY_RULES
        ),
        "expected_pass": _mean(r["pass_rate"] for r in expected_results if r["status"] == "ok"),
    }
    facts |= done.get("labels", {})
    if done.get("components") is not None:
        facts["components"] = done["components"]["component_richness"]
    if config.metadata and config.as_of_year is not None:
        age = metadata_age(metadata_frame(spark, config.metadata), config.as_of_year).first()
        facts["age_since_update"] = age["age_since_update_years"]

    evidence = [("value_completeness", f"column {c}", n) for c, n in nulls.items() if n]
    evidence += [("feature_completeness", f"column {c}", n) for c, n in nulls.items() if n]
    evidence += [("record_completeness", f"column {c}", n) for c, n in nulls.items() if n]
    evidence += [("risk_of_inaccuracy", f"column {c}", n) for c, n in outliers.items() if n]
    evidence += [("data_format_consistency", f"column {c}", classes[c]) for c in mixed]
    evidence += [
        ("distribution_of_data_values", f"column {s.column_name}", max(abs(s.skewness), abs(s.kurtosis)))
        for s in odd
    ]
    for r in ran:
        if r["violations"]:
            item = f"rule {r['rule_id']} on {r['field']}"
            named = []
            if r in syntactic:
                named.append("syntactic_accuracy")
                named += ["data_accuracy_range"] if r["rule_type"] == "range" else []
                named += ["data_model_accuracy"] if r["rule_type"] == "dtype" else []
            else:
                named.append("semantic_accuracy")
                named += ["semantic_consistency"] if r["rule_type"] in CONSISTENCY_RULES else []
            named += ["data_model_credibility"] if r["rule_type"] in MODEL_RULES else []
            evidence += [(d, item, r["violations"]) for d in named]
    return facts, results, [
        {"dimension": d, "item": i, "weight": float(w)} for d, i, w in evidence
    ]


def _percent(part: str, whole: str) -> Column:
    return 100 * rate(F.col(part), F.col(whole))


def formulas(config: EvaluationConfig) -> dict[str, Column]:
    """The score of each dimension over the facts."""
    empty = F.col("row_count") == 0
    whole = F.col("row_count") * F.col("column_count")
    age_band = currentness_band(F.col("age_since_update"), config.short_years, config.long_years)
    expected = F.lit(config.expected_classes).cast("double")
    return {
        "syntactic_accuracy": 100 * F.col("syntactic_pass"),
        "semantic_accuracy": 100 * F.col("semantic_pass"),
        "data_accuracy_assurance": 100 * rate(F.col("covered_cells"), whole),
        "risk_of_inaccuracy": 100 * (1 - rate(F.col("outliers"), F.col("numeric_cells"))),
        "data_accuracy_range": 100 * F.col("range_pass"),
        "data_model_accuracy": _percent("dtype_passing", "dtype_rules"),
        "value_completeness": F.coalesce(
            100 * (1 - rate(F.col("null_cells"), whole)), F.lit(100.0)
        ),
        "value_occurrence_completeness": _percent("covered_labels", "labels"),
        "feature_completeness": _percent("complete_columns", "column_count"),
        "record_completeness": F.when(empty, 100.0).otherwise(_percent("complete_rows", "row_count")),
        "label_completeness": _percent("labelled_rows", "row_count"),
        "data_record_consistency": F.when(empty, 100.0).otherwise(
            100 * (1 - rate(F.col("duplicate_rows"), F.col("row_count")))
        ),
        "distribution_of_data_values": _percent("plain_columns", "shaped_columns"),
        "data_format_consistency": 100 * (1 - rate(F.col("mixed_columns"), F.col("column_count"))),
        "semantic_consistency": 100 * F.col("consistency_pass"),
        "label_richness": F.when(
            F.col("has_label") == 1,
            100 * F.when(F.col("classes") >= expected, 1.0).otherwise(rate(F.col("classes"), expected)),
        ),
        "relative_label_abundance": _percent("min_abundance", "max_abundance"),
        "category_size_diversity": _percent("classes_below_half", "classes"),
        "component_richness": F.col("components"),
        "value_credibility": 100 * F.col("expected_pass"),
        "source_credibility": 100 * rate(F.col("source_keys"), F.lit(len(SOURCE_KEYS))),
        "data_dictionary_credibility": _percent("described_columns", "column_count"),
        "data_model_credibility": _percent("model_passing", "model_rules"),
        "feature_currentness": age_band,
        "record_currentness": F.coalesce(F.col("mean_band"), age_band),
    }


# The facts shown with each dimension, as explanation and as details.
SHOWN = {
    "syntactic_accuracy": ("syntactic_pass",),
    "semantic_accuracy": ("semantic_pass",),
    "data_accuracy_assurance": ("covered_cells",),
    "risk_of_inaccuracy": ("outliers", "numeric_cells"),
    "data_accuracy_range": ("range_pass",),
    "data_model_accuracy": ("dtype_passing", "dtype_rules"),
    "value_completeness": ("null_cells",),
    "value_occurrence_completeness": ("labels", "classes"),
    "feature_completeness": ("complete_columns", "column_count"),
    "record_completeness": ("complete_rows", "row_count"),
    "label_completeness": ("labelled_rows", "row_count"),
    "data_record_consistency": ("duplicate_rows", "row_count"),
    "distribution_of_data_values": ("plain_columns", "shaped_columns"),
    "data_format_consistency": ("mixed_columns", "column_count"),
    "semantic_consistency": ("consistency_pass",),
    "label_richness": ("classes",),
    "relative_label_abundance": ("min_abundance", "max_abundance"),
    "category_size_diversity": ("classes_below_half", "classes"),
    "component_richness": ("components",),
    "value_credibility": ("expected_pass",),
    "source_credibility": ("source_keys",),
    "data_dictionary_credibility": ("described_columns", "column_count"),
    "data_model_credibility": ("model_passing", "model_rules"),
    "feature_currentness": ("age_since_update",),
    "record_currentness": ("dated_rows", "outdated_rows", "age_since_update"),
}


def score_dimensions(
    facts: DataFrame, config: EvaluationConfig, overrides: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per dimension from the one row of facts."""
    chosen = formulas(config) | dict(overrides or {})
    rows = []
    for characteristic, dimensions in DIMENSIONS.items():
        for position, name in enumerate(dimensions, 1):
            score = chosen[name].cast("double")
            mark = float(config.thresholds.get(name, config.default_threshold))
            shown = [
                F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), F.col(f).cast("string")))
                for f in SHOWN[name]
            ]
            details = [x for f in SHOWN[name] for x in (F.lit(f), F.col(f).cast("string"))]
            rows.append(
                F.struct(
                    F.lit(characteristic).alias("characteristic"),
                    F.lit(name).alias("dimension"),
                    F.lit(position).alias("position"),
                    F.lit(config.priority(characteristic)).alias("priority"),
                    score.alias("score"),
                    (score >= mark).alias("passed"),
                    F.when(score.isNull(), F.lit("not assessed"))
                    .otherwise(F.array_join(F.array(*shown), ", "))
                    .alias("explanation"),
                    F.create_map(*details).alias("details"),
                )
            )
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def evaluate(
    df: DataFrame,
    config: EvaluationConfig,
    tables: Mapping[str, DataFrame] | None = None,
    overrides: Mapping[str, Column] | None = None,
) -> Evaluation:
    """Score a table on all dimensions.

    What comes back rests on driver-side tables of bounded size, one row per
    rule, column or dimension, so that rollups and reports do not read the data
    again.
    """
    spark = df.sparkSession
    facts, results, evidence = gather(df, config, tables)
    facts_frame = local_frame(spark, [facts], FACTS)
    return Evaluation(
        config=config,
        facts=facts_frame,
        dimension_scores=local_frame(
            spark,
            [r.asDict() for r in score_dimensions(facts_frame, config, overrides).collect()],
            DIMENSION_SCORES,
        ),
        rule_results=local_frame(spark, results, RULE_RESULTS),
        evidence=local_frame(
            spark,
            evidence,
            T.StructType(
                [
                    T.StructField("dimension", T.StringType()),
                    T.StructField("item", T.StringType()),
                    T.StructField("weight", T.DoubleType()),
                ]
            ),
        ),
    )
