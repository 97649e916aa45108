"""Data quality of tables and streams as Spark jobs."""

from plumbline.functions.columns import (
    datetime_columns,
    label_column,
    normalise_missing,
    numeric_columns,
    string_columns,
)
from plumbline.operators.completeness import (
    completeness,
    feature_completeness,
    label_completeness,
    record_completeness,
    value_completeness,
    value_occurrence_completeness,
)
from plumbline.operators.consistency import (
    distribution_stats,
    format_consistency,
    json_field_types,
    mixed_type_columns,
    record_consistency,
    value_class_counts,
)
from plumbline.operators.currentness import (
    collection_span,
    currentness_band,
    metadata_age,
    record_bands,
    stale_rows,
)
from plumbline.operators.diversity import (
    category_size_diversity,
    component_richness,
    feature_diversity,
    label_abundance,
    label_imbalance,
    label_richness,
    time_series_indicators,
    trend_component,
)
from plumbline.operators.frequency import (
    class_balance,
    label_distribution,
    top_values,
    unique_counts,
    value_frequency,
)
from plumbline.operators.profile import (
    column_profile,
    column_types,
    duplicate_rows,
    iqr_outliers,
    null_profile,
    numeric_profile,
    profile_lines,
    redundant_columns,
    sample_rows,
    table_profile,
    table_shape,
)
from plumbline.operators.quantiles import quantiles
from plumbline.operators.rules import check_rules, violating_rows
from plumbline.operators.semantic import (
    check_semantic_rules,
    referential_violating_rows,
    referential_violations,
    semantic_field_stats,
    temporal_violating_rows,
    temporal_violations,
    violating_semantic_rows,
)
from plumbline.operators.suggest import suggest_rules
from plumbline.operators.windowed import sliced_quality, windowed_quality
from plumbline.plans.catalogue import catalogue
from plumbline.plans.config import (
    EvaluationConfig,
    ExpectedRange,
    Subjects,
    UsageContext,
    parse_priorities,
)
from plumbline.plans.report import report_lines
from plumbline.plans.rollup import (
    characteristic_scores,
    check_requirements,
    compliance_matrix,
    dimension_table,
    nested_scores,
    overall_score,
    priority_table,
    recommendations,
    score_matrix,
    score_table,
)
from plumbline.plans.scores import Evaluation, evaluate
from plumbline.sources.readers import metadata_column, metadata_frame, read_table
from plumbline.sources.rules import (
    SemanticRule,
    SyntacticRule,
    approved_rules,
    semantic_rules,
    semantic_table,
    syntactic_rules,
    syntactic_table,
)
from plumbline.sources.writers import write_report, write_table
from plumbline.streaming.quality import stream_quality, write_closed_windows

__all__ = [name for name in dir() if not name.startswith("_")]
