"""Rule results per group or per time window, on tables and on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import normalise_missing, ref, require_columns
from plumbline.operators.rules import compile_all, result_rows, rule_metrics
from plumbline.sources.rules import SemanticRule, SyntacticRule


def sliced_quality(
    df: DataFrame,
    by: Sequence[str],
    rules: DataFrame | Sequence[SyntacticRule] = (),
    row_rules: Sequence[SemanticRule] = (),
) -> DataFrame:
    """Rule results per value of the given columns."""
    require_columns(df, by)
    clean = normalise_missing(df)
    compiled = compile_all(clean, rules, row_rules)
    metrics = [m.alias(k) for k, m in rule_metrics(compiled).items()]
    return result_rows(clean.groupBy(*[ref(c) for c in by]).agg(*metrics), compiled, by)


def windowed_quality(
    df: DataFrame,
    event_time: str,
    width: str = "1 day",
    rules: DataFrame | Sequence[SyntacticRule] = (),
    row_rules: Sequence[SemanticRule] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Rule results per tumbling window of event time, and per value of ``by``.

    The same plan serves a stream, given a watermark on ``event_time``.
    """
    require_columns(df, [event_time, *by])
    clean = normalise_missing(df)
    compiled = compile_all(clean, rules, row_rules)
    metrics = [m.alias(k) for k, m in rule_metrics(compiled).items()]
    counted = (
        clean.groupBy(F.window(ref(event_time), width).alias("w"), *[ref(c) for c in by])
        .agg(*metrics)
        .withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")})
    )
    return result_rows(counted, compiled, ["window_start", "window_end", *by])
