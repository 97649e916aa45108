"""Rule checks: limits are counted as data in one scan; patterns and expressions become Columns.

Choices on the meaning of the rules:

* NULL and NaN values are left out of every check but not_null, which counts them.
* Rates are over all rows, so a rule's pass rate includes rows it did not see.
* Each rule has its own id; two rules of one type on one field both report.
* A rule that cannot be run says so in ``status`` and has NULL metrics.
* A range or enum value of the wrong JSON class for the column is no match, as
  are ``1`` and ``"1"``; text bounds on a numeric column are a type mismatch.
* format is anchored at the start of the text only.
* dtype is about the column: one value that cannot be cast makes every non-null
  row a violation; ``failed_values`` has the number of such values.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from plumbline.functions.columns import (
    TEMPORAL_TYPES,
    chunks,
    dtype_of,
    normalise_missing,
    ref,
)
from plumbline.functions.frames import local_frame, rate
from plumbline.functions.parsing import parse
from plumbline.operators.rule_data import (
    ROWS,
    Limits,
    as_data,
    count_broken,
    listed_limits,
    number_literal,
    real_limits,
    slot_of,
    whole_limits,
)
from plumbline.sources.rules import (
    SemanticRule,
    SyntacticRule,
    semantic_rules,
    syntactic_rules,
)

RULE_RESULTS = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("failed_values", T.LongType()),
        T.StructField("violations", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("violation_rate", T.DoubleType()),
        T.StructField("pass_rate", T.DoubleType()),
        T.StructField("description", T.StringType()),
    ]
)

# Type names of dtype rules and their Spark types.
TYPE_NAMES = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "int": "bigint",
    "integer": "bigint",
    "float32": "float",
    "float64": "double",
    "float": "double",
    "object": "string",
    "str": "string",
    "string": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "datetime64[ns]": "timestamp",
    "datetime64": "timestamp",
    "datetime": "timestamp",
}

# A column beside those of a table, for its rows as they are stored.
STORED = "__stored_row__"

# A character that is in no rule id.
ID_SEPARATOR = "\u0001"

# Conditions are counted together up to this number; more of them outgrow what the
# JVM compiles as one method.  Up to it, they are faster than limits as data.
CONDITIONS_PER_SCAN = 64


@dataclass(frozen=True)
class CompiledRule:
    rule_id: str
    field: str
    rule_type: str
    description: str
    status: str
    condition: Column | None = None
    # Only for dtype: a single failure taints all of these rows.
    tainted: Column | None = None
    # A rule on single values, where their type allows it, in place of a condition.
    limits: Limits | None = None

    @cached_property
    def failed(self) -> Column | None:
        """True for rows that break the rule; None for a rule that cannot run."""
        return self.condition if self.limits is None else self.limits.broken(ref(self.field))

    @property
    def runnable(self) -> bool:
        return self.condition is not None or self.limits is not None


class NotRunnable(Exception):
    """Carries the status of a rule that cannot be compiled."""


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _as_literal(value, dtype: T.DataType) -> Column | None:
    """The rule value as a literal comparable with the column, None if it has the wrong class."""
    if isinstance(dtype, T.NumericType) and _number(value):
        return number_literal(value)
    if isinstance(dtype, T.StringType) and isinstance(value, str):
        return F.lit(value)
    if isinstance(dtype, T.BooleanType) and isinstance(value, bool):
        return F.lit(value)
    if isinstance(dtype, TEMPORAL_TYPES) and isinstance(value, str):
        try:
            dt.datetime.fromisoformat(value)
        except ValueError:
            return None
        # Python reads more spellings of ISO dates than a cast does.
        if not _EXTENDED_ISO.fullmatch(value):
            return None
        return F.lit(value).cast(dtype)
    return None


_EXTENDED_ISO = re.compile(r"\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-]\d\d:\d\d)?)?")


def _bounds(spec) -> tuple:
    if not isinstance(spec, Mapping):
        raise NotRunnable("invalid_specification")
    return spec.get("min"), spec.get("max")


def _range(value: Column, dtype: T.DataType, spec) -> Column | Limits:
    low, high = _bounds(spec)
    literals = [None if b is None else _as_literal(b, dtype) for b in (low, high)]
    if any(b is not None and x is None for b, x in zip((low, high), literals)):
        raise NotRunnable("type_mismatch")
    slot = slot_of(dtype)
    if slot == "whole":
        return whole_limits(slot, low, high)
    if slot == "real":
        return real_limits(low, high)
    if slot == "text":
        return Limits(slot, low, high)
    outside = (Column.__lt__, Column.__gt__)
    return reduce(or_, [test(value, x) for test, x in zip(outside, literals) if x is not None], F.lit(False))


def _enum(value: Column, dtype: T.DataType, spec) -> Column | Limits:
    if not isinstance(spec, (list, tuple, set, frozenset)):
        raise NotRunnable("invalid_specification")
    known = [(v, x) for v, x in ((v, _as_literal(v, dtype)) for v in spec) if x is not None]
    slot = slot_of(dtype)
    if slot is not None:
        return listed_limits(slot, [v for v, _ in known])
    return ~value.isin([x for _, x in known]) if known else value.isNotNull()


def java_pattern(pattern: str) -> str:
    """A Python regular expression in Java syntax, anchored at the start.

    Group names lose characters that Java does not allow, and the classes for
    digits, words and spaces are switched to Unicode as they are in Python.
    """
    try:
        names = list(re.compile(pattern).groupindex)
    except re.error as e:
        raise NotRunnable("invalid_pattern") from e
    for i, name in enumerate(names):
        pattern = pattern.replace(f"(?P<{name}>", f"(?<g{i}>").replace(f"(?P={name})", f"\\k<g{i}>")
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)
    # Only a line feed ends a line, as in Python.
    unicode_classes = "(?dU)" if re.search(r"\\[dDwWsSbB]", pattern) else "(?d)"
    return f"{unicode_classes}\\A(?:{pattern})"


def _runs_in_java(df: DataFrame, pattern: str) -> bool:
    """Spark folds this to a constant when it plans the query, which compiles the pattern."""
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(pattern)).first()
    except Exception as e:  # noqa: BLE001 - the error class differs by planner stage
        if "pattern" in str(e).lower() or "regex" in str(e).lower():
            return False
        raise
    return True


# What Python and Java read alike; other patterns are tried out first.
_PLAIN_PATTERN = re.compile(r"(?:[\w\s\-:./,@#%&=!<>'\"^$|]|\\[dwsDWS.\-]|\[[\w\-]*\]|[.()?*+]|\{\d+(?:,\d*)?\})*")


def _format(df: DataFrame, value: Column, spec) -> Column:
    if not isinstance(spec, str):
        raise NotRunnable("invalid_specification")
    pattern = java_pattern(spec)
    if not (_PLAIN_PATTERN.fullmatch(spec) and "(?" not in spec) and not _runs_in_java(df, pattern):
        raise NotRunnable("invalid_pattern")
    return ~value.cast("string").rlike(pattern)


def _length(spec) -> Limits:
    low, high = _bounds(spec)
    if any(b is not None and not _number(b) for b in (low, high)):
        raise NotRunnable("invalid_specification")
    return whole_limits("length", low, high)


def _dtype(df: DataFrame, value: Column, dtype: T.DataType, spec) -> Column:
    target = TYPE_NAMES.get(spec) if isinstance(spec, str) else None
    if target is None:
        raise NotRunnable("unsupported_rule")
    if dtype.simpleString() == target or target == "string":
        return F.lit(False)
    cast = parse(value, dtype, target)
    try:
        df.select(cast).schema  # noqa: B018
    except AnalysisException:
        # No value of this type can be cast, an array to a number for one.
        return value.isNotNull()
    return value.isNotNull() & cast.isNull()


def compile_rule(df: DataFrame, rule: SyntacticRule, rule_id: str) -> CompiledRule:
    """A rule as limits of its field, or as a Column that is true for rows that break it."""

    def compiled(status: str, failed: Column | Limits | None = None, tainted: Column | None = None):
        condition, limits = (None, failed) if isinstance(failed, Limits) else (failed, None)
        return CompiledRule(
            rule_id, rule.field, rule.rule_type, rule.description, status, condition, tainted, limits
        )

    if rule.field not in df.columns:
        return compiled("column_missing")
    value, dtype, spec = ref(rule.field), dtype_of(df, rule.field), rule.specification
    try:
        if rule.rule_type == "range":
            return compiled("ok", _range(value, dtype, spec))
        if rule.rule_type == "enum":
            return compiled("ok", _enum(value, dtype, spec))
        if rule.rule_type == "format":
            return compiled("ok", _format(df, value, spec))
        if rule.rule_type == "length":
            return compiled("ok", _length(spec))
        if rule.rule_type == "dtype":
            return compiled("ok", _dtype(df, value, dtype, spec), value.isNotNull())
        if rule.rule_type == "not_null":
            return compiled("ok", Limits("missing"))
    except NotRunnable as e:
        return compiled(str(e))
    return compiled("unsupported_rule")


def compile_row_rule(df: DataFrame, rule: SemanticRule, rule_id: str) -> CompiledRule:
    """A cross_field or domain_logic rule; a NULL outcome is not evaluated.

    An expression that raises on a value has the status ``raised`` in a check; it
    should convert text by ``try_cast`` and divide by ``try_divide``.
    """
    field = ",".join(rule.fields_involved)

    def compiled(status: str, failed: Column | None = None):
        return CompiledRule(rule_id, field, rule.rule_type, rule.description, status, failed)

    if any(f not in df.columns for f in rule.fields_involved):
        return compiled("column_missing")
    if not rule.expression:
        return compiled("unsupported_rule")
    failed = ~F.expr(rule.expression)
    if rule.condition:
        failed = F.expr(rule.condition) & failed
    try:
        outcome = df.select(failed.alias("x")).schema["x"].dataType
    except Exception as e:  # noqa: BLE001 - parser and analyser errors alike
        if "ParseException" in type(e).__name__ or isinstance(e, AnalysisException):
            return compiled("invalid_expression")
        raise
    if not isinstance(outcome, T.BooleanType):
        return compiled("invalid_expression")
    return compiled("ok", failed)


def as_syntactic(rules: DataFrame | Sequence[SyntacticRule]) -> list[SyntacticRule]:
    return syntactic_rules(rules) if isinstance(rules, DataFrame) else list(rules)


def as_semantic(rules: DataFrame | Sequence[SemanticRule]) -> list[SemanticRule]:
    return semantic_rules(rules) if isinstance(rules, DataFrame) else list(rules)


def rule_ids(rules: Sequence, prefix: str) -> list[str]:
    """The given ids, and positional ones where none is given."""
    ids = [r.rule_id or f"{prefix}{i}" for i, r in enumerate(rules, 1)]
    if len(set(ids)) != len(ids):
        raise ValueError("rule ids must be unique")
    return ids


def compile_all(
    df: DataFrame,
    rules: DataFrame | Sequence[SyntacticRule] = (),
    row_rules: Sequence[SemanticRule] = (),
) -> list[CompiledRule]:
    """``df`` must have its missing values normalised."""
    listed = as_syntactic(rules)
    return [
        compile_rule(df, r, i) for r, i in zip(listed, rule_ids(listed, "R"), strict=True)
    ] + [
        compile_row_rule(df, r, i) for r, i in zip(row_rules, rule_ids(row_rules, "S"), strict=True)
    ]


def rule_metrics(compiled: Sequence[CompiledRule]) -> dict[str, Column]:
    """The aggregates of all runnable rules, to be fused with others into one scan."""
    metrics = {"row_count": F.count(F.lit(1))}
    for i, c in enumerate(compiled):
        if c.failed is not None:
            metrics[f"failed_{i}"] = F.count_if(c.failed)
        if c.tainted is not None:
            metrics[f"tainted_{i}"] = F.count_if(c.tainted)
    return metrics


def result_rows(
    counted: DataFrame, compiled: Sequence[CompiledRule], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per rule from each row of a frame of ``rule_metrics``.

    ``keep`` names grouping columns to carry along.
    """
    null = F.lit(None).cast("bigint")
    rows = []
    for i, c in enumerate(compiled):
        failed = violations = total = null
        if c.failed is not None:
            failed = violations = F.col(f"failed_{i}")
            total = F.col("row_count")
        if c.tainted is not None:
            violations = F.when(failed > 0, F.col(f"tainted_{i}")).otherwise(
                F.lit(0).cast("bigint")
            )
        rows.append(
            F.struct(
                F.lit(c.rule_id).alias("rule_id"),
                F.lit(c.field).alias("field"),
                F.lit(c.rule_type).alias("rule_type"),
                F.lit(c.status).alias("status"),
                failed.alias("failed_values"),
                violations.alias("violations"),
                total.alias("total"),
                F.lit(c.description).alias("description"),
            )
        )
    kept = [ref(c) for c in keep]
    exploded = counted.select(*kept, F.explode(F.array(*rows)).alias("r"))
    return with_rates(exploded.select(*kept, "r.*"), keep)


def with_rates(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Adds the violation and pass rates; on no rows every rule passes."""
    ran = F.col("violations").isNotNull()
    broken = F.when(
        ran, F.coalesce(rate(F.col("violations"), F.col("total")), F.lit(0.0))
    )
    return results.withColumns({"violation_rate": broken, "pass_rate": 1 - broken}).select(
        *[ref(c) for c in keep], *RULE_RESULTS.fieldNames()
    )


_RULE = "array<struct<number:int,tainted:int,rule_id:string,field:string,rule_type:string,status:string,description:string>>"


def count_rules(clean: DataFrame, compiled: Sequence[CompiledRule]) -> DataFrame:
    """Count all compiled rules over the table, in their order.

    A small set of rules is one aggregate of conditions.  In a larger one, rules with
    limits share one scan as data, whatever their number; conditions are counted in it
    as well, those beyond CONDITIONS_PER_SCAN in scans of their own.
    """
    if not compiled:
        return local_frame(clean.sparkSession, [], RULE_RESULTS)
    if len(compiled) <= CONDITIONS_PER_SCAN:
        return result_rows(clean.agg(*[m.alias(k) for k, m in rule_metrics(compiled).items()]), compiled)
    limits = [(i, c.field, c.limits) for i, c in enumerate(compiled) if as_data(c.limits)]
    conditions = [(i, c.failed) for i, c in enumerate(compiled) if c.runnable and not as_data(c.limits)]
    # The rows that a failure taints are counted as a rule of their own.
    tainted = {i: len(compiled) + i for i, c in enumerate(compiled) if c.tainted is not None}
    conditions += [(number, compiled[i].tainted) for i, number in tainted.items()]
    groups = chunks(conditions, CONDITIONS_PER_SCAN) or [[]]
    counted = count_broken(clean, limits, groups[0])
    for group in groups[1:]:
        more = count_broken(clean, [], group).select(F.map_filter("counts", lambda k, _: k != ROWS).alias("more"))
        counted = counted.withColumn("counts", F.map_concat("counts", more.select("more").scalar()))
    listed = [
        {
            "number": i if c.runnable else None,
            "tainted": tainted.get(i),
            "rule_id": c.rule_id,
            "field": c.field,
            "rule_type": c.rule_type,
            "status": c.status,
            "description": c.description,
        }
        for i, c in enumerate(compiled)
    ]
    rules = F.from_json(F.lit(json.dumps(listed)), _RULE)
    rows = counted.select("counts", F.inline(rules))

    def count_of(number: str) -> Column:
        return F.when(F.col(number).isNotNull(), F.coalesce(F.try_element_at("counts", F.col(number)), F.lit(0)))

    found = rows.withColumns(
        {
            "failed_values": count_of("number"),
            "total": F.when(F.col("number").isNotNull(), F.coalesce(F.try_element_at("counts", F.lit(ROWS)), F.lit(0))),
        }
    )
    violations = (
        F.when(F.col("tainted").isNull(), F.col("failed_values"))
        .when(F.col("failed_values") > 0, count_of("tainted"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    return with_rates(found.withColumn("violations", violations))


def count_isolated(clean: DataFrame, compiled: Sequence[CompiledRule]) -> list[dict]:
    """The rows of ``count_rules``; a rule that raises on a value has the status ``raised``, the others their counts.

    All rules are counted in one scan.  Only if that raises, halves are counted by
    themselves, down to the rule that does.
    """
    try:
        return [r.asDict() for r in count_rules(clean, compiled).collect()]
    except PySparkException as e:
        # Errors on values have a condition; the loss of a job has none.
        if not compiled or e.getCondition() is None:
            raise
    if len(compiled) == 1:
        raised = replace(compiled[0], status="raised", condition=None, tainted=None, limits=None)
        return [r.asDict() for r in count_rules(clean, [raised]).collect()]
    middle = len(compiled) // 2
    return count_isolated(clean, compiled[:middle]) + count_isolated(clean, compiled[middle:])


def check_rules(df: DataFrame, rules: DataFrame | Sequence[SyntacticRule]) -> DataFrame:
    """Violations of syntactic rules, one row per rule."""
    clean = normalise_missing(df)
    return count_rules(clean, compile_all(clean, rules))


def not_runnable(compiled: Sequence[CompiledRule]) -> None:
    """Raises for rules that cannot run, whose rows would be missing without a word."""
    idle = [f"{c.rule_id} ({c.status})" for c in compiled if not c.runnable]
    if idle:
        raise ValueError(f"rules that cannot run: {', '.join(idle)}")


def violating_rows(
    df: DataFrame,
    rules: DataFrame | Sequence[SyntacticRule] = (),
    row_rules: Sequence[SemanticRule] = (),
    skip_idle: bool = False,
) -> DataFrame:
    """Rows that break a rule, as stored, with the ids of the rules they break.

    For dtype these are the rows whose value cannot be cast.  A rule that cannot
    run raises, or is left out with ``skip_idle``.  Temporal and referential
    rules are for ``semantic.violating_semantic_rows``.
    """
    clean = normalise_missing(df)
    compiled = compile_all(clean, rules, row_rules)
    if not skip_idle:
        not_runnable(compiled)
    runnable = [c for c in compiled if c.runnable]
    # Joining and splitting text skips NULLs in generated code, which array functions do not.
    ids = [F.when(c.failed, F.lit(c.rule_id)) for c in runnable]
    listed = F.split(F.concat_ws(ID_SEPARATOR, *ids), ID_SEPARATOR)
    if clean is df:
        return df.filter(reduce(or_, [c.failed for c in runnable], F.lit(False))).withColumn(
            "violated_rules", listed
        )
    # Conditions see NULL for NaN; the rows that come back keep their NaN.
    both = normalise_missing(df.withColumn(STORED, F.struct(*[ref(c) for c in df.columns])))
    broken = both.filter(reduce(or_, [c.failed for c in runnable], F.lit(False)))
    return broken.select(
        *[F.col(STORED).getField(c).alias(c) for c in df.columns], listed.alias("violated_rules")
    )
