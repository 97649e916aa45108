"""Rules as data: dataclasses, and the table form in which people review them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.frames import local_frame

# The kinds of rules.
SYNTACTIC_TYPES = ("range", "enum", "format", "dtype", "length", "not_null")
SEMANTIC_TYPES = ("cross_field", "domain_logic", "temporal", "referential")

# Rule types whose specification is plain text even where it parses as JSON.
TEXT_SPECIFICATIONS = ("format", "dtype")

# Rules are written or approved by people and compiled on the driver.
MAX_RULES = 10_000


@dataclass(frozen=True)
class SyntacticRule:
    """A rule on the form of one field.

    Specification by type: range and length {"min", "max"}, enum a list, format
    a regular expression, dtype a type name, not_null true.
    """

    field: str
    rule_type: str
    specification: Any = None
    description: str = ""
    standard_reference: str = ""
    rule_id: str = ""


@dataclass(frozen=True)
class SemanticRule:
    """A rule on meaning.

    cross_field and domain_logic state ``expression``, a boolean SQL expression
    over one row, checked only where ``condition`` holds if one is given.
    temporal orders rows by ``order_columns`` within ``key_columns`` and expects
    the first involved field not to decrease.  referential expects the involved
    fields to occur as ``ref_columns`` of ``ref_table``.
    """

    name: str
    rule_type: str
    fields_involved: tuple[str, ...] = ()
    description: str = ""
    standard_reference: str = ""
    rule_id: str = ""
    expression: str | None = None
    condition: str | None = None
    key_columns: tuple[str, ...] = ()
    order_columns: tuple[str, ...] = ()
    ref_table: str | None = None
    ref_columns: tuple[str, ...] = ()


SYNTACTIC_TABLE = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("specification", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("standard_reference", T.StringType()),
        T.StructField("approved", T.BooleanType()),
    ]
)

_LISTS = ("fields_involved", "key_columns", "order_columns", "ref_columns")

SEMANTIC_TABLE = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("fields_involved", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("standard_reference", T.StringType()),
        T.StructField("expression", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("key_columns", T.ArrayType(T.StringType())),
        T.StructField("order_columns", T.ArrayType(T.StringType())),
        T.StructField("ref_table", T.StringType()),
        T.StructField("ref_columns", T.ArrayType(T.StringType())),
        T.StructField("approved", T.BooleanType()),
    ]
)


def approved_rules(rules: DataFrame) -> DataFrame:
    """Drop rules without a field or name, and those a reviewer did not approve."""
    subject = "field" if "field" in rules.columns else "name"
    kept = rules.filter(F.trim(F.coalesce(subject, F.lit(""))) != "")
    return kept.filter("approved") if "approved" in rules.columns else kept


def _collect(rules: DataFrame) -> list:
    rows = approved_rules(rules).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; is this a rule table?")
    return rows


def _decode(rule_type: str, text: str | None) -> Any:
    if text is None or rule_type in TEXT_SPECIFICATIONS:
        return text
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def syntactic_rules(rules: DataFrame) -> list[SyntacticRule]:
    """Rule objects from a rule table.

    The specification is decoded by rule type: a format of ``123`` stays text.
    """
    return [
        SyntacticRule(
            field=r["field"].strip(),
            rule_type=r["rule_type"],
            specification=_decode(r["rule_type"], r["specification"]),
            description=r.get("description") or "",
            standard_reference=r.get("standard_reference") or "",
            rule_id=r.get("rule_id") or "",
        )
        for r in (row.asDict() for row in _collect(rules))
    ]


def semantic_rules(rules: DataFrame) -> list[SemanticRule]:
    """Rule objects from a rule table; lists may be arrays or comma-separated text."""
    ready = rules
    for name in _LISTS:
        if name in rules.columns and isinstance(rules.schema[name].dataType, T.StringType):
            trimmed = F.transform(F.split(F.col(name), ","), lambda p: F.trim(p))
            ready = ready.withColumn(name, F.filter(trimmed, lambda p: p != ""))
    made = []
    for row in _collect(ready):
        r = row.asDict()
        made.append(
            SemanticRule(
                name=r["name"],
                rule_type=r.get("rule_type") or "domain_logic",
                description=r.get("description") or "",
                standard_reference=r.get("standard_reference") or "",
                rule_id=r.get("rule_id") or "",
                expression=r.get("expression"),
                condition=r.get("condition"),
                ref_table=r.get("ref_table"),
                **{name: tuple(r.get(name) or ()) for name in _LISTS},
            )
        )
    return made


def syntactic_table(
    spark: SparkSession, rules: Sequence[SyntacticRule], approved: bool = True
) -> DataFrame:
    rows = [
        {
            "rule_id": r.rule_id or None,
            "field": r.field,
            "rule_type": r.rule_type,
            "specification": r.specification
            if isinstance(r.specification, str) and r.rule_type in TEXT_SPECIFICATIONS
            else json.dumps(r.specification),
            "description": r.description,
            "standard_reference": r.standard_reference,
            "approved": approved,
        }
        for r in rules
    ]
    return local_frame(spark, rows, SYNTACTIC_TABLE)


def semantic_table(
    spark: SparkSession, rules: Sequence[SemanticRule], approved: bool = True
) -> DataFrame:
    rows = [
        {
            **{f: getattr(r, f) for f in SEMANTIC_TABLE.fieldNames() if f != "approved"},
            **{f: list(getattr(r, f)) for f in _LISTS},
            "approved": approved,
        }
        for r in rules
    ]
    return local_frame(spark, rows, SEMANTIC_TABLE)
