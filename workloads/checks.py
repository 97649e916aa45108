"""Queries and their SQL by name.  Doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

import plumbline as pl
from plumbline.streaming.quality import utc_wall_clock
from plumbline.session import durable_folder
from workloads.tables import LINEITEM, VIEWS, load, with_view

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NUMBERS = [c for c, k in LINEITEM.items() if k == "number"]
OTHERS = [c for c, k in LINEITEM.items() if k != "number"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def register(
    name: str,
    view: str | None,
    run: Callable[[DataFrame], DataFrame] | Query,
    sql: str | None = None,
    digits: int = 6,
) -> None:
    """Register a query on one table or view; with ``view`` None it gets (spark, sf_dir)."""
    if view is None:
        QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir), digits)
    else:
        QUERIES[name] = lambda spark, sf_dir: rounded(run(load(spark, sf_dir, view)), digits)
    if sql is not None:
        SQL[name] = with_view(view, sql) if view in VIEWS else sql


def each(columns, template: str) -> str:
    """A UNION ALL of one SELECT per column; ``{c}`` is the column."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


def n(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


# ---------------------------------------------------------------- profile

register(
    "table_shape",
    "dirty_lineitem",
    pl.table_shape,
    f"SELECT {n('count(*)')} AS row_count, {n(str(len(LINEITEM)))} AS column_count FROM dirty_lineitem",
)

_GROUPS = f"(SELECT count(*) AS c FROM dirty_lineitem GROUP BY {', '.join(LINEITEM)}) AS g"
register(
    "duplicate_rows",
    "dirty_lineitem",
    pl.duplicate_rows,
    f"SELECT {n('sum(c)')} AS row_count, {n('sum(c - 1)')} AS duplicate_rows, "
    f"{r('sum(c - 1) * 1.0 / sum(c)')} AS duplicate_rate FROM {_GROUPS}",
)
register(
    "duplicate_rows_digest",
    "dirty_lineitem",
    lambda df: pl.duplicate_rows(df, digest=True),
    f"SELECT {n('sum(c)')} AS row_count, {n('sum(c - 1)')} AS duplicate_rows, "
    f"{r('sum(c - 1) * 1.0 / sum(c)')} AS duplicate_rate FROM {_GROUPS}",
)
register(
    "duplicate_documents",
    "documents",
    lambda df: pl.duplicate_rows(df.select("text", "lang")),
    f"SELECT {n('sum(c)')} AS row_count, {n('sum(c - 1)')} AS duplicate_rows, "
    f"{r('sum(c - 1) * 1.0 / sum(c)')} AS duplicate_rate "
    "FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang) AS g",
)
_TYPE_SQL = (
    "(SELECT CASE max(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END FROM dirty_lineitem)"
)
register(
    "column_types",
    "dirty_lineitem",
    pl.column_types,
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_TYPE_SQL.replace('{c}', c)} AS data_type, CAST({i} AS INTEGER) AS position, "
        f"{n(f'count({c})')} AS non_null FROM dirty_lineitem"
        for i, c in enumerate(LINEITEM, 1)
    ),
)
register(
    "null_profile",
    "dirty_lineitem",
    pl.null_profile,
    each(
        LINEITEM,
        f"SELECT '{{c}}' AS column_name, {n('count(*) - count({c})')} AS null_count, "
        f"{r('(count(*) - count({c})) * 1.0 / count(*)')} AS null_rate FROM dirty_lineitem",
    ),
)
_NAN_FREE = "CASE WHEN NOT isnan(value) THEN value END"
register(
    "null_profile_nan",
    "nan_events",
    lambda df: pl.null_profile(df, ["value", "event_type"]),
    f"SELECT 'value' AS column_name, {n(f'count(*) - count({_NAN_FREE})')} AS null_count, "
    f"{r(f'(count(*) - count({_NAN_FREE})) * 1.0 / count(*)')} AS null_rate FROM nan_events UNION ALL "
    f"SELECT 'event_type', {n('count(*) - count(event_type)')}, {r('(count(*) - count(event_type)) * 1.0 / count(*)')} FROM nan_events",
)
register(
    "unique_counts",
    "dirty_lineitem",
    pl.unique_counts,
    each(
        LINEITEM,
        f"SELECT '{{c}}' AS column_name, {n('count(DISTINCT {c})')} AS unique_count FROM dirty_lineitem",
    ),
)


def _numeric_sql(column: str, value: str, table: str) -> str:
    v = f"CAST({value} AS DOUBLE)"
    return (
        f"SELECT '{column}' AS column_name, {n(f'count({v})')} AS non_null, {r(f'min({v})', 4)} AS min_value, "
        f"{r(f'max({v})', 4)} AS max_value, {r(f'avg({v})', 4)} AS mean, {r(f'stddev_samp({v})', 4)} AS std, "
        f"{r(f'quantile_cont({v}, 0.25)', 4)} AS q25, {r(f'quantile_cont({v}, 0.5)', 4)} AS median, "
        f"{r(f'quantile_cont({v}, 0.75)', 4)} AS q75 FROM {table}"
    )


register(
    "numeric_profile",
    "dirty_lineitem",
    pl.numeric_profile,
    " UNION ALL ".join(_numeric_sql(c, c, "dirty_lineitem") for c in NUMBERS),
    digits=4,
)
register(
    "numeric_profile_nan",
    "nan_events",
    lambda df: pl.numeric_profile(df, ["value"]),
    _numeric_sql("value", _NAN_FREE, "nan_events"),
    digits=4,
)
_QUARTILES = ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in NUMBERS
)
register(
    "iqr_outliers",
    "dirty_lineitem",
    pl.iqr_outliers,
    f"WITH q AS (SELECT {_QUARTILES} FROM dirty_lineitem) "
    + each(
        NUMBERS,
        f"SELECT '{{c}}' AS column_name, {r('min({c}_q1)', 4)} AS q25, {r('min({c}_q3)', 4)} AS q75, "
        + n(
            "count(CASE WHEN {c}_q3 <> {c}_q1 AND ({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) "
            "OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)) THEN 1 END)"
        )
        + " AS outlier_count FROM dirty_lineitem, q",
    ),
    digits=4,
)
_COLUMN_PROFILE_SQL = (
    f"WITH q AS (SELECT {_QUARTILES} FROM dirty_lineitem) "
    + each(
        NUMBERS,
        f"SELECT '{{c}}' AS column_name, {n('count(*) - count({c})')} AS null_count, "
        f"{r('(count(*) - count({c})) * 1.0 / count(*)', 4)} AS null_rate, {n('count(DISTINCT {c})')} AS unique_count, "
        f"{r('min({c})', 4)} AS min_value, {r('max({c})', 4)} AS max_value, {r('avg({c})', 4)} AS mean, "
        f"{r('stddev_samp({c})', 4)} AS std, {r('min({c}_q1)', 4)} AS q25, {r('quantile_cont({c}, 0.5)', 4)} AS median, "
        f"{r('min({c}_q3)', 4)} AS q75, "
        + n(
            "count(CASE WHEN {c}_q3 <> {c}_q1 AND ({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) "
            "OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)) THEN 1 END)"
        )
        + " AS outlier_count FROM dirty_lineitem, q",
    )
    + " UNION ALL "
    + each(
        OTHERS,
        f"SELECT '{{c}}', {n('count(*) - count({c})')}, {r('(count(*) - count({c})) * 1.0 / count(*)', 4)}, "
        f"{n('count(DISTINCT {c})')}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dirty_lineitem",
    )
)
register(
    "column_profile",
    "dirty_lineitem",
    lambda df: pl.column_profile(df).drop("data_type"),
    _COLUMN_PROFILE_SQL,
    digits=4,
)


def _frequency_sql(columns, table: str) -> str:
    return each(
        columns,
        f"SELECT '{{c}}' AS column_name, CAST({{c}} AS VARCHAR) AS value, count(*) AS cnt FROM {table} WHERE {{c}} IS NOT NULL GROUP BY 2",
    )


def _top_sql(columns, table: str, k: int) -> str:
    return (
        f"WITH f AS ({_frequency_sql(columns, table)}), "
        "t AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank FROM f) "
        f"SELECT column_name, {n('rank')} AS rank, value, {n('cnt')} AS cnt FROM t WHERE rank <= {k}"
    )


register("top_values", "dirty_lineitem", pl.top_values, _top_sql(OTHERS, "dirty_lineitem", 10))
#: Three significant digits as in a profile's text.
_THREE_DIGITS = (
    "CASE WHEN abs(m) >= 999.5 OR abs(m) < 0.00009995 THEN printf('%.2e', m) WHEN abs(m) >= 99.95 THEN printf('%.0f', m) "
    "WHEN abs(m) >= 9.995 THEN printf('%.1f', m) WHEN abs(m) >= 0.9995 THEN printf('%.2f', m) WHEN abs(m) >= 0.09995 THEN printf('%.3f', m) "
    "WHEN abs(m) >= 0.009995 THEN printf('%.4f', m) WHEN abs(m) >= 0.0009995 THEN printf('%.5f', m) ELSE printf('%.6f', m) END"
)
_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS position, {_TYPE_SQL.replace('{c}', c)} AS data_type, "
    f"100.0 * (count(*) - count({c})) / count(*) AS missing, "
    + (f"avg(CAST({c} AS DOUBLE))" if kind == "number" else "CAST(NULL AS DOUBLE)")
    + " AS m FROM dirty_lineitem"
    for i, (c, kind) in enumerate(LINEITEM.items(), 1)
)
register(
    "profile_text",
    "dirty_lineitem",
    lambda df: pl.profile_lines(df, "l_returnflag"),
    f"WITH cells AS ({_CELLS_SQL}), p AS ({_COLUMN_PROFILE_SQL}), "
    f"listed AS (SELECT column_name, string_agg(value, ', ' ORDER BY rank) AS top FROM ({_top_sql(OTHERS, 'dirty_lineitem', 5)}) AS t GROUP BY 1), "
    f"copies AS (SELECT sum(c) AS n, sum(c - 1) AS d FROM {_GROUPS}), "
    "classes AS (SELECT l_returnflag AS label, count(*) AS cnt FROM dirty_lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1), "
    "lines AS ("
    f"SELECT 0 AS section, 0 AS place, '' AS name, 'Dataset: ' || CAST(n AS BIGINT) || ' rows x {len(LINEITEM)} columns' AS text FROM copies "
    "UNION ALL SELECT 1, 0, '', 'Duplicate rows: ' || CAST(d AS BIGINT) || ' (' || printf('%.1f', 100.0 * d / n) || '%)' FROM copies "
    "UNION ALL SELECT 2, 0, '', 'Label column: ' || chr(39) || 'l_returnflag' || chr(39) "
    "UNION ALL SELECT 3, -cnt, label, '  class ' || label || ': ' || cnt FROM classes "
    "UNION ALL SELECT 4, 0, '', 'Class balance (min/max): ' || printf('%.3f', min(cnt) * 1.0 / max(cnt)) FROM classes "
    "UNION ALL SELECT 5, 0, '', 'Column profiles:' "
    "UNION ALL SELECT 6, position, '', '  ' || column_name || ' [' || data_type || ']: ' || printf('%.1f', missing) || '% null, ' || "
    f"CASE WHEN m IS NOT NULL THEN 'range [' || CAST(min_value AS VARCHAR) || ', ' || CAST(max_value AS VARCHAR) || '], mean=' || {_THREE_DIGITS} "
    "|| ', outliers=' || outlier_count || ', unique=' || unique_count ELSE 'unique=' || unique_count || ', top=[' || top || ']' END "
    "FROM cells JOIN p USING (column_name) LEFT JOIN listed USING (column_name)) "
    f"SELECT {n('row_number() OVER (ORDER BY section, place, name)')} AS line_no, text FROM lines",
)
register(
    "top_values_sketched",
    "dirty_lineitem",
    lambda df: pl.top_values(df, sketch=True),
    _top_sql(OTHERS, "dirty_lineitem", 10),
)
register(
    "top_values_sketched_documents",
    "documents",
    lambda df: pl.top_values(df, ["doc_id", "lang", "source"], 3, sketch=True),
    _top_sql(["doc_id", "lang", "source"], "documents", 3),
)
register(
    "value_frequency",
    "dirty_orders",
    lambda df: pl.value_frequency(df, ["o_orderkey", "o_orderstatus", "o_orderpriority"]),
    f"WITH f AS ({_frequency_sql(['o_orderkey', 'o_orderstatus', 'o_orderpriority'], 'dirty_orders')}) "
    f"SELECT column_name, value, {n('cnt')} AS cnt FROM f",
)
register("profile_lines", "dirty_lineitem", lambda df: pl.profile_lines(df, "l_returnflag", ["l_orderkey", "l_linenumber"]))
register(
    "redundant_columns",
    "padded_orders",
    pl.redundant_columns,
    "WITH s AS ("
    + each(
        ["o_orderkey", "o_orderstatus", "currency", "rebate", "version", "flag"],
        "SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) AS total, count(DISTINCT {c}) AS uniq FROM padded_orders",
    )
    + f") SELECT column_name, {n('null_count')} AS null_count, CASE WHEN uniq = 0 THEN 'all_null' ELSE 'constant' END AS reason "
    "FROM s WHERE uniq = 0 OR (uniq = 1 AND null_count = 0)",
)
register(
    "sample_rows",
    "dirty_orders",
    lambda df: pl.sample_rows(df, ["o_orderdate", "o_orderkey"], 5),
    "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) + 0.0 AS o_totalprice, o_orderdate, o_orderpriority "
    "FROM dirty_orders ORDER BY o_orderdate, o_orderkey LIMIT 5",
)

# ---------------------------------------------------------------- labels


def _labels_sql(table: str, label: str = "label") -> str:
    return f"WITH d AS (SELECT CAST({label} AS VARCHAR) AS label, count(*) AS cnt FROM {table} WHERE {label} IS NOT NULL GROUP BY 1) "


for _suffix, _view in (("", "imbalanced_embeddings"), ("_documents", "labeled_documents")):
    _d = _labels_sql(_view)
    register(
        f"label_distribution{_suffix}",
        _view,
        pl.label_distribution,
        _d + f"SELECT label, {n('cnt')} AS cnt FROM d",
    )
    register(
        f"class_balance{_suffix}",
        _view,
        pl.class_balance,
        _d
        + f"SELECT {n('min(cnt)')} AS min_count, {n('max(cnt)')} AS max_count, {r('min(cnt) * 1.0 / max(cnt)')} AS class_balance FROM d",
    )
    register(
        f"value_occurrence_completeness{_suffix}",
        _view,
        pl.value_occurrence_completeness,
        _d
        + ", e AS (SELECT sum(cnt) * 1.0 / count(*) AS expected, sum(cnt) AS total, count(*) AS classes FROM d) "
        + f"SELECT {n('min(classes)')} AS classes, {n('min(total)')} AS labels, {r('min(expected)')} AS expected_per_class, "
        f"{r('100.0 * sum(least(cnt, expected)) / min(total)')} AS value_occurrence_completeness FROM d, e",
    )
    register(
        f"label_richness{_suffix}",
        _view,
        pl.label_richness,
        _d + f"SELECT {n('count(*)')} AS classes, {n('sum(cnt)')} AS labels FROM d",
    )
    register(
        f"label_abundance{_suffix}",
        _view,
        pl.label_abundance,
        _d + f"SELECT label, {n('cnt')} AS cnt, {r('cnt * 1.0 / (SELECT sum(cnt) FROM d)')} AS abundance FROM d",
    )
    register(
        f"label_imbalance{_suffix}",
        _view,
        pl.label_imbalance,
        _d
        + f"SELECT {r('min(cnt) * 1.0 / sum(cnt)')} AS min_abundance, {r('max(cnt) * 1.0 / sum(cnt)')} AS max_abundance, "
        f"{r('max(cnt) * 1.0 / min(cnt)')} AS imbalance_ratio FROM d",
    )
    register(
        f"category_size_diversity{_suffix}",
        _view,
        pl.category_size_diversity,
        _d
        + f"SELECT {n('count(*)')} AS classes, {n('count(CASE WHEN cnt * 1.0 / (SELECT sum(cnt) FROM d) < 0.5 THEN 1 END)')} AS classes_below_half, "
        f"{r('100.0 * count(CASE WHEN cnt * 1.0 / (SELECT sum(cnt) FROM d) < 0.5 THEN 1 END) / count(*)')} AS category_size_diversity FROM d",
    )
register(
    "label_completeness",
    "labeled_documents",
    pl.label_completeness,
    f"SELECT {n('count(*)')} AS row_count, {n('count(label)')} AS labelled_rows, {r('100.0 * count(label) / count(*)')} AS label_completeness FROM labeled_documents",
)
register(
    "label_completeness_placeholder",
    "labeled_documents",
    lambda df: pl.label_completeness(df, "label", unlabeled_values=[0]),
    f"SELECT {n('count(*)')} AS row_count, {n('count(CASE WHEN label <> 0 THEN 1 END)')} AS labelled_rows, "
    f"{r('100.0 * count(CASE WHEN label <> 0 THEN 1 END) / count(*)')} AS label_completeness FROM labeled_documents",
)

# ---------------------------------------------------------------- completeness and consistency

_NULL_CELLS = " + ".join(f"(count(*) - count({c}))" for c in LINEITEM)
_ALL_GIVEN = " AND ".join(f"{c} IS NOT NULL" for c in LINEITEM)
_FULL = " + ".join(f"CASE WHEN count(*) = count({c}) THEN 1 ELSE 0 END" for c in LINEITEM)
register(
    "value_completeness",
    "dirty_lineitem",
    pl.value_completeness,
    f"SELECT {n(_NULL_CELLS)} AS null_cells, {n(f'count(*) * {len(LINEITEM)}')} AS total_cells, "
    f"{r(f'100.0 * (1 - ({_NULL_CELLS}) * 1.0 / (count(*) * {len(LINEITEM)}))')} AS value_completeness FROM dirty_lineitem",
)
register(
    "feature_completeness",
    "dirty_lineitem",
    pl.feature_completeness,
    f"SELECT {n(_FULL)} AS complete_columns, {n(str(len(LINEITEM)))} AS column_count, "
    f"{r(f'100.0 * ({_FULL}) / {len(LINEITEM)}')} AS feature_completeness FROM dirty_lineitem",
)
register(
    "record_completeness",
    "dirty_lineitem",
    pl.record_completeness,
    f"SELECT {n(f'count(CASE WHEN {_ALL_GIVEN} THEN 1 END)')} AS complete_rows, {n('count(*)')} AS row_count, "
    f"{r(f'100.0 * count(CASE WHEN {_ALL_GIVEN} THEN 1 END) / count(*)')} AS record_completeness FROM dirty_lineitem",
)
register(
    "record_consistency",
    "dirty_lineitem",
    pl.record_consistency,
    f"SELECT {n('sum(c - 1)')} AS duplicate_rows, {n('sum(c)')} AS row_count, {r('100.0 * (1 - sum(c - 1) * 1.0 / sum(c))')} AS record_consistency FROM {_GROUPS}",
)
_CLASS = (
    "CASE WHEN regexp_matches({c}, '^[+-]?[0-9]+$') THEN 'int' "
    "WHEN regexp_matches({c}, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' "
    "WHEN lower({c}) IN ('true', 'false') THEN 'bool' "
    "WHEN regexp_matches({c}, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+([zZ]|[+-][0-9:]+)?)?$') THEN 'date' ELSE 'string' END"
)
_CLASSES = each(
    ["lang", "mixed", "clean"],
    f"SELECT '{{c}}' AS column_name, {_CLASS} AS value_class, count(*) AS cnt FROM mixed_values WHERE {{c}} IS NOT NULL GROUP BY 2",
)
register(
    "mixed_type_columns",
    "mixed_values",
    pl.mixed_type_columns,
    f"WITH k AS ({_CLASSES}) SELECT column_name, value_class, {n('cnt')} AS cnt FROM k "
    "WHERE column_name IN (SELECT column_name FROM k GROUP BY column_name HAVING count(*) > 1)",
)
register(
    "format_consistency",
    "mixed_values",
    pl.format_consistency,
    f"WITH k AS ({_CLASSES}), m AS (SELECT column_name FROM k GROUP BY column_name HAVING count(*) > 1) "
    f"SELECT {n('count(*)')} AS mixed_columns, {n('4')} AS column_count, {r('100.0 * (1 - count(*) / 4.0)')} AS format_consistency FROM m",
)
register(
    "json_field_types",
    "events",
    lambda df: pl.json_field_types(df, "props"),
    f"SELECT key AS field, CASE WHEN type LIKE '%INT%' THEN 'BIGINT' ELSE type END AS value_type, {n('count(*)')} AS cnt "
    "FROM (SELECT k.key AS key, k.type AS type FROM events, json_each(props) AS k) AS j GROUP BY 1, 2",
)
register(
    "distribution_stats",
    "dirty_lineitem",
    pl.distribution_stats,
    each(
        NUMBERS,
        f"SELECT '{{c}}' AS column_name, {r('CASE WHEN stddev_samp({c}) = 0 AND count({c}) >= 3 THEN 0 ELSE skewness({c}) END', 4)} AS skewness, "
        f"{r('CASE WHEN stddev_samp({c}) = 0 AND count({c}) >= 4 THEN 0 ELSE kurtosis({c}) END', 4)} AS kurtosis, "
        f"{r('CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / avg({c}) END', 4)} AS cv FROM dirty_lineitem",
    ),
    digits=4,
)

# ---------------------------------------------------------------- diversity of features, time series

register(
    "feature_diversity",
    "document_features",
    pl.feature_diversity,
    f"WITH f AS ({_frequency_sql(['lang', 'source'], 'document_features')}), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank, "
    "count(*) OVER (PARTITION BY column_name) AS u, sum(cnt) OVER (PARTITION BY column_name) AS total FROM f) "
    f"SELECT column_name, {n('u')} AS unique_count, {n('rank')} AS rank, value, {r('cnt * 1.0 / total')} AS share FROM t WHERE rank <= 5",
)
register(
    "time_series_indicators",
    "orders",
    pl.time_series_indicators,
    f"SELECT 'o_orderdate' AS datetime_columns, {n('3')} AS numeric_columns, {n('count(*)')} AS row_count FROM orders",
)
register(
    "time_series_indicators_by_type",
    "events",
    lambda df: pl.time_series_indicators(df, by="type"),
    f"SELECT 'ts' AS datetime_columns, {n('3')} AS numeric_columns, {n('count(*)')} AS row_count FROM events",
)


def _halves_sql(table: str, column: str, order: str) -> str:
    return (
        f"h AS (SELECT CAST({column} AS DOUBLE) AS v, row_number() OVER (ORDER BY {order}) AS pos, count(*) OVER () AS total "
        f"FROM {table} WHERE {column} IS NOT NULL), "
        "t AS (SELECT count(*) AS non_null, avg(CASE WHEN pos <= total // 2 THEN v END) AS first_mean, "
        "avg(CASE WHEN pos > total // 2 THEN v END) AS second_mean, stddev_samp(v) AS std FROM h) "
    )


_HALVES = (
    f"SELECT '{{c}}' AS column_name, {n('non_null')} AS non_null, {r('first_mean', 4)} AS first_mean, {r('second_mean', 4)} AS second_mean, "
    f"{r('std', 4)} AS std, std > 0 AND abs(first_mean - second_mean) > 0.5 * std AS trend FROM t"
)
_COMPONENTS = (
    "SELECT std > 0 AND abs(first_mean - second_mean) > 0.5 * std AS trend, true AS seasonal, std > 0 AS irregular, "
    + r(
        "round(100.0 * (CASE WHEN std > 0 AND abs(first_mean - second_mean) > 0.5 * std THEN 1 ELSE 0 END + 1 + CASE WHEN std > 0 THEN 1 ELSE 0 END) / 4, 1)"
    )
    + " AS component_richness FROM t"
)
register(
    "trend_component",
    "events",
    lambda df: pl.trend_component(df, ["ts", "event_id"], "value"),
    "WITH " + _halves_sql("events", "value", "ts, event_id") + _HALVES.replace("{c}", "value"),
    digits=4,
)
register(
    "trend_component_tied_keys",
    "dirty_orders",
    lambda df: pl.trend_component(df, ["o_orderdate"], "o_totalprice"),
    "WITH "
    + _halves_sql("dirty_orders", "o_totalprice", "o_orderdate, o_totalprice")
    + _HALVES.replace("{c}", "o_totalprice"),
    digits=4,
)
register(
    "component_richness",
    "orders",
    lambda df: pl.component_richness(df, ["o_orderdate", "o_orderkey"]),
    "WITH " + _halves_sql("orders", "o_orderkey", "o_orderdate, o_orderkey") + _COMPONENTS,
)
register(
    "component_richness_events",
    "events",
    lambda df: pl.component_richness(df, ["ts", "event_id"], by="type"),
    "WITH " + _halves_sql("events", "event_id", "ts, event_id") + _COMPONENTS,
)

# ---------------------------------------------------------------- rules


def rule_row(
    rule: pl.SyntacticRule | pl.SemanticRule,
    table: str,
    failed: str | None,
    tainted: str | None = None,
    status: str = "ok",
    total: str = "count(*)",
) -> str:
    """The result row of a rule; ``failed`` is the condition of a violation."""
    field = rule.field if isinstance(rule, pl.SyntacticRule) else ",".join(rule.fields_involved)
    head = (
        f"SELECT '{rule.rule_id}' AS rule_id, '{field}' AS field, '{rule.rule_type}' AS rule_type, "
        f"'{status}' AS status, '{rule.description}' AS description, "
    )
    if failed is None:
        null = "CAST(NULL AS BIGINT)"
        return (
            f"{head}{null} AS failed_values, {null} AS violations, {null} AS total, "
            "CAST(NULL AS DOUBLE) AS violation_rate, CAST(NULL AS DOUBLE) AS pass_rate"
        )
    count = f"count(CASE WHEN {failed} THEN 1 END)"
    broken = f"CASE WHEN {count} > 0 THEN count({tainted}) ELSE 0 END" if tainted else count
    return (
        f"{head}{n(count)} AS failed_values, {n(broken)} AS violations, {n(total)} AS total, "
        f"{r(f'({broken}) * 1.0 / {total}')} AS violation_rate, {r(f'1 - ({broken}) * 1.0 / {total}')} AS pass_rate FROM {table}"
    )


S = pl.SyntacticRule
QUANTITY_RANGE = S("l_quantity", "range", {"min": 1, "max": 45}, "quantity", "", "quantity_range")
DISCOUNT_RANGE = S("l_discount", "range", {"min": 0, "max": 0.1}, "discount", "", "discount_range")
PRICE_RANGE = S("l_extendedprice", "range", {"max": 100000}, "price", "", "price_range")
DATE_RANGE = S("l_shipdate", "range", {"min": "1993-01-01", "max": "1998-01-01"}, "ship date", "", "date_range")
FLAG_ENUM = S("l_returnflag", "enum", ["A", "N", "R", 1], "return flag", "", "flag_enum")
LINE_ENUM = S("l_linenumber", "enum", [1, 2, 3, "4"], "line number", "", "line_enum")
STATUS_LENGTH = S("l_linestatus", "length", {"min": 1, "max": 1}, "status", "", "status_length")
KEY_LENGTH = S("l_orderkey", "length", {"min": 2, "max": 4}, "key length", "", "key_length")
QUANTITY_GIVEN = S("l_quantity", "not_null", True, "quantity given", "", "quantity_given")
FLAG_GIVEN = S("l_returnflag", "not_null", True, "flag given", "", "flag_given")
FLAG_FORMAT = S("l_returnflag", "format", "[A-R]", "flag letter", "", "flag_format")
KEY_TYPE = S("l_orderkey", "dtype", "int32", "key type", "", "key_type")
FLAG_TYPE = S("l_returnflag", "dtype", "int64", "flag as number", "", "flag_type")
PRICE_TEXT_RANGE = S("l_extendedprice", "range", {"min": "cheap"}, "mismatch", "", "price_text")
NO_COLUMN = S("l_color", "not_null", True, "no such column", "", "no_column")
NO_TYPE = S("l_tax", "checksum", "crc", "no such column either", "", "no_type")
NO_RULE = S("l_linestatus", "checksum", "crc", "no such rule", "", "no_rule")

# The violation condition of each rule in SQL, and for dtype rules the tainted column.
CONDITIONS: dict[str, tuple] = {
    "quantity_range": (QUANTITY_RANGE, "l_quantity < 1 OR l_quantity > 45"),
    "discount_range": (DISCOUNT_RANGE, "l_discount < 0 OR l_discount > 0.1"),
    "price_range": (PRICE_RANGE, "l_extendedprice > 100000"),
    "date_range": (DATE_RANGE, "l_shipdate < TIMESTAMP '1993-01-01' OR l_shipdate > TIMESTAMP '1998-01-01'"),
    "flag_enum": (FLAG_ENUM, "l_returnflag NOT IN ('A', 'N', 'R')"),
    "line_enum": (LINE_ENUM, "l_linenumber NOT IN (1, 2, 3)"),
    "status_length": (STATUS_LENGTH, "length(l_linestatus) < 1 OR length(l_linestatus) > 1"),
    "key_length": (KEY_LENGTH, "length(CAST(l_orderkey AS VARCHAR)) < 2 OR length(CAST(l_orderkey AS VARCHAR)) > 4"),
    "quantity_given": (QUANTITY_GIVEN, "l_quantity IS NULL"),
    "flag_given": (FLAG_GIVEN, "l_returnflag IS NULL"),
    "flag_format": (FLAG_FORMAT, "NOT regexp_matches(l_returnflag, '^(?:[A-R])')"),
    "key_type": (KEY_TYPE, "try_cast(l_orderkey AS INTEGER) IS NULL AND l_orderkey IS NOT NULL", "l_orderkey"),
    "flag_type": (FLAG_TYPE, "NOT regexp_matches(l_returnflag, '^[+-]?[0-9]+$')", "l_returnflag"),
}
STOPPED = {
    "price_text": (PRICE_TEXT_RANGE, "type_mismatch"),
    "no_column": (NO_COLUMN, "column_missing"),
    "no_type": (NO_TYPE, "column_missing"),
    "no_rule": (NO_RULE, "unsupported_rule"),
}
ALL_RULES = [c[0] for c in CONDITIONS.values()] + [s[0] for s in STOPPED.values()]


def rules_sql(ids) -> str:
    rows = []
    for i in ids:
        if i in CONDITIONS:
            rule, failed, *tainted = CONDITIONS[i]
            rows.append(rule_row(rule, "dirty_lineitem", failed, *tainted))
        else:
            rule, status = STOPPED[i]
            rows.append(rule_row(rule, "dirty_lineitem", None, status=status))
    return " UNION ALL ".join(rows)


for _name, _ids in {
    "rule_range": ["quantity_range", "discount_range", "price_range", "date_range"],
    "rule_enum": ["flag_enum", "line_enum"],
    "rule_length": ["status_length", "key_length"],
    "rule_not_null": ["quantity_given", "flag_given"],
    "rule_missing_column": ["no_column"],
    "rule_results": [*CONDITIONS, *STOPPED],
}.items():
    _rules = [r_ for r_ in ALL_RULES if r_.rule_id in _ids]
    register(_name, "dirty_lineitem", lambda df, rules=_rules: pl.check_rules(df, rules), rules_sql(_ids))


def _from_rule_table(df: DataFrame) -> DataFrame:
    """Rules from a table in which some are not approved and one has no field."""
    spark, approved = df.sparkSession, {"quantity_range", "flag_enum", "key_length", "flag_given", "flag_format", "no_rule"}
    blank = S(" ", "not_null", True, "no field", "", "blank")
    table = pl.syntactic_table(spark, [*[r_ for r_ in ALL_RULES if r_.rule_id in approved], blank]).unionByName(
        pl.syntactic_table(spark, [r_ for r_ in ALL_RULES if r_.rule_id not in approved], approved=False)
    )
    return pl.check_rules(df, table)


register(
    "rule_table_results",
    "dirty_lineitem",
    _from_rule_table,
    rules_sql(["quantity_range", "flag_enum", "key_length", "flag_given", "flag_format", "no_rule"]),
)
PRIORITY_FORMAT = S("o_orderpriority", "format", r"\d-[A-Z]", "priority code", "", "priority_format")
register(
    "rule_format",
    "dirty_orders",
    lambda df: pl.check_rules(df, [PRIORITY_FORMAT]),
    rule_row(PRIORITY_FORMAT, "dirty_orders", "NOT regexp_matches(o_orderpriority, '^(?:\\d-[A-Z])')"),
)
MIXED_TYPE = S("mixed", "dtype", "int64", "mixed as number", "", "mixed_type")
register(
    "rule_dtype",
    "mixed_values",
    lambda df: pl.check_rules(df, [MIXED_TYPE]),
    rule_row(MIXED_TYPE, "mixed_values", "NOT regexp_matches(mixed, '^[+-]?[0-9]+$')", "mixed"),
)
_BROKEN = ", ".join(f"CASE WHEN {c[1]} THEN '{i}' END" for i, c in CONDITIONS.items())
register(
    "violating_rows",
    "dirty_lineitem",
    lambda df: pl.violating_rows(df, ALL_RULES, skip_idle=True).select(
        "l_orderkey", "l_linenumber", F.array_join("violated_rules", ",").alias("violated_rules")
    ),
    f"WITH v AS (SELECT l_orderkey, l_linenumber, concat_ws(',', {_BROKEN}) AS violated_rules FROM dirty_lineitem) "
    "SELECT l_orderkey, l_linenumber, violated_rules FROM v WHERE violated_rules <> ''",
)

M = pl.SemanticRule
SHIP_AFTER_ORDER = M(
    "ship_after_order",
    "cross_field",
    ("l_shipdate", "o_orderdate"),
    "shipped after ordered",
    rule_id="ship_after_order",
    expression="l_shipdate >= o_orderdate",
)
register(
    "semantic_cross_field",
    "shipped_orders",
    lambda df: pl.check_semantic_rules(df, [SHIP_AFTER_ORDER]),
    rule_row(SHIP_AFTER_ORDER, "shipped_orders", "NOT (l_shipdate >= o_orderdate)"),
)
WHOLE_PRIORITY = M(
    "whole_priority",
    "cross_field",
    ("o_orderpriority", "o_custkey"),
    "priority is a number, which most texts are not",
    rule_id="whole_priority",
    expression="CAST(o_orderpriority AS INT) > 0 AND o_custkey > 0",
)
KNOWN_CUSTOMER = M(
    "known_customer",
    "domain_logic",
    ("o_custkey",),
    "customers have small numbers",
    rule_id="known_customer",
    condition="o_orderstatus = 'F'",
    expression="o_custkey < 10000000",
)
HUGE_TOTAL = S("o_totalprice", "range", {"min": 0, "max": 10**25}, "beyond 64 bits", rule_id="huge_total")
HUGE_KEY = S("o_orderkey", "range", {"min": -(10**25), "max": 10**25}, "beyond 64 bits", rule_id="huge_key")
NO_KEY = S("o_orderkey", "range", {"min": 10**25}, "above all keys", rule_id="no_key")
register(
    "rules_that_raise",
    "dirty_orders",
    lambda df: pl.check_semantic_rules(df, [WHOLE_PRIORITY, KNOWN_CUSTOMER]).unionByName(
        pl.check_rules(df, [HUGE_TOTAL, HUGE_KEY, NO_KEY])
    ),
    " UNION ALL ".join(
        [
            rule_row(WHOLE_PRIORITY, "dirty_orders", None, status="raised"),
            rule_row(KNOWN_CUSTOMER, "dirty_orders", "o_orderstatus = 'F' AND NOT (o_custkey < 10000000)"),
            rule_row(HUGE_TOTAL, "dirty_orders", "o_totalprice < 0 OR o_totalprice > 1e25"),
            rule_row(HUGE_KEY, "dirty_orders", "false"),
            rule_row(NO_KEY, "dirty_orders", "o_orderkey IS NOT NULL"),
        ]
    ),
)
RETURNED_IS_FINAL = M(
    "returned_is_final",
    "domain_logic",
    ("l_returnflag", "l_linestatus"),
    "returned lines are final",
    rule_id="returned_is_final",
    condition="l_returnflag = 'R'",
    expression="l_linestatus = 'F'",
)
register(
    "semantic_domain_logic",
    "lineitem",
    lambda df: pl.check_semantic_rules(df, [RETURNED_IS_FINAL]),
    rule_row(RETURNED_IS_FINAL, "lineitem", "l_returnflag = 'R' AND NOT (l_linestatus = 'F')"),
)


def _temporal(rule_id: str, field: str, key: str, order: str) -> pl.SemanticRule:
    return M(
        rule_id,
        "temporal",
        (field,),
        "in order",
        rule_id=rule_id,
        key_columns=(key,),
        order_columns=(order,),
    )


def _temporal_sql(rule: pl.SemanticRule, table: str) -> str:
    field, key, order = rule.fields_involved[0], rule.key_columns[0], rule.order_columns[0]
    given = f"{field} IS NOT NULL AND {key} IS NOT NULL AND {order} IS NOT NULL"
    inner = f"(SELECT {field} AS f, lag({field}) OVER (PARTITION BY {key} ORDER BY {order}, {field}) AS p FROM {table} WHERE {given}) AS w"
    return rule_row(rule, inner, "f < p", total=f"(SELECT count(*) FROM {table})")


for _name, _table, _rule in (
    ("semantic_temporal", "orders", _temporal("orders_in_order", "o_orderdate", "o_custkey", "o_orderkey")),
    ("semantic_temporal_hot_key", "dirty_lineitem", _temporal("ship_in_order", "l_shipdate", "l_returnflag", "l_orderkey")),
    ("semantic_temporal_turns", "conversations", _temporal("turns_in_order", "turn", "conv_id", "turn")),
):
    register(
        _name,
        _table,
        lambda df, rule=_rule: pl.check_semantic_rules(df, [rule]),
        _temporal_sql(_rule, _table),
    )

CUSTOMER_KNOWN = M(
    "customer_known",
    "referential",
    ("o_custkey",),
    "customer exists",
    rule_id="customer_known",
    ref_table="customer",
    ref_columns=("c_custkey",),
)
register(
    "semantic_referential",
    None,
    lambda spark, sf_dir: pl.check_semantic_rules(
        load(spark, sf_dir, "dirty_orders"), [CUSTOMER_KNOWN], {"customer": load(spark, sf_dir, "customer")}
    ),
)
SQL["semantic_referential"] = with_view(
    "dirty_orders",
    rule_row(
        CUSTOMER_KNOWN,
        "dirty_orders LEFT JOIN customer ON o_custkey = c_custkey",
        "o_custkey IS NOT NULL AND c_custkey IS NULL",
    ),
)
register(
    "violating_rows_referential",
    None,
    lambda spark, sf_dir: pl.violating_semantic_rows(
        load(spark, sf_dir, "dirty_orders"), CUSTOMER_KNOWN, {"customer": load(spark, sf_dir, "customer")}
    ).select("o_orderkey", "o_custkey"),
)
SQL["violating_rows_referential"] = with_view(
    "dirty_orders",
    "SELECT o_orderkey, o_custkey FROM dirty_orders LEFT JOIN customer ON o_custkey = c_custkey "
    "WHERE o_custkey IS NOT NULL AND c_custkey IS NULL",
)
register(
    "violating_rows_temporal",
    "orders",
    lambda df: pl.violating_semantic_rows(
        df, _temporal("orders_in_order", "o_orderdate", "o_custkey", "o_orderkey")
    ).select("o_orderkey", "o_custkey"),
    "SELECT o_orderkey, o_custkey FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderdate) AS before "
    "FROM orders WHERE o_orderdate IS NOT NULL AND o_custkey IS NOT NULL AND o_orderkey IS NOT NULL) AS w WHERE o_orderdate < before",
)
_FIELD_TYPES = {"o_custkey": "bigint", "o_orderstatus": "string"}
register(
    "semantic_field_stats",
    "dirty_orders",
    lambda df: pl.semantic_field_stats(
        df, [CUSTOMER_KNOWN, M("status_and_key", "cross_field", ("o_orderstatus", "o_custkey", "o_absent"))], ["o_orderdate", "o_orderkey"]
    ).withColumn("sample", F.array_join("sample", "|")),
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{kind}' AS rule_type, '{c}' AS field, '{_FIELD_TYPES[c]}' AS data_type, "
        f"{r(f'(count(*) - count({c})) * 1.0 / count(*)')} AS null_rate, {n(f'count(DISTINCT {c})')} AS unique_count, "
        f"(SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY o_orderdate, o_orderkey) FROM (SELECT {c} AS v, o_orderdate, o_orderkey FROM dirty_orders "
        f"WHERE {c} IS NOT NULL ORDER BY o_orderdate, o_orderkey LIMIT 5) AS s) AS sample FROM dirty_orders"
        for name, kind, c in (
            ("customer_known", "referential", "o_custkey"),
            ("status_and_key", "cross_field", "o_orderstatus"),
            ("status_and_key", "cross_field", "o_custkey"),
        )
    ),
)

register(
    "suggest_rules",
    "dirty_orders",
    lambda df: pl.suggest_rules(df).select(
        "field",
        "rule_type",
        F.when(F.col("rule_type").isin("range", "length"), F.get_json_object("specification", "$.min").cast("double")).alias("low"),
        F.when(F.col("rule_type").isin("range", "length"), F.get_json_object("specification", "$.max").cast("double")).alias("high"),
        F.when(
            F.col("rule_type") == "enum",
            F.array_join(F.from_json("specification", "array<string>"), "|"),
        )
        .when(F.col("rule_type") == "dtype", F.col("specification"))
        .alias("stated"),
        "approved",
    ),
    each(
        ["o_orderkey", "o_custkey", "o_totalprice"],
        f"SELECT '{{c}}' AS field, 'range' AS rule_type, {r('min({c})')} AS low, {r('max({c})')} AS high, CAST(NULL AS VARCHAR) AS stated, false AS approved FROM dirty_orders",
    )
    + " UNION ALL "
    + each(
        ["o_orderstatus", "o_orderpriority"],
        f"SELECT '{{c}}', 'length', {r('min(length({c}))')}, {r('max(length({c}))')}, NULL, false FROM dirty_orders",
    )
    + " UNION ALL "
    + each(
        ["o_orderstatus", "o_orderpriority"],
        "SELECT '{c}', 'enum', NULL, NULL, string_agg(v, '|' ORDER BY v), false FROM (SELECT {c} AS v, count(*) AS cnt FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY 1) AS f HAVING count(*) <= 20 AND min(cnt) > 1",
    )
    + " UNION ALL "
    + each(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "SELECT '{c}', 'not_null', NULL, NULL, NULL, false FROM dirty_orders HAVING count(*) = count({c})",
    )
    + " UNION ALL SELECT 'o_orderkey', 'dtype', NULL, NULL, 'int64', false UNION ALL SELECT 'o_custkey', 'dtype', NULL, NULL, 'int64', false "
    "UNION ALL SELECT 'o_totalprice', 'dtype', NULL, NULL, 'float64', false",
)

# ---------------------------------------------------------------- currentness

AS_OF = 2003
_YEAR = "CASE WHEN {t} NOT IN ('', 'unknown') THEN try_cast(substr({t}, 1, 4) AS INTEGER) END"
_UPDATED = "coalesce(nullif(last_updated, ''), creation_date)"
_AGES = (
    f"a AS (SELECT *, {_YEAR.replace('{t}', 'creation_date')} AS cy, {_YEAR.replace('{t}', _UPDATED)} AS uy FROM customer_metadata) "
)
register(
    "metadata_age",
    "customer_metadata",
    lambda df: pl.metadata_age(df, AS_OF).drop("feature_collection_period"),
    f"WITH {_AGES} SELECT o_custkey, creation_date, last_updated, cy AS creation_year, {AS_OF} - cy AS creation_age_years, "
    f"uy AS updated_year, {AS_OF} - uy AS updated_age_years, {AS_OF} - coalesce(uy, cy) AS age_since_update_years FROM a",
)
register(
    "collection_span",
    "customer_metadata",
    lambda df: df.select(
        "o_custkey", "feature_collection_period", pl.collection_span(F.col("feature_collection_period")).alias("span_years")
    ),
    "WITH p AS (SELECT o_custkey, feature_collection_period, "
    "list_transform(list_filter(string_split(replace(CASE WHEN feature_collection_period NOT IN ('', 'unknown') THEN feature_collection_period END, ' ', ''), '-'), "
    "lambda x: length(x) >= 4), lambda x: try_cast(substr(x, 1, 4) AS INTEGER)) AS years FROM customer_metadata) "
    "SELECT o_custkey, feature_collection_period, CASE WHEN len(years) > 0 AND len(list_filter(years, lambda y: y IS NULL)) = 0 "
    "THEN years[-1] - years[1] END AS span_years FROM p",
)
register(
    "currentness_band",
    "customer_metadata",
    lambda df: pl.metadata_age(df, AS_OF).select(
        "o_custkey", pl.currentness_band(F.col("age_since_update_years"), 5, 7).alias("band")
    ),
    f"WITH {_AGES} SELECT o_custkey, CAST(CASE WHEN coalesce(uy, cy) IS NULL THEN NULL WHEN {AS_OF} - coalesce(uy, cy) <= 5 THEN 100 "
    f"WHEN {AS_OF} - coalesce(uy, cy) <= 7 THEN 50 ELSE 0 END AS DOUBLE) AS band FROM a",
)
_BAND = f"CASE WHEN {AS_OF} - year({{t}}) <= 5 THEN 100.0 WHEN {AS_OF} - year({{t}}) <= 7 THEN 50.0 ELSE 0.0 END"
_OB = _BAND.replace("{t}", "o_orderdate")
register(
    "record_bands",
    "orders",
    lambda df: pl.record_bands(df, "o_orderdate", AS_OF, 5, 7),
    f"SELECT {n('count(o_orderdate)')} AS dated_rows, {n(f'count(CASE WHEN {_OB} = 100 THEN 1 END)')} AS current_rows, "
    f"{n(f'count(CASE WHEN {_OB} = 50 THEN 1 END)')} AS ageing_rows, {n(f'count(CASE WHEN {_OB} = 0 THEN 1 END)')} AS outdated_rows, "
    f"{r(f'avg({_OB})')} AS record_currentness FROM orders",
)
register(
    "stale_rows",
    "orders",
    lambda df: pl.stale_rows(df, "o_orderdate", "2001-12-31", 5),
    "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) + 0.0 AS o_totalprice, o_orderdate, o_orderpriority "
    "FROM orders WHERE o_orderdate < TIMESTAMP '1996-12-31'",
)

# ---------------------------------------------------------------- windows

VALUE_LIMIT = S("value", "range", {"max": 100}, "value limit", "", "value_limit")
VALUE_GIVEN = S("value", "not_null", True, "value given", "", "value_given")


def _grouped_sql(by: str, names: str) -> str:
    rows = []
    for rule, failed in ((VALUE_LIMIT, "value > 100 AND NOT isnan(value)"), (VALUE_GIVEN, "value IS NULL OR isnan(value)")):
        rows.append(rule_row(rule, "nan_events", failed).replace("SELECT ", f"SELECT {names}, ", 1) + f" GROUP BY {by}")
    return " UNION ALL ".join(rows)


_DAY = "date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end"
register(
    "windowed_quality",
    "nan_events",
    lambda df: pl.windowed_quality(df, "ts", "1 day", [VALUE_LIMIT, VALUE_GIVEN]),
    _grouped_sql("date_trunc('day', ts)", _DAY),
)
register(
    "windowed_quality_sliced",
    "nan_events",
    lambda df: pl.windowed_quality(df, "ts", "1 day", [VALUE_LIMIT, VALUE_GIVEN], by=["event_type"]),
    _grouped_sql("date_trunc('day', ts), event_type", _DAY + ", event_type"),
)
register(
    "sliced_quality",
    "nan_events",
    lambda df: pl.sliced_quality(df, ["event_type"], [VALUE_LIMIT, VALUE_GIVEN]),
    _grouped_sql("event_type", "event_type"),
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream, closed windows written out and read back."""
    schema = load(spark, sf_dir, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    results = pl.stream_quality(stream, "ts", "1 hour", "1 day", [VALUE_LIMIT, VALUE_GIVEN])
    path = durable_folder(spark, "windowed-quality")
    pl.write_closed_windows(results, path).awaitTermination()
    written = spark.read.parquet(path)
    return written.withColumns(
        {c: utc_wall_clock(F.col(c)) for c in ("window_start", "window_end")}
    )


QUERIES["windowed_quality_stream"] = lambda spark, sf_dir: rounded(_streamed(spark, sf_dir))
SQL["windowed_quality_stream"] = (
    "WITH nan_events AS (SELECT * FROM events), w AS ("
    + _grouped_sql("date_trunc('day', ts)", _DAY)
    + ") SELECT * FROM w WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
)

# ---------------------------------------------------------------- files


def _through_file(view: str, format: str, read: Callable[[SparkSession, str], DataFrame]) -> Query:
    """Write a table, read it back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{durable_folder(spark, 'files')}/{view}.{format}"
        pl.write_table(load(spark, sf_dir, view), path, format)
        return read(spark, path)

    return run


def _array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON arrays of 2000 keys each, one array per file, read back."""
    orders = load(spark, sf_dir, "dirty_orders")
    record = F.struct(*orders.columns)
    arrays = orders.groupBy(F.floor(F.col("o_orderkey") / 2000)).agg(F.to_json(F.collect_list(record)).alias("value"))
    path = f"{durable_folder(spark, 'files')}/orders.json"
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return pl.read_table(spark, path, schema=orders.schema)


def _csv_orders(spark: SparkSession, path: str) -> DataFrame:
    """With types found from the text; time stamps there have no zone."""
    read = pl.read_table(spark, path)
    return read.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def _split_to_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with quoted line breaks, read by many tasks and stored as Parquet."""
    stored = f"{durable_folder(spark, 'files')}/split.parquet"
    pl.write_table(pl.read_table(spark, path, split=True, missing=()), stored, "parquet")
    return pl.read_table(spark, stored)


_ORDERS_SQL = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) + 0.0 AS o_totalprice, o_orderdate, o_orderpriority "
    "FROM dirty_orders"
)
_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
for _name, _run in {
    "csv_typed": _through_file("dirty_orders", "csv", _csv_orders),
    "jsonl_rows": _through_file("dirty_orders", "json", lambda spark, path: pl.read_table(spark, path, "jsonl", _ORDERS)),
    "json_rows": _array_files,
}.items():
    register(_name, None, _run)
    SQL[_name] = with_view("dirty_orders", _ORDERS_SQL)
_TEXTS_SQL = "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents"
register(
    "csv_texts",
    None,
    _through_file("documents", "csv", pl.read_table),
    _TEXTS_SQL,
)
register("csv_texts_split", None, _through_file("documents", "csv", _split_to_parquet), _TEXTS_SQL)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every source, from a column of JSON text."""
    sources = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("lang").alias("lang"))
    text = F.to_json(
        F.struct(
            F.col("source").alias("source_name"),
            F.concat(F.lit("crawl of "), F.col("n").cast("string")).alias("collection_method"),
            F.when(F.col("n") % 2 == 0, F.lit("2018-2021")).alias("feature_collection_period"),
            F.col("lang").alias("main_language"),
        )
    )
    return pl.metadata_column(sources.select("source", text.alias("meta")), "meta")


register(
    "metadata_columns",
    None,
    _metadata,
    "SELECT source, source AS source_name, CAST(NULL AS VARCHAR) AS source_url, 'crawl of ' || count(*) AS collection_method, "
    "CAST(NULL AS VARCHAR) AS documentation_url, CAST(NULL AS VARCHAR) AS creation_date, CAST(NULL AS VARCHAR) AS anonymization, "
    "CAST(NULL AS VARCHAR) AS license, CAST(NULL AS VARCHAR) AS last_updated, "
    "CASE WHEN count(*) % 2 = 0 THEN '2018-2021' END AS feature_collection_period FROM documents GROUP BY source",
)
