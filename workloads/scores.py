"""The scores of dirty_lineitem, and SQL that works them out from the table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import plumbline as pl
import plumbline.plans.catalogue
import plumbline.plans.rollup
from workloads import checks
from workloads.checks import CONDITIONS, QUERIES, SQL, n, r, rounded
from workloads.tables import LINEITEM, load, with_view

AS_OF = 2003
RULE_IDS = ("quantity_range", "discount_range", "flag_enum", "status_length", "quantity_given", "key_type", "flag_type")
SUPPLIER_KNOWN = pl.SemanticRule(
    "supplier_known",
    "referential",
    ("l_suppkey",),
    "supplier exists",
    rule_id="supplier_known",
    ref_table="supplier",
    ref_columns=("s_suppkey",),
)
PRICE_PER_UNIT = pl.SemanticRule(
    "price_per_unit",
    "cross_field",
    ("l_extendedprice", "l_quantity"),
    "price covers the units",
    rule_id="price_per_unit",
    expression="l_extendedprice >= 1000 * l_quantity",
)
LINES_IN_ORDER = pl.SemanticRule(
    "lines_in_order",
    "temporal",
    ("l_shipdate",),
    "lines ship in order",
    rule_id="lines_in_order",
    key_columns=("l_orderkey",),
    order_columns=("l_linenumber",),
)
DESCRIBED = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")

CONFIG = pl.EvaluationConfig(
    dataset_name="dirty_lineitem",
    as_of_year=AS_OF,
    context=pl.UsageContext("wholesale", "delivery planning", "regression", ("ISO/IEC 5259",)),
    subjects=pl.Subjects(("suppliers", "customers")),
    syntactic_rules=[CONDITIONS[i][0] for i in RULE_IDS],
    semantic_rules=[checks.RETURNED_IS_FINAL, PRICE_PER_UNIT, SUPPLIER_KNOWN, LINES_IN_ORDER],
    metadata={
        "source_name": "order system",
        "collection_method": "export",
        "creation_date": "1996-05",
        "license": "internal",
        "source_url": " ",
    },
    label_col="l_returnflag",
    expected_classes=5,
    expected_ranges=[pl.ExpectedRange("l_extendedprice", 900, 105000)],
    dictionary=dict.fromkeys(DESCRIBED, "described"),
    order_by=("l_shipdate", "l_orderkey", "l_linenumber"),
    event_time="l_shipdate",
    short_years=6,
    long_years=8,
    thresholds={"value_completeness": 99.5},
    auto_priorities={"accuracy": 1, "completeness": 1, "diversity": 3},
    priorities={"diversity": 2, "credibility": 3, "currentness": 3},
)

_NUMBERS = [c for c, k in LINEITEM.items() if k == "number"]
_COLUMNS = len(LINEITEM)


def _pass(i: str) -> str:
    """The pass rate of a rule as an aggregate over dirty_lineitem."""
    _, failed, *tainted = CONDITIONS[i]
    count = f"count(CASE WHEN {failed} THEN 1 END)"
    broken = f"CASE WHEN {count} > 0 THEN count({tainted[0]}) ELSE 0 END" if tainted else count
    return f"(1 - ({broken}) * 1.0 / count(*))"


_RULED = ("l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_orderkey")
_SHAPE = " + ".join(
    f"CASE WHEN abs(skewness({c})) <= 2 AND abs(kurtosis({c})) <= 7 THEN 1 ELSE 0 END" for c in _NUMBERS
)
_OUT = " + ".join(
    f"count(CASE WHEN {c}_q3 <> {c}_q1 AND ({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)) THEN 1 END)"
    for c in _NUMBERS
)
_BAND = f"CASE WHEN {AS_OF} - year(l_shipdate) <= 6 THEN 100.0 WHEN {AS_OF} - year(l_shipdate) <= 8 THEN 50.0 ELSE 0.0 END"

# One SELECT each, so that every dimension can be read on its own.
_FACTS = f"""
WITH scan AS (SELECT count(*) AS n, {checks._NULL_CELLS} AS nulls, {checks._FULL} AS full_columns,
    count(CASE WHEN {checks._ALL_GIVEN} THEN 1 END) AS full_rows, count(l_returnflag) AS labelled,
    {' + '.join(f'count({c})' for c in _RULED)} AS ruled_cells, {' + '.join(f'count({c})' for c in _NUMBERS)} AS numeric_cells,
    ({' + '.join(_pass(i) for i in RULE_IDS)}) / {len(RULE_IDS)} AS syntactic,
    ({_pass('quantity_range')} + {_pass('discount_range')}) / 2 AS ranges,
    1 - count(CASE WHEN l_returnflag = 'R' AND NOT (l_linestatus = 'F') THEN 1 END) * 1.0 / count(*) AS returned_pass,
    1 - count(CASE WHEN NOT (l_extendedprice >= 1000 * l_quantity) THEN 1 END) * 1.0 / count(*) AS price_pass,
    1 - count(CASE WHEN l_extendedprice < 900 OR l_extendedprice > 105000 THEN 1 END) * 1.0 / count(*) AS expected_pass,
    CASE WHEN {_pass('key_type')} = 1 THEN 1 ELSE 0 END AS key_ok, CASE WHEN {_pass('flag_type')} = 1 THEN 1 ELSE 0 END AS flag_ok,
    {_SHAPE} AS plain, avg({_BAND}) AS band, count(CASE WHEN {_BAND} = 0 THEN 1 END) AS outdated
  FROM dirty_lineitem),
q AS (SELECT {checks._QUARTILES} FROM dirty_lineitem),
o AS (SELECT {_OUT} AS outliers FROM dirty_lineitem, q),
dup AS (SELECT sum(c - 1) AS extra FROM {checks._GROUPS}),
supp AS (SELECT count(CASE WHEN s_suppkey IS NULL THEN 1 END) AS orphans FROM dirty_lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
seq AS (SELECT count(CASE WHEN f < p THEN 1 END) AS late FROM (SELECT l_shipdate AS f, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS p FROM dirty_lineitem) AS w),
cls AS (SELECT l_returnflag, count(*) AS cnt FROM dirty_lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1),
lab AS (SELECT count(*) AS classes, sum(cnt) AS labels, min(cnt) AS least, max(cnt) AS most,
    sum(least(cnt, (SELECT avg(cnt) FROM cls))) AS covered, count(CASE WHEN cnt * 2 < (SELECT sum(cnt) FROM cls) THEN 1 END) AS small FROM cls),
{checks._halves_sql('dirty_lineitem', 'l_orderkey', 'l_shipdate, l_orderkey, l_linenumber').strip()},
comp AS ({checks._COMPONENTS}),
sem AS (SELECT returned_pass, price_pass, 1 - orphans * 1.0 / n AS supplier_pass, 1 - late * 1.0 / n AS line_pass FROM scan, supp, seq),
scored AS (SELECT
    100 * syntactic AS syntactic_accuracy,
    100 * (sem.returned_pass + sem.price_pass + supplier_pass + line_pass) / 4 AS semantic_accuracy,
    100.0 * ruled_cells / (n * {_COLUMNS}) AS data_accuracy_assurance,
    100 * (1 - outliers * 1.0 / numeric_cells) AS risk_of_inaccuracy,
    100 * ranges AS data_accuracy_range,
    100.0 * (key_ok + flag_ok) / 2 AS data_model_accuracy,
    100 * (1 - nulls * 1.0 / (n * {_COLUMNS})) AS value_completeness,
    100.0 * covered / labels AS value_occurrence_completeness,
    100.0 * full_columns / {_COLUMNS} AS feature_completeness,
    100.0 * full_rows / n AS record_completeness,
    100.0 * labelled / n AS label_completeness,
    100 * (1 - extra * 1.0 / n) AS data_record_consistency,
    100.0 * plain / {len(_NUMBERS)} AS distribution_of_data_values,
    100.0 AS data_format_consistency,
    100 * (sem.price_pass + supplier_pass + line_pass) / 3 AS semantic_consistency,
    100.0 * classes / 5 AS label_richness,
    100.0 * least / most AS relative_label_abundance,
    100.0 * small / classes AS category_size_diversity,
    comp.component_richness AS component_richness,
    100 * expected_pass AS value_credibility,
    100.0 * 4 / 7 AS source_credibility,
    100.0 * {len(DESCRIBED)} / {_COLUMNS} AS data_dictionary_credibility,
    100.0 * (key_ok + flag_ok + CASE WHEN supplier_pass = 1 THEN 1 ELSE 0 END) / 3 AS data_model_credibility,
    50.0 AS feature_currentness,
    band AS record_currentness,
    100 * (1 - outdated * 1.0 / n) AS records_in_date
  FROM scan, o, dup, lab, comp, sem),
"""


def _mark(dimension: str) -> float:
    return CONFIG.thresholds.get(dimension, CONFIG.default_threshold)


_DIMENSIONS = " UNION ALL ".join(
    f"SELECT '{c}' AS characteristic, '{d}' AS dimension, CAST({i} AS INTEGER) AS position, CAST({CONFIG.priority(c)} AS INTEGER) AS priority, "
    f"CAST({d} AS DOUBLE) AS score, {d} >= {_mark(d)} AS passed FROM scored"
    for c, dims in pl.plans.catalogue.DIMENSIONS.items()
    for i, d in enumerate(dims, 1)
)
_ORDER = {c: i for i, c in enumerate(pl.plans.catalogue.DIMENSIONS, 1)}
_RANK = "CASE characteristic " + " ".join(f"WHEN '{c}' THEN {i}" for c, i in _ORDER.items()) + " END"
_DIMS = f"{_FACTS.strip()} dims AS ({_DIMENSIONS})"
_CHARS = (
    f"{_DIMS}, chars AS (SELECT characteristic, min(priority) AS priority, avg(score) AS overall_score, count(score) AS dimensions_scored, "
    "printf('%.1f%% on average in %s', avg(score), characteristic) AS summary FROM dims GROUP BY characteristic) "
)


def _evaluate(spark: SparkSession, sf_dir: str) -> pl.Evaluation:
    return pl.evaluate(
        load(spark, sf_dir, "dirty_lineitem"), CONFIG, {"supplier": load(spark, sf_dir, "supplier")}
    )


def score_query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(_evaluate(spark, sf_dir)))
    if sql is not None:
        SQL[name] = with_view("dirty_lineitem", sql)


def _characteristics(e: pl.Evaluation) -> DataFrame:
    return pl.characteristic_scores(e.dimension_scores)


score_query(
    "dimension_scores",
    lambda e: e.dimension_scores.drop("explanation", "details"),
    f"{_DIMS} SELECT characteristic, dimension, position, priority, {r('score')} AS score, passed FROM dims",
)
score_query(
    "characteristic_scores",
    _characteristics,
    f"{_CHARS} SELECT characteristic, priority, {r('overall_score')} AS overall_score, {n('dimensions_scored')} AS dimensions_scored, summary FROM chars",
)
score_query(
    "overall_score",
    lambda e: pl.overall_score(_characteristics(e)),
    f"{_CHARS} SELECT {r('sum((4 - priority) * overall_score) / sum(4 - priority)')} AS overall_score, {n('count(*)')} AS characteristics_scored FROM chars",
)
score_query(
    "priorities",
    lambda e: pl.priority_table(e.facts.sparkSession, e.config).join(
        _characteristics(e).select("characteristic", "overall_score"), "characteristic"
    ),
    f"{_CHARS} SELECT characteristic, priority, CASE WHEN characteristic IN ('diversity', 'credibility', 'currentness') THEN 'user' "
    "WHEN characteristic IN ('accuracy', 'completeness') THEN 'suggested' ELSE 'default' END AS origin, "
    f"{r('overall_score')} AS overall_score FROM chars",
)
score_query(
    "score_table",
    lambda e: pl.score_table(_characteristics(e)),
    f"{_CHARS} SELECT characteristic, CAST({_RANK} AS INTEGER) AS position, priority, printf('%.1f%%', overall_score) AS score_text, summary FROM chars",
)
score_query(
    "dimension_table",
    lambda e: pl.dimension_table(e.dimension_scores).drop("explanation"),
    f"{_DIMS} SELECT characteristic, priority, dimension, position, printf('%.1f%%', score) AS score_text, "
    "CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status FROM dims",
)
score_query(
    "score_matrix",
    lambda e: pl.score_matrix(e.dimension_scores),
    f"{_DIMS} SELECT characteristic, "
    + ", ".join(f"{r(f'max(CASE WHEN position = {i} THEN score END)')} AS d{i}" for i in range(1, 7))
    + " FROM dims GROUP BY characteristic",
)
REQUIREMENTS = (("value_completeness", 98.0, 1), ("data_record_consistency", 99.5, 2), ("label_richness", 50.0, 3))
score_query(
    "requirements_check",
    lambda e: pl.check_requirements(
        e.dimension_scores,
        e.facts.sparkSession.createDataFrame(REQUIREMENTS, "dimension string, pass_threshold double, priority int"),
    ),
    f"{_DIMS}, req(dimension, pass_threshold, wanted) AS (VALUES "
    + ", ".join(f"('{d}', CAST({t} AS DOUBLE), {p})" for d, t, p in REQUIREMENTS)
    + f") SELECT characteristic, dimension, position, coalesce(wanted, priority) AS priority, {r('score')} AS score, "
    "coalesce(pass_threshold, 90.0::DOUBLE) AS pass_threshold, score >= coalesce(pass_threshold, 90.0) AS passed FROM dims LEFT JOIN req USING (dimension)",
)
score_query(
    "nested_scores",
    lambda e: pl.nested_scores(e.dimension_scores).select(
        "characteristic",
        "priority",
        "overall_score",
        F.array_join(F.transform("dimensions", lambda d: d.dimension), ",").alias("dimensions"),
    ),
    f"{_DIMS} SELECT characteristic, min(priority) AS priority, {r('avg(score)')} AS overall_score, "
    "string_agg(dimension, ',' ORDER BY position) AS dimensions FROM dims GROUP BY characteristic",
)
_INDICATORS = (
    "ind AS (SELECT dimension AS indicator, score, passed FROM dims UNION ALL SELECT 'informative_columns', 100.0, true UNION ALL "
    "SELECT 'records_in_date', records_in_date, records_in_date >= 90 FROM scored UNION ALL "
    "SELECT 'inaccurate_rows_identifiable', 100.0, true UNION ALL SELECT 'outdated_rows_identifiable', 100.0, true), "
)
_CLAUSES = "m(regulation, clause, indicator) AS (VALUES " + ", ".join(
    f"('{reg}', '{clause}', '{i}')"
    for (reg, clause), inputs in pl.plans.rollup.CLAUSES.items()
    for i in inputs
) + ") "
score_query(
    "compliance_matrix",
    pl.compliance_matrix,
    f"{_DIMS}, {_INDICATORS}{_CLAUSES} SELECT regulation, clause, {r('min(score)')} AS score, "
    "CASE WHEN bool_and(passed) THEN 'met' ELSE 'gap' END AS status FROM m JOIN ind USING (indicator) GROUP BY regulation, clause",
)
score_query(
    "recommendations",
    lambda e: pl.recommendations(e),
)
score_query(
    "recommended_dimensions",
    lambda e: pl.recommendations(e).select(
        "priority", "characteristic", "dimension", "position", "score", F.substring_index("recommendation", ";", 1).alias("advice")
    ),
    f"{_DIMS} SELECT priority, characteristic, dimension, position, {r('score')} AS score, "
    "'Raise ' || replace(dimension, '_', ' ') || ' from ' || printf('%.1f%%', score) AS advice FROM dims WHERE NOT passed",
)
score_query("report_lines", pl.report_lines)
score_query(
    "report_figures",
    lambda e: pl.report_lines(e)
    .where("text LIKE '### %' OR text LIKE '  * %'")
    .select(F.regexp_replace("text", "(PASS|FAIL): .*", "$1").alias("text")),
    f"{_DIMS} SELECT '### ' || upper(characteristic[1]) || characteristic[2:] || ': ' || printf('%.1f%%', avg(score)) || ' (priority ' || priority || ')' AS text "
    "FROM dims GROUP BY characteristic, priority UNION ALL "
    "SELECT '  * ' || dimension || ' ' || printf('%.1f%%', score) || ', ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END FROM dims WHERE score IS NOT NULL",
)
score_query("evaluation_rules", lambda e: e.rule_results)
_ROWS = [checks.rule_row(CONDITIONS[i][0], "dirty_lineitem", *CONDITIONS[i][1:]) for i in RULE_IDS]
_ROWS += [
    checks.rule_row(checks.RETURNED_IS_FINAL, "dirty_lineitem", "l_returnflag = 'R' AND NOT (l_linestatus = 'F')"),
    checks.rule_row(PRICE_PER_UNIT, "dirty_lineitem", "NOT (l_extendedprice >= 1000 * l_quantity)"),
    checks.rule_row(SUPPLIER_KNOWN, "dirty_lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey", "s_suppkey IS NULL"),
    checks._temporal_sql(LINES_IN_ORDER, "dirty_lineitem"),
]
SQL["evaluation_rules"] = with_view("dirty_lineitem", " UNION ALL ".join(_ROWS))
