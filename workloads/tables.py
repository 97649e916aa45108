"""The given tables, and views of them that have defects to find.

The view text runs unchanged in Spark and as a CTE in other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

VIEWS = {
    "dirty_lineitem": """
WITH base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN l_partkey % 23 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice,
         CASE WHEN l_orderkey % 41 = 0 THEN -l_discount - 0.01 ELSE l_discount END AS l_discount,
         CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 101 = 0""",
    "dirty_orders": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 37 = 0 THEN o_custkey + 10000000 WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 19 = 0 THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS o_orderpriority
FROM orders""",
    "labeled_documents": """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality AS label, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "imbalanced_embeddings": """
SELECT vec_id, CASE WHEN label >= 3 AND vec_id % 5 <> 0 THEN label % 3 ELSE label END AS label FROM embeddings""",
    "mixed_values": """
SELECT doc_id, lang,
       CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR(20)) WHEN doc_id % 7 = 0 THEN '2024-01-15' WHEN doc_id % 3 = 0 THEN 'true' ELSE source END AS mixed,
       source AS clean
FROM documents""",
    "nan_events": """
SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_id % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 70 = 0 THEN NULL ELSE value END AS value
FROM events""",
    "document_features": """
SELECT doc_id, lang, source, n_chars FROM documents""",
    "padded_orders": """
SELECT o_orderkey, o_orderstatus, 'EUR' AS currency, CAST(NULL AS DOUBLE) AS rebate, 1 AS version,
       CASE WHEN o_orderkey % 2 = 0 THEN 'yes' END AS flag
FROM orders""",
    "shipped_orders": """
SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "customer_metadata": """
SELECT o_custkey,
       CASE WHEN o_custkey % 13 = 0 THEN 'unknown' ELSE concat(first_year, '-03') END AS creation_date,
       CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 5 = 0 THEN 'n/a' WHEN o_custkey % 3 = 0 THEN NULL ELSE last_year END AS last_updated,
       CASE WHEN o_custkey % 17 = 0 THEN 'unknown' WHEN o_custkey % 19 = 0 THEN concat('about ', first_year)
            WHEN o_custkey % 6 = 0 THEN concat(first_year, '-01-', last_year, '-05')
            WHEN o_custkey % 4 = 0 THEN first_year ELSE concat(first_year, ' - ', last_year) END AS feature_collection_period
FROM (SELECT o_custkey, CAST(year(min(o_orderdate)) AS VARCHAR(4)) AS first_year, CAST(year(max(o_orderdate)) AS VARCHAR(4)) AS last_year
      FROM orders GROUP BY o_custkey) AS spans""",
}

# Columns of the views, for SQL that is built column by column.
LINEITEM = {
    "l_orderkey": "number",
    "l_linenumber": "number",
    "l_partkey": "number",
    "l_suppkey": "number",
    "l_quantity": "number",
    "l_extendedprice": "number",
    "l_discount": "number",
    "l_returnflag": "text",
    "l_linestatus": "text",
    "l_shipdate": "time",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for base in BASE:
        if base in text:
            load(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(text)


def with_view(name: str, select: str) -> str:
    """SQL text with the view as a CTE in front."""
    rest = select.strip()
    joint = ", " + rest[5:] if rest.upper().startswith("WITH ") else " " + rest
    return f"WITH {name} AS ({VIEWS[name].strip()}){joint}"
