"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

import plumbline as pl
from workloads import checks, scores  # noqa: F401
from workloads.tables import load

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def headline(spark: SparkSession) -> dict:
    lineitem = load(spark, SF_DIR, "lineitem")
    numeric = pl.numeric_columns(lineitem)
    one_rule = checks.ALL_RULES[:1]
    twenty = [
        pl.SyntacticRule(c, kind, spec, rule_id=f"{kind}:{c}")
        for c in numeric
        for kind, spec in (("range", {"min": 0, "max": 1000}), ("not_null", True))
    ] + [
        pl.SyntacticRule("l_returnflag", "enum", ["A", "N"], rule_id="enum"),
        pl.SyntacticRule("l_returnflag", "format", "[A-Z]$", rule_id="format"),
        pl.SyntacticRule("l_linestatus", "length", {"max": 1}, rule_id="length"),
        pl.SyntacticRule("l_linestatus", "dtype", "int64", rule_id="dtype"),
    ]
    registered = checks.QUERIES
    return {
        "distinct_counts_11": lambda: pl.unique_counts(lineitem),
        "frequency_table_11": lambda: pl.value_frequency(lineitem).groupBy("column_name").count(),
        "exact_quartiles_8": lambda: spark.createDataFrame(
            [(c, *q) for c, q in pl.quantiles(lineitem, numeric).items()]
        ),
        "approx_quartiles_8": lambda: spark.createDataFrame(
            [(c, *q) for c, q in pl.quantiles(lineitem, numeric, approx=True).items()]
        ),
        "duplicate_rows_exact": lambda: pl.duplicate_rows(lineitem),
        "duplicate_rows_digest": lambda: pl.duplicate_rows(lineitem, digest=True),
        "rules_1": lambda: pl.check_rules(lineitem, one_rule),
        "rules_20": lambda: pl.check_rules(lineitem, twenty),
        "column_profile": lambda: pl.column_profile(lineitem),
        **{
            name: lambda name=name: registered[name](spark, SF_DIR)
            for name in (
                "null_profile",
                "value_completeness",
                "distribution_stats",
                "iqr_outliers",
                "top_values",
                "rule_results",
                "mixed_type_columns",
                "duplicate_documents",
                "semantic_cross_field",
                "semantic_temporal",
                "semantic_temporal_hot_key",
                "semantic_referential",
                "trend_component",
                "windowed_quality",
                "suggest_rules",
                "dimension_scores",
            )
        },
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in headline(spark).items():
        # The first run warms the JVM up, the better of two counts.
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            query().collect()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
