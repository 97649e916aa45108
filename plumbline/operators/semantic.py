"""Semantic rules: cross-field, conditional, temporal and referential."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.columns import TEMPORAL_TYPES, dtype_of, normalise_missing, ref, require_columns
from plumbline.functions.frames import local_frame, union_all
from plumbline.operators.frequency import unique_counts
from plumbline.operators.profile import null_profile
from plumbline.operators.rules import (
    RULE_RESULTS,
    as_semantic,
    compile_row_rule,
    count_isolated,
    rule_ids,
    violating_rows,
    with_rates,
)
from plumbline.session import durable_folder
from plumbline.sources.rules import SemanticRule

ROW_RULES = ("cross_field", "domain_logic")
RANGE_PARTITIONS = "spark.sql.shuffle.partitions"


def _result(counted: DataFrame, rule: SemanticRule, rule_id: str) -> DataFrame:
    return with_rates(
        counted.select(
            F.lit(rule_id).alias("rule_id"),
            F.lit(",".join(rule.fields_involved)).alias("field"),
            F.lit(rule.rule_type).alias("rule_type"),
            F.lit("ok").alias("status"),
            F.col("violations").alias("failed_values"),
            F.col("violations"),
            F.col("total"),
            F.lit(rule.description).alias("description"),
        )
    )


def _compared_positions(
    df: DataFrame,
    field: str,
    key_columns: Sequence[str],
    order_columns: Sequence[str],
    partitions: int | None,
) -> tuple[DataFrame, list[str], list[str]]:
    """Distinct (key, order, field) of complete rows, with ``part`` and whether the one before is above.

    A window partitioned by the key would put a hot key into one task.  Equal
    positions never break the order, so they are merged, before the shuffle as
    well; range partitioning then spreads a hot key over many tasks, and the
    positions are compared inside each partition.
    """
    n = partitions or int(df.sparkSession.conf.get(RANGE_PARTITIONS))
    keys = [ref(c).alias(f"key{i}") for i, c in enumerate(key_columns)]
    orders = [ref(c).alias(f"order{i}") for i, c in enumerate(order_columns)]
    key_names = [f"key{i}" for i in range(len(keys))]
    names = key_names + [f"order{i}" for i in range(len(orders))] + ["field"]
    rows = normalise_missing(df).select(*keys, *orders, ref(field).alias("field"))
    complete = reduce(and_, [F.col(c).isNotNull() for c in names])
    ranged = (
        rows.filter(complete)
        .distinct()
        .repartitionByRange(n, *names)
        .withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part").orderBy(*names)
    follows = reduce(and_, [F.lag(k).over(inside) == F.col(k) for k in key_names], F.lit(True))
    compared = ranged.withColumn("broken", follows & (F.col("field") < F.lag("field").over(inside)))
    return compared, key_names, names


def _seams(compared: DataFrame, key_names: list[str], names: list[str]) -> DataFrame:
    """Per partition: ``broken`` inside of it, its first position, and ``seam``: whether that one is below the last before.

    The window sees one row per partition.
    """
    position = F.struct(*names)
    parts = compared.groupBy("part").agg(
        F.count_if(F.col("broken")).alias("broken"),
        F.min(position).alias("head"),
        F.max(position).alias("tail"),
    )
    previous = F.lag("tail").over(Window.partitionBy().orderBy("part"))
    same_key = reduce(and_, [previous[k] == F.col("head")[k] for k in key_names], F.lit(True))
    below = same_key & (F.col("head")["field"] < previous["field"])
    return parts.select("broken", "head", F.coalesce(below, F.lit(False)).alias("seam"))


# Buckets for each task that a hot key is cut into along its order, the most of them, items that a sketch of keys holds,
# and rows for one that sketches see.
BUCKETS, MOST_BUCKETS, SKETCHED, SEEN = 2, 512, 4096, 8
# Most keys that are cut; with as many, each has less than its share of a task.
MOST_HOT = 10_000


@dataclass(frozen=True)
class _Layout:
    """What one scan tells about the rows of a temporal rule."""

    total: int
    hot: list[int]  # hashes of keys with more rows than a task should get
    bounds: list[float]  # of buckets along the first order column
    repeated: bool  # a position that many rows share


def _place(df: DataFrame, name: str) -> Column:
    """A number that never falls where the column rises; text by its first bytes."""
    dtype, value = dtype_of(df, name), ref(name)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # Not by an instant, as a zone may put its clocks forward.
        day = F.unix_date(value.cast("date")).cast("double") * 86400
        return day + F.hour(value) * 3600 + F.minute(value) * 60 + F.date_part(F.lit("SECOND"), value).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        padded = F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0")
        return F.conv(padded, 16, 10).cast("double")
    return F.lit(0.0)


def _layout(rows: DataFrame, key: Column, position: Column, place: Column, complete: Column, parts: int) -> _Layout:
    rows = rows.withColumn("seen", complete & (F.monotonically_increasing_id() % SEEN == 0))

    def heavy(value: Column) -> Column:
        return F.call_function("approx_top_k", F.when(F.col("seen"), value), F.lit(min(4 * parts, MOST_HOT)), F.lit(min(max(SKETCHED, 16 * parts), 16 * MOST_HOT)))

    buckets = min(BUCKETS * parts, MOST_BUCKETS)
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)] or [F.lit(0.5)])
    sketch = F.kll_sketch_agg_double(F.when(F.col("seen"), place), 400)
    seen = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("seen").alias("seen"),
        heavy(key).alias("keys"),
        heavy(position).alias("positions"),
        F.when(F.count_if(F.col("seen") & place.isNotNull()) > 0, F.kll_sketch_get_quantile_double(sketch, shares)).alias("bounds"),
    ).first()
    least = seen["seen"] / (4 * parts)
    hot = [x["item"] for x in seen["keys"] if x["item"] is not None and x["count"] > least]
    repeated = any(x["item"] is not None and x["count"] > least for x in seen["positions"])
    bounds = sorted({x for x in seen["bounds"] or () if math.isfinite(x)})
    return _Layout(seen["total"], hot, bounds, repeated)


def temporal_violations(
    df: DataFrame,
    field: str,
    key_columns: Sequence[str],
    order_columns: Sequence[str],
    partitions: int | None = None,
) -> DataFrame:
    """Rows whose field is below that of the row before it within its key.

    Rows without a key, order or field value are not compared.  Ties in the
    order are ordered by the field, so of rows equal in all three the first can
    break the order at most.  ``partitions`` is the number of tasks to share the
    rows, by default that of shuffle partitions.

    Rows are shuffled once, by key and bucket.  Only hot keys, which a sketch
    finds, have several buckets; their bounds along the order are those of another
    sketch.  Both only decide where rows go.  Inside a bucket, the least field of an
    order is compared with the greatest of the order before, and buckets are
    compared on one row each.  Where many rows share one position, they are merged
    before that shuffle.
    """
    n = partitions or int(df.sparkSession.conf.get(RANGE_PARTITIONS))
    keys = [f"key{i}" for i in range(len(key_columns))]
    orders = [f"order{i}" for i in range(len(order_columns))]
    clean = normalise_missing(df)
    named = zip([*key_columns, *order_columns, field], [*keys, *orders, "field"])
    rows = clean.select(*[ref(c).alias(name) for c, name in named])
    complete = reduce(and_, [F.col(c).isNotNull() for c in rows.columns])
    key, place = F.xxhash64(*keys), _place(rows, "order0")
    layout = _layout(rows, key, F.xxhash64(*keys, *orders), place, complete, n)
    shared, cut = rows.filter(complete), keys
    if layout.hot and layout.bounds:
        bounds = F.array(*map(F.lit, layout.bounds))
        bucket = F.when(key.isin(layout.hot), 1 + F.size(F.filter(bounds, lambda x: x <= place))).otherwise(0)
        shared, cut = shared.withColumn("bucket", bucket), [*keys, "bucket"]
    least, greatest = F.min("field").alias("least"), F.max("field").alias("greatest")
    if layout.repeated:
        shared = shared.groupBy(*cut, *orders).agg(least, greatest).repartition(n, *cut)
    else:
        shared = shared.repartition(n, *cut).groupBy(*cut, *orders).agg(least, greatest)
    window = Window.partitionBy(*cut).orderBy(*orders)
    compared = shared.withColumns({"before": F.lag("greatest").over(window), "after": F.lead("least").over(window)})
    total, broken = F.lit(layout.total).cast("bigint").alias("total"), F.coalesce(F.col("least") < F.col("before"), F.lit(False))
    if cut == keys:
        return compared.agg(F.count_if(broken).alias("violations")).select("violations", total)
    # The ends of buckets: a bounded number of hot keys has a bounded number of them.
    bounded = F.col("bucket") > 0
    head, tail = bounded & F.col("before").isNull(), bounded & F.col("after").isNull()
    found = compared.where(broken | head | tail).agg(
        F.count_if(broken).alias("broken"),
        _ends(head, keys, "least").alias("heads"),
        _ends(tail, keys, "greatest").alias("tails"),
    )

    def below(x: Column, i: Column) -> Column:
        previous = F.get("tails", i - 1)
        return (x["key"] == previous["key"]) & (x["least"] < previous["greatest"])

    violations = F.col("broken") + F.size(F.filter("heads", below))
    return found.select(violations.cast("bigint").alias("violations"), total)


def _ends(chosen: Column, keys: Sequence[str], field: str) -> Column:
    """An aggregate: (key, bucket, field) of the chosen rows in order."""
    return F.array_sort(F.collect_list(F.when(chosen, F.struct(F.struct(*keys).alias("key"), "bucket", field))))


def temporal_violating_rows(
    df: DataFrame,
    field: str,
    key_columns: Sequence[str],
    order_columns: Sequence[str],
    partitions: int | None = None,
) -> DataFrame:
    """The later rows of each break, as stored; rows equal in key, order and field come together.

    The compared positions are written to the shared folder first, as ranges
    that are drawn twice need not be the same.
    """
    compared, key_names, names = _compared_positions(df, field, key_columns, order_columns, partitions)
    path = durable_folder(df.sparkSession, "positions")
    compared.write.parquet(path)
    kept = df.sparkSession.read.schema(compared.schema).parquet(path)
    heads = _seams(kept, key_names, names).filter("seam").select("head.*")
    broken = kept.filter("broken").select(*names).unionByName(heads)
    columns = [*key_columns, *order_columns, field]
    same = reduce(and_, [ref(c) == F.col(f"broken.{n}") for c, n in zip(columns, names, strict=True)])
    return df.join(broken.alias("broken"), same, "left_semi")


def referential_violating_rows(
    df: DataFrame,
    fields: Sequence[str],
    reference: DataFrame,
    ref_columns: Sequence[str],
) -> DataFrame:
    """Rows whose non-null field values do not occur in the reference table, as stored.

    Only the distinct unknown values are joined back to the rows.
    """
    names = [f"key{i}" for i in range(len(fields))]
    given = (
        normalise_missing(df)
        .select(*[ref(f).alias(n) for f, n in zip(fields, names, strict=True)])
        .dropna()
        .distinct()
    )
    known = normalise_missing(reference).select(
        *[ref(c).alias(n) for c, n in zip(ref_columns, names, strict=True)]
    )
    unknown = given.join(known, names, "left_anti")
    same = reduce(and_, [ref(f) == F.col(f"unknown.{n}") for f, n in zip(fields, names, strict=True)])
    return df.join(unknown.alias("unknown"), same, "left_semi")


def _comparable(one: T.DataType, other: T.DataType) -> bool:
    """Whether values of both types can be equal without a cast of text."""
    kinds = (T.NumericType, T.StringType, T.BooleanType, TEMPORAL_TYPES)
    return one == other or any(isinstance(one, k) and isinstance(other, k) for k in kinds)


def referential_violations(
    df: DataFrame,
    fields: Sequence[str],
    reference: DataFrame,
    ref_columns: Sequence[str],
) -> DataFrame:
    """Rows whose non-null field values do not occur in the reference table.

    The fields are counted per value before the join, so a hot value enters it
    as one row, and the join reuses the partitioning of the count.
    """
    names = [f"key{i}" for i in range(len(fields))]
    counted = (
        normalise_missing(df)
        .groupBy(*[ref(f).alias(n) for f, n in zip(fields, names, strict=True)])
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    known = (
        normalise_missing(reference)
        .select(*[ref(c).alias(n) for c, n in zip(ref_columns, names, strict=True)])
        .distinct()
        .withColumn("known", F.lit(True))
    )
    given = reduce(and_, [F.col(n).isNotNull() for n in names])
    return counted.join(known, names, "left").agg(
        F.coalesce(F.sum(F.when(given & F.col("known").isNull(), F.col("cnt"))), F.lit(0))
        .cast("bigint")
        .alias("violations"),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total"),
    )


def _same_kinds(
    df: DataFrame, fields: Sequence[str], reference: DataFrame, columns: Sequence[str]
) -> bool:
    return len(fields) == len(columns) and all(
        _comparable(dtype_of(df, f), dtype_of(reference, c))
        for f, c in zip(fields, columns, strict=True)
    )


def _not_run(df: DataFrame, rule: SemanticRule, rule_id: str, status: str) -> DataFrame:
    row = {
        "rule_id": rule_id,
        "field": ",".join(rule.fields_involved),
        "rule_type": rule.rule_type,
        "status": status,
        "description": rule.description,
    }
    return local_frame(df.sparkSession, [row], RULE_RESULTS)


def check_semantic_rules(
    df: DataFrame,
    rules: DataFrame | Sequence[SemanticRule],
    tables: Mapping[str, DataFrame] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Violations of semantic rules, one row per rule, in the form of syntactic results.

    Row-level rules share one scan, which is run at once; each temporal or referential rule adds its
    own shuffles.  ``partitions`` is the number of ranges of temporal rules.
    """
    listed, tables = as_semantic(rules), tables or {}
    clean = normalise_missing(df)
    row_level, parts = [], []
    for rule, rule_id in zip(listed, rule_ids(listed, "S"), strict=True):
        needed = (*rule.fields_involved, *rule.key_columns, *rule.order_columns)
        if rule.rule_type in ROW_RULES:
            row_level.append(compile_row_rule(clean, rule, rule_id))
        elif any(c not in df.columns for c in needed):
            parts.append(_not_run(df, rule, rule_id, "column_missing"))
        elif rule.rule_type == "temporal" and rule.key_columns and rule.order_columns:
            counted = temporal_violations(
                clean, rule.fields_involved[0], rule.key_columns, rule.order_columns, partitions
            )
            parts.append(_result(counted, rule, rule_id))
        elif rule.rule_type == "referential" and rule.ref_table in tables:
            reference = tables[rule.ref_table]
            targets = rule.ref_columns or rule.fields_involved
            if any(c not in reference.columns for c in targets):
                parts.append(_not_run(df, rule, rule_id, "column_missing"))
            elif not _same_kinds(df, rule.fields_involved, reference, targets):
                parts.append(_not_run(df, rule, rule_id, "type_mismatch"))
            else:
                counted = referential_violations(clean, rule.fields_involved, reference, targets)
                parts.append(_result(counted, rule, rule_id))
        else:
            parts.append(_not_run(df, rule, rule_id, "unsupported_rule"))
    if row_level or not parts:
        rows = count_isolated(clean, row_level)
        parts.insert(0, local_frame(df.sparkSession, rows, RULE_RESULTS))
    return union_all(parts)


def violating_semantic_rows(
    df: DataFrame,
    rule: SemanticRule,
    tables: Mapping[str, DataFrame] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Rows that break one semantic rule of any type, as stored.  A rule that cannot run raises."""
    tables = tables or {}
    if rule.rule_type in ROW_RULES:
        return violating_rows(df, row_rules=[rule]).select(*[ref(c) for c in df.columns])
    require_columns(df, (*rule.fields_involved, *rule.key_columns, *rule.order_columns))
    if rule.rule_type == "temporal" and rule.key_columns and rule.order_columns:
        return temporal_violating_rows(
            df, rule.fields_involved[0], rule.key_columns, rule.order_columns, partitions
        )
    if rule.rule_type == "referential" and rule.ref_table in tables:
        reference, targets = tables[rule.ref_table], rule.ref_columns or rule.fields_involved
        require_columns(reference, targets)
        if not _same_kinds(df, rule.fields_involved, reference, targets):
            raise ValueError(f"types of {', '.join(rule.fields_involved)} and {', '.join(targets)} differ")
        return referential_violating_rows(df, rule.fields_involved, reference, targets)
    raise ValueError(f"rule cannot run: {rule.name}")


FIELD_LINKS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("column_name", T.StringType()),
    ]
)


def semantic_field_stats(
    df: DataFrame,
    rules: DataFrame | Sequence[SemanticRule],
    order_by: Sequence[str],
    k: int = 5,
) -> DataFrame:
    """Type, missing rate, distinct values and first k values of each involved field.

    Fields that do not exist drop out.  The first values are by the given order.
    """
    listed = as_semantic(rules)
    fields = list(
        dict.fromkeys(f for r in listed for f in r.fields_involved if f in df.columns)
    )
    links = local_frame(
        df.sparkSession,
        [
            {"name": r.name, "rule_type": r.rule_type, "column_name": f}
            for r in listed
            for f in r.fields_involved
        ],
        FIELD_LINKS,
    )
    clean = normalise_missing(df)
    types = dict(df.dtypes)
    samples = union_all(
        [
            clean.filter(ref(f).isNotNull())
            .orderBy(*[ref(c) for c in order_by])
            .limit(k)
            .select(
                F.lit(f).alias("column_name"),
                F.lit(types[f]).alias("data_type"),
                F.struct(*[ref(c).alias(f"o{i}") for i, c in enumerate(order_by)]).alias("position"),
                ref(f).cast("string").alias("value"),
            )
            .groupBy("column_name", "data_type")
            .agg(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s.value
                ).alias("sample")
            )
            for f in fields
        ]
    )
    return (
        links.join(null_profile(df, fields), "column_name")
        .join(unique_counts(df, fields), "column_name")
        .join(samples, "column_name", "left")
        .select("name", "rule_type", F.col("column_name").alias("field"), "data_type", "null_rate", "unique_count", "sample")
    )
