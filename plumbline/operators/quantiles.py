"""Exact order statistics of many columns without sorting or one big buffer.

``percentile`` gathers every distinct value of a column in one task, and a
global ``row_number`` sorts the table in one task.  Here a KLL sketch brackets
each wanted rank.  One further scan counts the values inside the brackets one
by one and everything between them in bulk, which gives the exact rank of each
value in a bracket.  The sketch only decides how fast that goes: a rank that
falls between the brackets is looked for again where it fell.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.columns import chunks, normalise_missing, quoted, ref
from plumbline.functions.frames import HEAVY_COLUMNS_PER_STAGE, WIDE_COLUMNS, cells, local_frame

GATHER_LIMIT = 200_000
SKETCH_SIZE = 4096
SKETCH_MARGIN = 0.002


@dataclass(frozen=True)
class Ranked:
    """A value at a rank, with the rows below it and equal to it."""

    value: float
    below: int
    equal: int


@dataclass(frozen=True)
class Span:
    """A closed value range of one column that holds the wanted ranks."""

    column: str
    low: float
    high: float
    below: int
    rows: int
    ranks: tuple[int, ...]

    def inside(self, value: Column) -> Column:
        """The value, or NULL outside the range."""
        if (self.low, self.high) == (-math.inf, math.inf):
            return value
        return F.when((value >= F.lit(self.low)) & (value <= F.lit(self.high)), value)


def _one_row(df: DataFrame, metrics: Mapping[str, Column], per_stage: int) -> dict:
    """Collect named aggregates; stages are split to keep generated code small."""
    found: dict = {}
    for group in chunks(list(metrics), per_stage):
        found |= df.agg(*[metrics[k].alias(k) for k in group]).first().asDict()
    return found


def _brackets(values: DataFrame, spans: Sequence[Span]) -> list[list[tuple[float, float]]]:
    """Value ranges around the ranks of each span, from a sketch of the span."""
    probes = {}
    for i, s in enumerate(spans):
        shares = [(r - s.below + 0.5) / s.rows for r in s.ranks]
        probes[f"p{i}"] = bracket_bounds(s.inside(ref(s.column)), shares)
    found = _one_row(values, probes, HEAVY_COLUMNS_PER_STAGE * 2)
    return [bracket_pairs(found[f"p{i}"]) for i in range(len(spans))]


def bracket_bounds(value: Column, shares: Sequence[float]) -> Column:
    """An aggregate: the values a margin below and above each share of the rows."""
    bounds = [
        F.lit(min(1.0, max(0.0, s + side * SKETCH_MARGIN))) for s in shares for side in (-1, 1)
    ]
    # The sketch of no rows is empty, and an empty one has no quantiles.
    sketch = F.kll_sketch_agg_double(value, SKETCH_SIZE)
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*bounds)))


def bracket_pairs(bounds: Sequence[float]) -> list[tuple[float, float]]:
    return _disjoint(list(zip(bounds[::2], bounds[1::2], strict=True)))


def _disjoint(ranges: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Merge closed ranges that meet."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted(ranges):
        if merged and low <= math.nextafter(merged[-1][1], math.inf):
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def _count_pieces(
    values: DataFrame, spans: Sequence[Span], brackets: Sequence[Sequence[tuple[float, float]]]
) -> list[Span]:
    """Split spans at their brackets and keep the pieces that hold the ranks.

    Bounds of brackets become pieces of their own, which takes heavy values out.
    """
    cuts = [sorted({b for pair in pairs for b in pair}) for pairs in brackets]
    counts = {}
    for i, s in enumerate(spans):
        for j, cut in enumerate(cuts[i]):
            counts[f"lt{i}_{j}"] = F.count_if(ref(s.column) < F.lit(cut))
            counts[f"le{i}_{j}"] = F.count_if(ref(s.column) <= F.lit(cut))
    seen = _one_row(values, counts, HEAVY_COLUMNS_PER_STAGE * 8)

    narrowed: dict[tuple, Span] = {}
    for i, s in enumerate(spans):
        pieces, low, below = [], s.low, s.below
        for j, cut in enumerate(cuts[i]):
            lt, le = seen[f"lt{i}_{j}"], seen[f"le{i}_{j}"]
            pieces.append((low, math.nextafter(cut, -math.inf), below, lt - below))
            pieces.append((cut, cut, lt, le - lt))
            low, below = math.nextafter(cut, math.inf), le
        pieces.append((low, s.high, below, s.below + s.rows - below))
        for r in s.ranks:
            low, high, base, rows = next(p for p in pieces if p[2] <= r < p[2] + p[3])
            _add_rank(narrowed, Span(s.column, low, high, base, rows, (r,)))
    return list(narrowed.values())


def _add_rank(spans: dict[tuple, Span], new: Span) -> None:
    key = (new.column, new.low, new.high)
    old = spans.get(key, new)
    spans[key] = replace(new, ranks=tuple(sorted({*old.ranks, *new.ranks})))


def _folded(value: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """The value inside the ranges; between them the number right after the range before."""
    folded = F.when(value < F.lit(ranges[0][0]), F.lit(math.nextafter(ranges[0][0], -math.inf)))
    for i, (_, high) in enumerate(ranges):
        folded = folded.when(value <= F.lit(high), value)
        after = F.lit(math.nextafter(high, math.inf))
        folded = (
            folded.when(value < F.lit(ranges[i + 1][0]), after)
            if i + 1 < len(ranges)
            else folded.otherwise(F.when(value > F.lit(high), after))
        )
    return folded


RANGES = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("under", T.DoubleType()),
        T.StructField("lows", T.ArrayType(T.DoubleType())),
        T.StructField("highs", T.ArrayType(T.DoubleType())),
        T.StructField("after", T.ArrayType(T.DoubleType())),
    ]
)


def _folded_cells(values: DataFrame, ranges: Mapping[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """(c, v): ``_folded`` values of many columns, with the ranges as data."""
    rows = [
        {
            "pos": i,
            "under": math.nextafter(pairs[0][0], -math.inf),
            "lows": [low for low, _ in pairs],
            "highs": [high for _, high in pairs],
            "after": [math.nextafter(high, math.inf) for _, high in pairs],
        }
        for i, pairs in enumerate(ranges.values())
    ]
    long = cells(values, list(ranges)).where("value IS NOT NULL")
    known = long.join(F.broadcast(local_frame(values.sparkSession, rows, RANGES)), "pos")
    at = known.withColumn("i", F.expr("size(filter(lows, x -> x <= value)) - 1"))
    folded = "CASE WHEN i < 0 THEN under WHEN value <= highs[i] THEN value ELSE after[i] END"
    return at.select(F.col("pos").cast("string").alias("c"), F.expr(folded).alias("v"))


WANTED = T.StructType(
    [
        T.StructField("c", T.StringType()),
        T.StructField("rank", T.LongType()),
    ]
)


def _rank(
    values: DataFrame,
    ranges: Mapping[str, Sequence[tuple[float, float]]],
    ranks: Mapping[str, Sequence[int]],
) -> dict[tuple[str, int], Ranked]:
    """What stands at each rank once everything outside the ranges is folded.

    One scan for all columns.  Folded values are summed before the shuffle, so
    the window per column sees the values inside the ranges and little else.
    """
    columns = list(ranges)
    if len(columns) > WIDE_COLUMNS:
        long = _folded_cells(values, ranges)
    else:
        folded = values.select(
            *[_folded(ref(c), ranges[c]).alias(str(i)) for i, c in enumerate(columns)]
        )
        if len(columns) > 1:
            long = folded.unpivot([], [ref(n) for n in folded.columns], "c", "v")
        else:
            long = folded.select(F.lit("0").alias("c"), ref("0").alias("v"))
    counted = long.filter("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("cnt"))
    upto = F.sum("cnt").over(
        Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    )
    wanted = local_frame(
        values.sparkSession,
        [{"c": str(i), "rank": r} for i, c in enumerate(columns) for r in ranks[c]],
        WANTED,
    )
    hits = (
        counted.withColumn("upto", upto)
        # One row per column and rank, so broadcasting these is safe at any scale.
        .join(F.broadcast(wanted), "c")
        .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("cnt")))
        .collect()
    )
    return {(columns[int(h.c)], h["rank"]): Ranked(h.v, h.upto - h.cnt, h.cnt) for h in hits}


def values_at_ranks(
    values: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
    gather_limit: int = GATHER_LIMIT,
    first_brackets: Mapping[str, Sequence[tuple[float, float]]] | None = None,
) -> dict[tuple[str, int], Ranked]:
    """The values at 0-based ranks of DOUBLE columns, NULLs left out.

    ``counts`` holds the non-null rows of each column.  Only bounds and counts,
    a few per rank, reach the driver.  Brackets are narrowed until about
    ``gather_limit`` rows per rank are left for one task to go through.
    ``first_brackets`` spares the first sketch where it has been taken before.
    """
    spans = [
        Span(c, -math.inf, math.inf, 0, counts[c], tuple(sorted(set(rs))))
        for c, rs in ranks.items()
        if rs and counts[c]
    ]
    found: dict[tuple[str, int], Ranked] = {}
    while spans:
        wide = [s for s in spans if s.rows > gather_limit]
        if wide:
            if first_brackets is None:
                brackets = _brackets(values, wide)
            else:
                brackets = [first_brackets[s.column] for s in wide]
                first_brackets = None
            if any(s.rows * 4 * SKETCH_MARGIN > gather_limit for s in wide):
                spans = [s for s in spans if s not in wide] + _count_pieces(values, wide, brackets)
                found |= {
                    (s.column, r): Ranked(s.low, s.below, s.rows)
                    for s in spans
                    if s.low == s.high
                    for r in s.ranks
                }
                spans = [s for s in spans if s.low != s.high]
                continue
        ranges: dict[str, list[tuple[float, float]]] = {}
        for s in spans:
            ranges.setdefault(s.column, []).extend(
                brackets[wide.index(s)] if s in wide else [(s.low, s.high)]
            )
        ranges = {c: _disjoint(pairs) for c, pairs in ranges.items()}
        open_ranks = {c: [r for s in spans if s.column == c for r in s.ranks] for c in ranges}
        missed: dict[tuple, Span] = {}
        for (c, r), hit in _rank(values, ranges, open_ranks).items():
            if any(low <= hit.value <= high for low, high in ranges[c]):
                found[c, r] = hit
                continue
            low = max((h for _, h in ranges[c] if h < hit.value), default=-math.inf)
            high = min((lo for lo, _ in ranges[c] if lo > hit.value), default=math.inf)
            gap = (math.nextafter(low, math.inf), math.nextafter(high, -math.inf))
            _add_rank(missed, Span(c, *gap, hit.below, hit.equal, (r,)))
        spans = list(missed.values())
    return found


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    counts: Mapping[str, int] | None = None,
    gather_limit: int = GATHER_LIMIT,
    approx: bool = False,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, one list per column.

    ``approx`` trades exactness for one scan and returns sample values.
    """
    if not columns:
        return {}
    # Adding 0.0 turns -0.0 into 0.0, so that both rank as one value.
    doubles = normalise_missing(df).selectExpr(
        *[f"CAST({quoted(c)} AS double) + 0D AS {quoted(c)}" for c in columns]
    )
    if approx:
        row = _one_row(
            doubles,
            {f"q{i}": F.percentile_approx(ref(c), list(probabilities)) for i, c in enumerate(columns)},
            HEAVY_COLUMNS_PER_STAGE,
        )
        return {
            c: list(row[f"q{i}"] or [None] * len(probabilities)) for i, c in enumerate(columns)
        }
    brackets = None
    if counts is None and len(columns) > WIDE_COLUMNS:
        found = cells(doubles, columns).groupBy("pos").agg(F.count("value").alias("n"), bracket_bounds(F.col("value"), probabilities).alias("b"))
        rows = {columns[r["pos"]]: r for r in found.collect()}
        counts = {c: rows[c]["n"] if c in rows else 0 for c in columns}
        brackets = {c: bracket_pairs(rows[c]["b"]) for c in columns if counts[c]}
    elif counts is None:
        # One scan gives the counts and the sketch of all columns.
        row = _one_row(
            doubles,
            {f"n{i}": F.count(ref(c)) for i, c in enumerate(columns)}
            | {f"b{i}": bracket_bounds(ref(c), probabilities) for i, c in enumerate(columns)},
            HEAVY_COLUMNS_PER_STAGE * 8,
        )
        counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
        brackets = {
            c: bracket_pairs(row[f"b{i}"]) for i, c in enumerate(columns) if row[f"b{i}"]
        }
    wanted = {
        c: [r for p in probabilities for h in [(counts[c] - 1) * p] for r in (math.floor(h), math.ceil(h))]
        for c in columns
        if counts[c]
    }
    found = values_at_ranks(doubles, wanted, counts, gather_limit, brackets)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        result[c] = []
        for p in probabilities:
            if not counts[c]:
                result[c].append(None)
                continue
            h = (counts[c] - 1) * p
            a, b = found[c, math.floor(h)].value, found[c, math.ceil(h)].value
            result[c].append(a if a == b else a + (b - a) * (h - math.floor(h)))
    return result
