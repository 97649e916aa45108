"""Connected components of a graph given by its edges, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.shared import written


def _mark(edges: DataFrame) -> tuple:
    """Number and hash sum of the edges; equal for equal sets of edges."""
    mixed = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def _hook(pairs: DataFrame) -> DataFrame:
    """Join every (a, b) with the smallest of a and its neighbours b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node.  Columns: node, root.

    ``edges`` has long columns ``a`` and ``b``.  Large-star and small-star steps
    alternate until nothing changes; a hub is summed before the shuffle and its
    rows are joined, so that Spark may split them.  Edges from a node to itself
    are ignored; no edges give no rows.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hook(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        hooked = _hook(large)
        small = hooked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            hooked.select("a", F.col("m").alias("b"))
        )
        edges = written(small.distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
