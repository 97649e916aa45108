"""A Merkle manifest of a table: digests of rows, of groups and of the whole, and a proof for every row.

The rows of a group are numbered in their order by one range sort, which spreads
a large group over all tasks.  Runs of 16 nodes have a parent.  Two levels are
made in one pass of windows over blocks of 256 nodes: at each level, lag and lead
columns at fixed offsets, masked by the slot in the run and by the run's length,
hold a node's siblings, and the row of a run's first child hashes the parent.
The tops of the blocks are the nodes of the next pass, so that no window holds
more than 256 rows; the groups' tops are numbered and go through the same passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.shared import written

#: Nodes of a run, levels made in one pass, and nodes of a block.
RUN, LEVELS = 16, 2
BLOCK = RUN**LEVELS
#: Starts of groups in partitions are broadcast up to this number of rows, and joined beyond it.
BROADCAST_ROWS = 50_000
_NO_PATH = "cast(array() AS array<struct<left:string,right:string>>)"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of values: ``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = [c.cast("string") for c in columns]
    return digest(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text])


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf upwards, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Adds ``pos`` within ``g`` by ``order``, and ``n``, the rows of ``g``; the largest ``n``.

    Rows that are equal in ``g`` and ``order`` are told apart by their place, so that
    any number of them spreads over partitions.
    """
    spread = df.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("g", *order, "salt")
    sorted_rows = spread.sortWithinPartitions("g", *order, "salt").drop("salt").withColumn("at", F.monotonically_increasing_id())
    placed = written(sorted_rows, f"{name}-sorted").withColumn("part", F.shiftright("at", 33))
    counted = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    group = Window.partitionBy("g")
    starts = written(
        counted.select(
            "g",
            "part",
            (F.sum("k").over(group.orderBy("part")) - F.col("k") - F.col("first")).alias("shift"),
            F.sum("k").over(group).alias("n"),
        ),
        f"{name}-starts",
    )
    rows, most = starts.agg(F.count("*"), F.max("n")).first()
    joined = placed.join(F.broadcast(starts) if rows <= BROADCAST_ROWS else starts, ["g", "part"])
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"), most or 0


_OVER = "OVER (PARTITION BY g, block ORDER BY pos)"


def _level(nodes: DataFrame, level: int) -> DataFrame:
    """Siblings of the level's nodes on all rows below them as a step of ``path``, and ``h`` of their parents.

    ``h`` is the digest of the level's node on the row of its first leaf, null on others.
    """
    step, others = RUN**level, [c for c in nodes.columns if c not in ("h", "path")]
    node, count = f"pos DIV {step}", f"((n + {step - 1}) DIV {step})"
    near = nodes.selectExpr(
        "*",
        *(f"lag(h, {k * step}) {_OVER} AS lag{k}" for k in range(1, RUN)),
        *(f"lead(h, {k * step}) {_OVER} AS lead{k}" for k in range(1, RUN)),
        f"({node}) % {RUN} AS slot",
        f"least({RUN}, {count} - ({node}) + ({node}) % {RUN}) AS length",
        f"{count} > 1 AS many",
        f"pos % {step} = 0 AS first",
    )
    left = ", ".join(f"IF(slot >= {k}, lag{k}, '')" for k in range(RUN - 1, 0, -1))
    right = ", ".join(f"IF(slot + {k} < length, lead{k}, '')" for k in range(1, RUN))
    found = near.selectExpr(*others, "h", "path", "slot", "many", "first", f"IF(first, concat({left}), NULL) AS left", f"IF(first, concat({right}), NULL) AS right")
    # A lone node has no parent but itself, and so no step on the path.
    fill = (lambda c: f"last({c}, true) OVER (PARTITION BY g, block ORDER BY pos ROWS UNBOUNDED PRECEDING)") if level else (lambda c: c)
    filled = found.selectExpr(
        *others,
        "path",
        "many",
        "IF(first AND slot = 0, IF(many, sha2(concat(h, right), 256), h), NULL) AS h",
        f"{fill('left')} AS left",
        f"{fill('right')} AS right",
    )
    return filled.selectExpr(*others, "h", "IF(many, concat(path, array(struct(left, right))), path) AS path")


def _pass(nodes: DataFrame) -> DataFrame:
    """Adds ``block``, ``path`` within the block, and ``top``, the block's digest on its first row."""
    rows = nodes.selectExpr("*", "h AS own", f"pos DIV {BLOCK} AS block", f"{_NO_PATH} AS path")
    for level in range(LEVELS):
        rows = _level(rows, level)
    return rows.withColumnsRenamed({"h": "top", "own": "h"})


def _climb(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Nodes of every pass and at last one node for every ``g``, its digest in ``h``."""
    tables = [nodes]
    while most > 1:
        passed = _pass(tables[-1].select("g", "pos", "n", "h")).where(F.col("pos") % BLOCK == 0)
        up = F.floor((F.col("n") + (BLOCK - 1)) / BLOCK)
        tables.append(written(passed.select("g", F.col("block").alias("pos"), up.alias("n"), F.col("top").alias("h")), f"{name}-nodes"))
        most = -(-most // BLOCK)
    return tables


def _descend(tables: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The nodes of the lowest table with ``path`` to the root; ``above`` has path, subroot and root of each ``g``."""
    known = above.withColumn("pos", F.lit(0).cast("long"))
    for i, nodes in enumerate(reversed(tables[:-1])):
        upper = known.select("g", F.col("pos").alias("block"), F.col("path").alias("upper"), "subroot", "root")
        joined = _pass(nodes).drop("top").join(upper, ["g", "block"])
        known = joined.withColumn("path", F.concat("path", "upper")).drop("upper", "block")
        if i < len(tables) - 2:
            known = written(known, f"{name}-paths")
    if len(tables) == 1:
        known = tables[0].join(known.drop("pos"), "g")
    return known


def manifest(
    docs: DataFrame,
    group: str = "source",
    order: str = "doc_id",
    columns: Sequence[str] = COLUMNS,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Digests and proof of every row.  Columns: ``keep`` (by default ``order``), leaf, subroot, root, path.

    ``leaf`` is the digest of ``columns``, ``subroot`` that of the row's group,
    ``root`` that of all groups in their order.  ``path`` has the siblings left and
    right of the node on every level, as concatenated digests; see ``fold``.
    ``keep`` names further expressions of a row, which should be small: the columns
    of ``docs`` are not carried along, so their names cannot clash.

    Cases: nulls and empty texts are different leaves; a null group is a group, the
    first one; null ids come first in a group; rows of the same id are ordered by
    their leaves, and rows equal in all ``columns`` have the same leaf and take
    neighbouring places; a group of one row has its leaf as subroot, and a single
    group's subroot is the root; an empty table gives no rows.
    """
    col = {c: F.col(f"`{c}`") for c in {group, order, *columns}}
    kept = keep or {order: col[order]}
    # Null sorts first; the others sort by their bytes.
    g = F.when(col[group].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), col[group].cast("string")))
    leaves = docs.select(
        g.alias("g"),
        col[order].alias("o"),
        leaf_digest([col[c] for c in columns]).alias("h"),
        F.struct(*[c.alias(name) for name, c in kept.items()]).alias("kept"),
    )
    nodes, most = _numbered(written(leaves, "merkle-leaves"), ["o", "h"], "merkle")
    tables = _climb(nodes.drop("o"), most, "merkle")
    groups = tables[-1].select(F.lit("").alias("g"), F.col("g").alias("member"), F.col("h"))
    members, most = _numbered(groups, ["member"], "merkle-groups")
    group_tables = _climb(members, most, "merkle-groups")
    top = group_tables[-1].select("g", F.expr(_NO_PATH).alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    above = _descend(group_tables, top, "merkle-groups")
    above = above.select(F.col("member").alias("g"), "path", F.col("h").alias("subroot"), "root")
    rows = _descend(tables, above, "merkle")
    return rows.select(*[F.col("kept")[name].alias(name) for name in kept], F.col("h").alias("leaf"), "subroot", "root", "path")
