"""Pack documents into shards of near equal bytes: best fit, decreasing.

Copies of one text form a group that stays together.  Groups that are large
against a shard are packed one by one; all others are first bundled by hash,
which keeps a group whole and leaves a bounded number of items of similar size.
The items enter, largest first, the shard with the tightest room that still
takes them, found in a balanced tree; the capacity is the smallest with which
the wanted number of shards is enough.  Only items reach the driver: bundles, a
fixed number, and large groups, of which the sizes allow a fixed number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.shared import written

#: Small groups go to this many bundles, for up to a quarter as many shards.
BUNDLES = 4096
#: A group of more than this share of a shard is packed by itself.
LARGE_SHARE = 1 / 64
#: Rows that get their place in a shard in one sorted run.
RUN_ROWS = 50_000


class RoomTree:
    """The remaining room of shards in a balanced (AVL) tree, ordered by room, then number."""

    class _Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self.root = None

    def add(self, room: int, shard: int) -> None:
        self.root = self._add(self.root, (room, shard))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest room of at least ``size``."""
        node, found = self.root, None
        while node:
            if node.key[0] >= size:
                found, node = node.key, node.left
            else:
                node = node.right
        if found is not None:
            self.root = self._remove(self.root, found)
        return found

    @staticmethod
    def _height(node) -> int:
        return node.height if node else 0

    def _turn(self, node, up: str, down: str):
        """Lift the child on side ``up`` above ``node``."""
        child = getattr(node, up)
        setattr(node, up, getattr(child, down))
        setattr(child, down, node)
        for x in (node, child):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return child

    def _balanced(self, node):
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        lean = self._height(node.left) - self._height(node.right)
        if abs(lean) < 2:
            return node
        up, down = ("left", "right") if lean > 0 else ("right", "left")
        child = getattr(node, up)
        if self._height(getattr(child, down)) > self._height(getattr(child, up)):
            setattr(node, up, self._turn(child, down, up))
        return self._turn(node, up, down)

    def _add(self, node, key):
        if node is None:
            return self._Node(key)
        side = "left" if key < node.key else "right"
        setattr(node, side, self._add(getattr(node, side), key))
        return self._balanced(node)

    def _remove(self, node, key):
        if key == node.key:
            if node.left is None or node.right is None:
                return node.left or node.right
            least = node.right
            while least.left:
                least = least.left
            node.key, node.right = least.key, self._remove(node.right, least.key)
        else:
            side = "left" if key < node.key else "right"
            setattr(node, side, self._remove(getattr(node, side), key))
        return self._balanced(node)


def pack(items: list[tuple], capacity: int, shards: int | None = None) -> list[tuple] | None:
    """(item, shard) for items of (size, item), best fit in decreasing size.

    An item above the capacity fills a shard of its own.  With ``shards`` given,
    None if that many are not enough.
    """
    tree, opened, placed = RoomTree(), 0, []
    for size, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        found = tree.take_tightest(size)
        if found is None:
            if opened == shards:
                return None
            found, opened = (max(capacity, size), opened), opened + 1
        tree.add(found[0] - size, found[1])
        placed.append((item, found[1]))
    return placed


def pack_into(items: list[tuple], shards: int) -> list[tuple]:
    """Pack with the smallest capacity for which ``shards`` shards suffice."""
    if not items:
        return []
    low, high = -(-sum(size for size, _ in items) // shards), sum(size for size, _ in items)
    while low < high:
        middle = (low + high) // 2
        if pack(items, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return pack(items, low, shards)


def shard(docs: DataFrame, shards: int = 16, bundles: int = BUNDLES) -> DataFrame:
    """Place every row.  Columns: doc_id, size, text_crc32, shard, slot.

    One row per row of ``docs`` (``doc_id``, ``text``; other columns are not
    read).  ``size`` is the bytes of the text plus 1, ``slot`` counts from 0
    without a gap in each shard.  Cases: null and empty text are the same group
    of size 1 each, with CRC 0; a null id is an ordinary row; repeated rows are
    rows of one group; a group above a shard's capacity has a shard that may be
    larger than the others; an empty table gives no rows.
    """
    if not 0 < shards <= bundles // 4:
        raise ValueError("shards must be between 1 and a quarter of the bundles")
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    sized = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
        ),
        "shard-sizes",
    )
    total = sized.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod("g", F.lit(bundles))
    groups = sized.groupBy("g").agg(F.sum("size").alias("bytes"))
    large = written(groups.where(F.col("bytes") > total * LARGE_SHARE / shards), "shard-large").select("g")
    # The sizes allow at most shards / LARGE_SHARE large groups.
    item = F.when(F.col("big").isNull(), F.concat(F.lit("b"), bundle)).otherwise(F.concat(F.lit("g"), "g"))
    run = F.pmod(F.xxhash64("doc_id", "g"), F.lit(1 << 30))
    marked = sized.join(F.broadcast(large.withColumn("big", F.lit(True))), "g", "left").withColumn("item", item)
    by_item = marked.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    placed = dict(pack_into([(r["bytes"], r["item"]) for r in by_item], shards))
    rows = [(r["item"], placed[r["item"]], 1 + r["n"] // RUN_ROWS) for r in by_item]
    located = marked.join(F.broadcast(spark.createDataFrame(rows, "item string, shard int, parts long")), "item").select(
        "doc_id", "size", "text_crc32", "shard", "item", F.pmod(run, F.col("parts")).alias("part")
    )
    # A shard is numbered run by run, so that no task sorts a whole shard.
    runs = located.groupBy("shard", "item", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("item", "part")) - F.col("n")
    starts = runs.select("shard", "item", "part", before.alias("start"))
    within = Window.partitionBy("shard", "item", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        located.withColumn("k", F.row_number().over(within) - 1)
        .join(starts, ["shard", "item", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("k")).cast("long").alias("slot"))
    )
