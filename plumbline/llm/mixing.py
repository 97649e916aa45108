"""Mix sources to target weights by nested hash thresholds.

Every document has a fixed hash.  A budget of a source is met by taking all
documents of the source whose hash is below a threshold, so a smaller budget
takes a subset of what a larger one takes.  The threshold is found from
histograms: tokens are summed by source and the leading digits of the hash, the
digit at which the running sum passes the budget is fixed, and only documents
in that one bucket are summed again by their next digits.  No document is
sorted, and a source of any size is summed in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.shared import word_count, written

#: Hash digits: 15 hexadecimal ones of an MD5 value, three to a level.
HASH_DIGITS, LEVEL_DIGITS = 15, 3
#: Sources up to this number are joined by broadcast; beyond it by a shuffle.
BROADCAST_SOURCES = 10_000


def document_hash(doc_id: Column, text: Column) -> Column:
    """15 hexadecimal digits that depend on the id, or on the text where the id is null."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.substring(F.md5(name), 1, HASH_DIGITS)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(totals: DataFrame, weights: list[float], most: float, share: float = 1.0) -> DataFrame:
    """Targets of sources: ``share`` of all tokens by weight, none above ``most`` times its source.

    ``totals`` has one row per source: ``source``, ``source_size``.  Weights are
    dealt in turn to the sources by code point, null last.  What a source cannot
    take is dealt again to the others by weight until none is above its limit.
    Each round is one sum over the sources and raises the level of all that are
    below their limit, so the rounds end at the latest when each source is at it.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ranked = written(totals.withColumn("weight", weight), "mix-sources")
    limit, level, capped = F.col("source_size") * F.lit(float(most)), 0.0, -1
    wanted = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        spent, n, rest = ranked.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == capped or rest == 0:
            break
        capped, level = n, (wanted - spent) / rest
    return ranked.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def _boundaries(sized: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """Per source: whole copies of all documents, and the hash below which one more is taken."""
    per_source = Window.partitionBy("source_key").orderBy("digit")
    # rest: tokens still to take; prefix: digits fixed so far; before: tokens with smaller hashes.
    state = targets.select(
        "source_key",
        "copies",
        "rest",
        F.lit("").alias("prefix"),
        F.lit(0).cast("long").alias("before"),
    )
    for level in range(HASH_DIGITS // LEVEL_DIGITS):
        start = level * LEVEL_DIGITS
        inside = F.substring("h", 1, start) == F.col("prefix") if level else F.lit(True)
        buckets = (
            sized.join(_small(state.where("rest > 0").select("source_key", "prefix"), n_sources), "source_key")
            .where(inside)
            .groupBy("source_key", F.substring("h", start + 1, LEVEL_DIGITS).alias("digit"))
            .agg(F.sum("size").alias("tokens"), F.count("*").alias("docs"))
        )
        # The histogram has at most 16 ** LEVEL_DIGITS rows per source.
        running = buckets.withColumn("upto", F.sum("tokens").over(per_source)).join(
            state.select("source_key", "before", "rest"), "source_key"
        )
        crossed = (
            running.where(F.col("before") + F.col("upto") > F.col("rest"))
            .groupBy("source_key")
            .agg(F.min(F.struct("digit", "upto", "tokens", "docs")).alias("b"))
        )
        state = written(state.join(crossed, "source_key", "left").select(
            "source_key",
            "copies",
            "rest",
            # Past the last bucket: every hash is below "g".
            F.when(F.col("rest") <= 0, "").otherwise(F.coalesce(F.concat("prefix", "b.digit"), F.lit("g"))).alias("prefix"),
            (F.col("before") + F.coalesce(F.col("b.upto") - F.col("b.tokens"), F.lit(0))).alias("before"),
            F.coalesce("b.tokens", F.lit(0)).alias("last"),
            F.coalesce("b.docs", F.lit(0)).alias("docs"),
        ), "mix-state")
        # One document left at each boundary: further digits would change nothing.
        if (state.agg(F.max("docs")).first()[0] or 0) <= 1:
            break
    # What is left at the boundary goes in if that comes closer to the budget.
    over = F.col("before") + F.col("last") - F.col("rest")
    return state.select(
        "source_key",
        "copies",
        F.when((F.col("rest") > 0) & (over < F.col("rest") - F.col("before")), F.concat("prefix", F.lit("~")))
        .otherwise(F.col("prefix"))
        .alias("threshold"),
    )


def _source_key(source: Column) -> Column:
    """The source without nulls, for equi-joins."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def _cut(docs: DataFrame, weights: list[float], most: float, share: float) -> tuple[DataFrame, DataFrame]:
    """(documents by id, source, size and hash; what each source takes)."""
    sized = written(
        docs.select(
            "doc_id",
            "source",
            _source_key(F.col("source")).alias("source_key"),
            word_count(F.col("text")).alias("size"),
            document_hash(F.col("doc_id"), F.col("text")).alias("h"),
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, list(weights), most, share)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = written(
        targets.withColumn("copies", copies).select(
            _source_key(F.col("source")).alias("source_key"),
            "source_size",
            "target",
            "copies",
            (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"),
        ),
        "mix-targets",
    )
    n = targets.count()
    cut = written(
        targets.select("source_key", "source_size", "target").join(_boundaries(sized, targets, n), "source_key"),
        "mix-thresholds",
    )
    return sized, _small(cut, n)


def _times(h: Column) -> Column:
    return (F.col("copies") + F.when(h < F.col("threshold"), 1).otherwise(0)).cast("int")


def mix(
    docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), most: float = 3.0, share: float = 1.0
) -> DataFrame:
    """Decide how often each document is taken.  Columns: doc_id, source, size, source_size, target, times, taken.

    One row per row of ``docs`` (``doc_id``, ``text``, ``source``; other columns
    are not read).  A source takes all its documents as often as they fit into
    its target, and for the rest those with the smallest hashes.  Cases: a null
    text has size 0; null sources are one source, the last; a null id is hashed
    by its text; rows equal in id and source share a hash and are taken alike;
    a source of no tokens has target 0; an empty table gives no rows.
    """
    sized, cut = _cut(docs, weights, most, share)
    return (
        sized.join(cut, "source_key")
        .withColumn("times", _times(F.col("h")))
        .withColumn("taken", F.col("size") * F.col("times"))
        .select("doc_id", "source", "size", "source_size", "target", "times", "taken")
    )


def mixed(
    docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), most: float = 3.0, share: float = 1.0
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with their own columns."""
    _, cut = _cut(docs, weights, most, share)
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(
        rows,
        _source_key(F.col("source")).alias("source_key"),
        document_hash(F.col("doc_id"), F.col("text")).alias("h"),
    )
    return (
        keyed.join(cut.select("source_key", "copies", "threshold"), "source_key")
        .withColumn("times", _times(F.col("h")))
        .where("times > 0")
        .select("_row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_again"))
        .select("_row.*")
    )
