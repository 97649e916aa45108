"""Find benchmark passages in documents by Wu-Manber search over words.

Patterns are windows of consecutive benchmark words; the window that ends at a
document position is looked for by its last two words.  A shift table says how
far the search may skip when that pair ends at no pattern's end; where the shift
is zero, a bucket keyed by the pair holds the patterns that end so, and the one
that fits is compared word by word.  Patterns of one length share a table, so short benchmark items
do not shorten the skips of the long windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.shared import written

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Bytes of benchmark text whose tables one task holds at a time.
BLOCK_BYTES = 4_000_000

# Lower-cases A-Z; every other ASCII character but a-z and 0-9 becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of letters and digits, with A-Z in lower case."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


class WuManber:
    """Tables for word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.most = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict] = {}
        for pattern, items in patterns.items():
            for end in range(b, m + 1):
                pair, left = pattern[end - b : end], m - end
                if left < self.shift.get(pair, self.most):
                    self.shift[pair] = left
            self.bucket.setdefault(pattern[m - b :], {})[pattern] = items

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence of a pattern in ``words``."""
        m, b, most, shift, n = self.length, self.block, self.most, self.shift, len(words)
        end = m
        while end <= n:
            pair = tuple(words[end - b : end])
            skip = shift.get(pair, most)
            if skip:
                end += skip
                continue
            # The bucket finds the pattern by its hash and compares it word by word.
            items = self.bucket[pair].get(tuple(words[end - m : end]))
            if items is not None:
                yield end - m, items
            end += 1


def tables(items: list[tuple[str | None, bytes | str | None]], window: int = WINDOW) -> list[WuManber]:
    """One set of tables per pattern length for (item id, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            named = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set())
            if item is not None:
                named.add(item)
    return [WuManber(patterns) for _, patterns in sorted(by_length.items())]


def search(words: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [start, end) spans of hit words, and the items that occur."""
    spans, items = [], set()
    for table in found:
        for start, named in table.find(words):
            spans.append((start, start + table.length))
            items |= named
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


#: Columns that ``find_passages`` makes.
_FOUND = ("n_words", "spans", "items")


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, prefix: str = ""
) -> DataFrame:
    """Spans of hit words and the benchmark items behind them.  Columns: ``keep``, n_words, spans, items.

    ``docs`` needs ``text``, ``benchmark`` needs ``item_id`` and ``text``; the
    columns of ``docs`` named in ``keep`` (by default all) are passed on, but for
    those named n_words, spans or items in either case; with a ``prefix`` before the
    names made, none need be left out.  The benchmark is cut into blocks of bounded size; each block's
    text goes to the tasks in turn and adds to the rows what it finds.  Cases:
    null and empty texts have no words and no hits; an item without words is
    never found; the words of an item with a null id count as hits, but the item
    is not named; items equal in text are all named; an empty table gives no
    rows, an empty benchmark no hits.
    """
    made = [prefix + c for c in _FOUND]
    passed = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    carried = passed if "text" in passed else [*passed, "text"]
    out = docs.select(*[F.col(f"`{c}`") for c in carried]).withColumns(
        {
            made[0]: F.lit(0).cast("long"),
            made[1]: F.lit(None).cast("array<struct<start:int,end:int>>"),
            made[2]: F.lit(None).cast("array<string>"),
        }
    )
    for block in _blocks(benchmark):
        out = out.mapInArrow(_search_batches(block, window, made), out.schema)
    return out.select(*[F.col(f"`{c}`") for c in passed], *made)


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """Benchmark rows in blocks of about BLOCK_BYTES; at least one block, each gathered by itself."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    if n > 1:
        rows = written(rows, "benchmark")
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == i)
        yield [(r["item"], r["text"]) for r in part.collect()]


def _search_batches(block: list, window: int, made: list[str]):
    def run(batches):
        found = tables(block, window)
        for batch in batches:
            counts, spans, items = [], [], []
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            before = zip(
                batch.column(batch.schema.get_field_index(made[1])).to_pylist(),
                batch.column(batch.schema.get_field_index(made[2])).to_pylist(),
            )
            for data, (old_spans, old_items) in zip(text, before):
                words = words_of(data.as_py())
                hit, named = search(words, found)
                if old_spans:
                    hit = merged(hit + [(x["start"], x["end"]) for x in old_spans])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in hit] or None)
                items.append(sorted(named | set(old_items or ())) or None)
            for name, values in zip(made, (counts, spans, items)):
                i = batch.schema.get_field_index(name)
                batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
            yield batch

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    share: int = 20,
    keep: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """``find_passages`` with n_hit, n_items, items_sha256 and contaminated in place of spans and items.

    A document is contaminated if at least one in ``share`` of its words is hit.
    """
    hits = F.aggregate(prefix + "spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    n_hit = F.coalesce(hits, F.lit(0)).cast("long")
    names = F.coalesce(prefix + "items", F.array().cast("array<string>"))
    return (
        find_passages(docs, benchmark, window, keep, prefix)
        .withColumns(
            {
                f"{prefix}n_hit": n_hit,
                f"{prefix}n_items": F.size(names).cast("long"),
                f"{prefix}items_sha256": F.sha2(F.concat_ws(",", names), 256),
                f"{prefix}contaminated": (n_hit > 0) & (share * n_hit >= F.col(prefix + "n_words")),
            }
        )
        .drop(prefix + "spans", prefix + "items")
    )
