"""Token counts that follow edits, by a segment tree over the pre-tokens of each document.

A leaf holds a run of pre-tokens, its characters and its tokens; inner nodes
hold sums.  An edit is located by its character offset.  Pre-tokens are cut from
left to right and depend only on what follows them, so encoding starts at the
leaf that holds the context before the edit, and stops where a new boundary
meets the boundary of an old leaf behind the edit.  The sums above the leaves in
between are updated, and all other leaves stay as they are.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Pre-tokens of a leaf when a tree is built.
LEAF = 64
#: Characters before an edit that may be cut differently after it: a pre-token looks at most three ahead.
CONTEXT = 4
#: Characters of a block of a text, and characters behind an edit that are looked at first.
BLOCK, LOOK = 16_384, 2_048
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000

# Fixed value: the pattern that the public byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Edit:
    """Characters start to end of the text before any edit become ``text``."""

    start: int
    end: int
    text: str


class Counter:
    """Pre-tokens of a text, and tokens of a pre-token."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self._known: dict[str, int] = {}
        self.pattern = regex.compile(PATTERN)

    def tokens(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            n = self._known[piece] = len(self._encoding.encode_ordinary(piece))
        return n

    def whole(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


class _Blocks:
    """A text in blocks, so that a change copies one of them."""

    def __init__(self, text: str):
        self.blocks, self.size = self._cut(text), len(text)

    @staticmethod
    def _cut(text: str) -> list[str]:
        return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [""]

    def _find(self, at: int) -> tuple[int, int]:
        for i, block in enumerate(self.blocks):
            if at <= len(block):
                return i, at
            at -= len(block)
        raise IndexError(at)

    def read(self, start: int, end: int) -> str:
        (i, x), (j, y) = self._find(start), self._find(end)
        return self.blocks[i][x:y] if i == j else "".join([self.blocks[i][x:], *self.blocks[i + 1 : j], self.blocks[j][:y]])

    def replace(self, start: int, end: int, text: str) -> None:
        (i, x), (j, y) = self._find(start), self._find(end)
        merged = self.blocks[i][:x] + text + self.blocks[j][y:]
        self.blocks[i : j + 1] = self._cut(merged) if len(merged) > 2 * BLOCK else [merged]
        self.size += len(text) - (end - start)


class TokenTree:
    """Characters, tokens and pre-tokens of a text by leaf, with sums above."""

    def __init__(self, text: str, counter: Counter, leaf: int = LEAF):
        self._blocks, self.counter, self.encoded = _Blocks(text), counter, 0
        pieces = counter.pattern.findall(text)
        leaves = [self._leaf(pieces[i : i + leaf]) for i in range(0, len(pieces), leaf)] or [(0, 0, 0)]
        self.n = len(leaves)
        self.width = 1 << (self.n - 1).bit_length()
        self.sums = [(0, 0, 0)] * self.width + leaves + [(0, 0, 0)] * (self.width - self.n)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _leaf(self, pieces: list[str]) -> tuple[int, int, int]:
        tokens = self.counter.tokens
        return sum(map(len, pieces)), sum(map(tokens, pieces)), len(pieces)

    def _sum(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def text(self) -> str:
        return "".join(self._blocks.blocks)

    @property
    def n_chars(self) -> int:
        return self._blocks.size

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    @property
    def n_pieces(self) -> int:
        return self.sums[1][2]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the character ``at``."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.sums[i][0] and self.sums[i + 1][0]:
                start += self.sums[i][0]
                i += 1
        return i - self.width, start

    def apply(self, edit: Edit) -> None:
        """Replace a range of the present text."""
        size = self.n_chars
        if not 0 <= edit.start <= edit.end <= size:
            raise ValueError("the edit lies outside of the text")
        first, at = self._find(max(0, min(edit.start - CONTEXT, size - 1)))
        self._blocks.replace(edit.start, edit.end, edit.text)
        found, look = None, LOOK
        while found is None:
            upto = min(self.n_chars, edit.start + len(edit.text) + look)
            found = self._pieces(edit, first, at, self._blocks.read(at, upto), upto == self.n_chars)
            look *= 8
        pieces, last = found
        self.encoded += len(pieces)
        slots = last - first + 1
        share = -(-len(pieces) // slots)
        for k in range(slots):
            i = self.width + first + k
            self.sums[i] = self._leaf(pieces[k * share : (k + 1) * share])
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2

    def _pieces(self, edit: Edit, first: int, at: int, window: str, whole: bool) -> tuple[list[str], int] | None:
        """Pre-tokens from ``at``, where leaf ``first`` begins, to the first old boundary of leaves behind the edit, and the last leaf.

        ``window`` is the new text from ``at``, ``whole`` if it goes to the end of the
        text; None if it ends too early to tell.
        """
        shift = len(edit.text) - (edit.end - edit.start)
        # Old leaf boundaries behind the edit, in the new text.
        last, bound = first, at + self.sums[self.width + first][0]
        while bound < edit.end and last + 1 < self.n:
            last += 1
            bound += self.sums[self.width + last][0]
        pieces: list[str] = []
        end = at
        for found in self.counter.pattern.finditer(window):
            while bound + shift < end and last + 1 < self.n:
                last += 1
                bound += self.sums[self.width + last][0]
            if end == bound + shift and end >= edit.start + len(edit.text) and end > at:
                return pieces, last
            # A piece is known with the character behind it.
            if not whole and found.end() >= len(window) - 1:
                return None
            pieces.append(found[0])
            end = at + found.end()
        if not whole:
            return None
        while bound + shift < end and last + 1 < self.n:
            last += 1
            bound += self.sums[self.width + last][0]
        return pieces, last

    def apply_all(self, edits: list[Edit]) -> None:
        """Apply edits that do not overlap, given by offsets in the text before all of them."""
        for edit in sorted(edits, key=lambda e: (e.start, e.end), reverse=True):
            self.apply(edit)


# Personal data that the registered edits replace.
_MAIL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = regex.compile(r"\+?\d(?:[ -]?\d){6,}")


def redactions(text: str) -> list[Edit]:
    """Edits that replace mail addresses and long numbers by placeholders."""
    mails = [Edit(*m.span(), "<mail>") for m in _MAIL.finditer(text)] if "@" in text else []
    ends = [e.end for e in mails]
    numbers = []
    for m in _NUMBER.finditer(text):
        # The first mail that ends behind the number's start is the only one that may overlap it first.
        i = bisect_right(ends, m.start())
        if i == len(mails) or m.end() <= mails[i].start:
            numbers.append(Edit(*m.span(), "<number>"))
    return mails + numbers


def _count_batches(ranks: bytes, edits: Callable[[str], list[Edit]]):
    """Replace the last column, the text, by the counts before and after its edits."""
    names = ("n_chars", "n_pieces", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_reencoded")

    def run(batches):
        counter = Counter(ranks)
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1):
                tree = TokenTree(text.as_py() or "", counter)
                before = (tree.n_chars, tree.n_pieces, tree.n_tokens)
                wanted = edits(tree.text)
                tree.apply_all(wanted)
                rows.append((*before, len(wanted), tree.n_chars, tree.n_tokens, tree.encoded))
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    return run


def read_ranks(path: str) -> bytes:
    """A public vocabulary file of ranks, read on the driver and sent to the tasks; it has a few MB."""
    with open(path, "rb") as file:
        return file.read()


def count_tokens(
    docs: DataFrame,
    ranks: bytes,
    edits: Callable[[str], list[Edit]] = redactions,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Tokens of every text before and after its edits.

    Columns: ``keep``, n_chars, n_pieces, n_tokens, n_edits, n_chars_after,
    n_tokens_after, n_reencoded (pre-tokens encoded for the edits).  Cases: a
    null text is empty, an empty text has no tokens; markers of special tokens
    are ordinary text; repeated rows are counted alike; an empty table gives no
    rows.
    """
    made = ", ".join(
        f"{x} long"
        for x in ("n_chars", "n_pieces", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_reencoded")
    )
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes), made])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_input"))
    return rows.mapInArrow(_count_batches(ranks, edits), schema)
