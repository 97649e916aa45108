"""Align the tokens of two tokenizers on the same texts by merging their ends.

Each text is encoded by both, and the ends of tokens in bytes are put into one
row for many texts.  Diagonals at equal distances, found by binary search, divide
the merge of the two rows into independent pieces of equal work, whatever the
lengths of texts.  A piece gives the overlaps of its tokens; what a boundary cuts
is stitched.  Overlaps of equal ids are counted over all texts: summed in every
row and in every task before the shuffle, then looked up in a table of the most
frequent pairs, of bounded size; the rest are joined.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.packing import byte_of_sign
from plumbline.llm.shared import written
from plumbline.llm.token_counts import PATTERN

#: Ends that one piece of a merge has.
WORK = 1 << 16
#: Texts and characters that are encoded together.
ROWS, CHARACTERS = 1000, 500_000
#: The most frequent pairs, looked up in a broadcast table; all others are joined.
FREQUENT_PAIRS = 200_000
#: A pair of ids is one number: the id of A times this, plus the id of B.  Ids are below it.
PAIR = 1 << 24
# How the piece model writes a space and a byte.
_SPACE, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
# Texts in which Unicode's classes of signs are the same in all versions.
_SETTLED = re.compile(r"[\x00-\u024f\u0400-\u04ff\u2000-\u206f]*")

_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


class Encoders:
    """Both tokenizers, the bytes of their tokens, and the texts of their ids in groups.

    A is a byte-level BPE.  Its ids are found by the same vocabulary as ranks, which
    takes a fraction of the time, and by the tokenizer itself for texts with signs
    whose class may depend on the version of Unicode.
    """

    def __init__(self, model_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(model_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model_b)
        sign, model = byte_of_sign(), json.loads(model_a)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(map(sign.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        self._ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = [_BYTE.fullmatch(p) for p in pieces]
        self.bytes_a = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes_a[i] = token
        self.bytes_b = [bytes([int(m[1], 16)]) if m else p.replace(_SPACE, " ").encode() for p, m in zip(pieces, byte)]
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Texts of ids inside of a group and at the end of their side of it.
        self.text_of = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(pieces), ",;")) for i in range(n) for end in ends]

    def _ids_a(self, text: str) -> np.ndarray:
        if _SETTLED.fullmatch(text):
            return self._ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B by text; none for a text that one of them does not give back."""
        none = np.zeros(0, np.int64)
        all_b = self.b.encode([text or "" for text in texts], num_threads=1) if texts else []
        left, right = [], []
        for text, b in zip(texts, all_b):
            a = self._ids_a(" " + text) if text else none
            own = (" " + text).encode() if text else b""
            whole = own and all(b"".join(map(x.__getitem__, ids)) == own for x, ids in ((self.bytes_b, b), (self.bytes_a, a.tolist())))
            left.append(a if whole else none)
            right.append(np.array(b, np.int64) if whole else none)
        return left, right


_encoders: dict[int, Encoders] = {}


def _get(model_a: str, model_b: bytes) -> Encoders:
    """The encoders of this process; making them takes longer than a small task."""
    key = hash((model_a, model_b))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoders(model_a, model_b)
    return _encoders[key]


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> np.ndarray:
    """Where each diagonal crosses the merge of two ascending rows: numbers of elements of ``a`` and ``b`` before it.

    Equal elements come from ``a`` first.  Piece i is what lies between crossings i and i + 1.
    """
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        live = low < high
        # On this diagonal, element ``middle`` of a belongs before the crossing if it is not above its counterpart of b.
        before = np.zeros(len(low), bool)
        before[live] = a[middle[live]] <= b[diagonal[live] - middle[live] - 1]
        low, high = np.where(live & before, middle + 1, low), np.where(live & ~before, middle, high)
    return np.stack([low, diagonal - low], 1)


def _overlaps(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps that end in one piece: tokens of A and B (numbers in the whole rows), and whether both end there.

    Each distinct end closes the overlap of the token of A and the token of B in which
    it lies.  Tokens that end outside the piece are those at its crossings.
    """
    ends = np.concatenate([a[a0:a1], b[b0:b1]])
    ends = np.sort(ends, kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    # Later ends of the other row are in later pieces, so the next element after the slice closes the token.
    in_a = a0 + np.searchsorted(a[a0:a1], ends)
    in_b = b0 + np.searchsorted(b[b0:b1], ends)
    both = (a[np.minimum(in_a, len(a) - 1)] == ends) & (b[np.minimum(in_b, len(b) - 1)] == ends)
    return in_a, in_b, both


def align_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two rows of ends that end alike: tokens of A, of B, and whether a group ends with them."""
    crossings = merge_path(a, b, work)
    pieces = [_overlaps(a, b, a0, a1, b0, b1) for (a0, b0), (a1, b1) in zip(crossings[:-1], crossings[1:])]
    # A common end that a crossing divides is the last of one piece, by A, and the first of the next, by B.
    for k in range(1, len(pieces)):
        a_at, b_at = crossings[k]
        if 0 < a_at and b_at < len(b) and a[a_at - 1] == b[b_at]:
            pieces[k] = tuple(x[1:] for x in pieces[k])
    if not pieces:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*pieces))


def _group_texts(encoders: Encoders, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
    """Ids of all groups with their separators, A's side of a group before B's; ``last`` are numbers of the last tokens of groups."""
    code_a, code_b = 2 * ids_a, 2 * (ids_b + len(encoders.bytes_a))
    code_a[last_a] += 1
    code_b[last_b] += 1
    group_a = np.searchsorted(last_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a]] = code_a
    codes[np.arange(len(ids_b)) + last_a[group_b] + 1] = code_b
    return list(map(encoders.text_of.__getitem__, codes.tolist()))


def aligned(encoders: Encoders, texts: list[str | None], work: int = WORK) -> list[pa.Array]:
    """Columns of _ALIGNED for texts."""
    left, right = encoders.ids(texts)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    ids_a, ids_b = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    in_a, in_b, both = align_ends(np.cumsum(encoders.length_a[ids_a]), np.cumsum(encoders.length_b[ids_b]), work)
    # Texts end where both have a token that ends, so no group or overlap crosses texts.
    text = np.searchsorted(np.cumsum(n_a), in_a, side="right")
    n_links = np.bincount(text, minlength=len(texts))
    closing = np.flatnonzero(both)
    n_groups = np.bincount(text[closing], minlength=len(texts))
    tokens = _group_texts(encoders, ids_a, ids_b, in_a[closing], in_b[closing])
    upto = np.append(0, np.cumsum(n_a + n_b)).tolist()
    key = np.sort(text * PAIR**2 + ids_a[in_a] * PAIR + ids_b[in_b])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key))).astype(np.int32)
    owner, pair = np.divmod(key[first], PAIR**2)
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts)))).astype(np.int32)
    return [
        pa.array(n_a),
        pa.array(n_b),
        pa.array(n_groups.astype(np.int64)),
        pa.array(n_links.astype(np.int64)),
        pa.array(["".join(tokens[i:j])[:-1] for i, j in zip(upto[:-1], upto[1:])], pa.string()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(pair)),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times)),
    ]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Neighbouring rows of about CHARACTERS characters together, with their texts, the last column."""
    for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
        texts = part.column(part.num_columns - 1).to_pylist()
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size > CHARACTERS or i == len(texts) - 1:
                yield part.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


def _align_batches(model_a: str, model_b: bytes):
    def run(batches):
        encoders = _get(model_a, model_b)
        names = [x.split()[0] for x in _ALIGNED.split(", ")]
        for batch in batches:
            for part, texts in _slices(batch):
                columns = [*part.columns[:-1], *aligned(encoders, texts)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], *names])

    return run


def align(docs: DataFrame, model_a: str, model_b: bytes, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Groups and overlaps of every text.  Columns: row, ``keep`` (by default doc_id), n_a, n_b, n_groups, n_links, groups, pairs, times.

    A encodes a space and the text, B, which adds that space, the text; ``model_a``
    and ``model_b`` are the contents of their files.  ``groups`` has the ids between
    neighbouring common ends, as ``a1,a2|b1;a3|b2``.  ``pairs`` are the distinct
    overlapping ids, A times 2^24 plus B, with ``times``.  ``row`` numbers the rows.
    ``keep`` names expressions of a row; their names must differ from the others.
    The result is a written table.

    Cases: null and empty texts, and those that A or B does not give back byte for
    byte, have no tokens: zeros, an empty text and empty lists; names of special
    tokens in a text are text; a text of any length is one row; repeated rows are
    rows of their own; other columns are not read, so their names cannot clash; an
    empty table gives no rows.
    """
    keep = {"doc_id": F.col("doc_id")} if keep is None else keep
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[c.alias(name) for name, c in keep.items()], F.col(f"`{text}`").alias("_input"))
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in rows.dtypes[:-1]), _ALIGNED])
    return written(rows.mapInArrow(_align_batches(model_a, model_b), schema), "aligned")


def pair_counts(alignment: DataFrame) -> DataFrame:
    """Overlaps of every pair of ids in all texts.  Columns: pair, n, best (no pair of that id of B has more)."""
    links = alignment.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = written(links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")), "pairs")
    id_b = F.pmod("pair", F.lit(PAIR))
    highest = counts.groupBy(id_b.alias("b")).agg(F.max("n").alias("highest"))
    # Few rows for each id of B at most: one for each id of A.
    return written(counts.withColumn("b", id_b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-counts")


def link_sums(alignment: DataFrame, counts: DataFrame, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """For every ``row`` with overlaps: n_best, those whose pair is a best one, and count_sum, the sum of their pairs' counts."""
    links = alignment.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    size = counts.count()
    top = counts if size <= frequent else written(counts.orderBy(F.desc("n"), "pair").limit(frequent), "pairs-frequent")
    found = links.join(F.broadcast(top), "pair", "left")
    if size > frequent:
        # Pairs beyond the frequent ones have low counts, so no key of this join is hot.
        rest = found.where(F.col("n").isNull()).select("row", "pair", "times").join(counts, "pair")
        found = found.where(F.col("n").isNotNull()).unionByName(rest)
    return found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("times")).cast("long").alias("count_sum"),
    )
