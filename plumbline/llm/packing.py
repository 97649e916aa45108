"""Pack token ids of documents into sequences: bounded-space, online, best fit.

Every task packs the documents in the order in which it reads them.  It holds a
fixed number of open windows.  A piece goes into the open window with the least
room that takes it; if none does and all windows are open, the fullest is
emitted.  What the windows hold at a task's end is left over.  Leftovers of
several tasks are merged in rounds, largest pieces first, with the same windows,
until one group is left, whose last windows are poured together.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.shared import written

#: Tokens of a sequence, and windows that a task holds open.
CAPACITY, WINDOWS = 4096, 32
#: A window that is emitted with more room than this is filled with the head of the piece that did not fit.
MOST_ROOM = 64
#: Groups of leftovers that are merged into one in a round.
MERGED = 16
#: Words of a generation whose ids a task remembers.
KNOWN_WORDS = 200_000
#: Texts and characters that are encoded together, and bytes of ids that are handed on together.
ROWS, CHARACTERS, OUT_BYTES = 1000, 1_000_000, 4_000_000
#: Bytes of an id: little-endian and unsigned.
WIDTH = 4

_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, open boolean"


class WordEncoder:
    """Ids of texts as bytes, word by word, for a BPE of words that drops white space.

    The pre-tokenizer of such a vocabulary never crosses white space, so the ids of
    a text are those of its words in turn.  New words of plain Latin signs are merged
    together by the same vocabulary as ranks, which takes a fraction of the time;
    all others go to the tokenizer itself.  Words are remembered in two generations:
    once the younger one is full, it takes the place of the older one, so that words
    which come often stay.
    """

    def __init__(self, model: str, known: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(model), known
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ranks = _ranks(json.loads(model))

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(found.ids, "<u4").tobytes()

    def _merged(self, words: list[str]) -> Iterator[bytes]:
        """Plain words: their parts end with a line feed each, and an empty part stands between words."""
        ends = "\n\n".join("\n".join(_PARTS.findall(word.lower())) for word in words) + "\n\n"
        ids = np.array(self.ranks.encode_ordinary(ends), "<u4")
        cuts = np.flatnonzero(ids == self.ranks.n_vocab - 1)
        first = 0
        for cut in cuts.tolist():
            yield ids[first:cut].tobytes()
            first = cut + 1

    def _learn(self, words: set[bytes]) -> None:
        again = words & self.older.keys()
        self.known.update((word, self.older[word]) for word in again)
        new = {word: word.decode() for word in words - again}
        plain = [w for w, text in new.items() if self.ranks and _PLAIN.fullmatch(text) and "<|" not in text]
        if plain:
            self.known.update(zip(plain, self._merged([new.pop(w) for w in plain])))
        if new:
            self.known.update(zip(new, self._encoded(list(new.values()))))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        # bytes.split cuts at ASCII white space only.
        words = [text.encode().split() for text in texts]
        self._learn(set().union(*words) - self.known.keys())
        return [b"".join(map(self.known.__getitem__, w)) for w in words]


# Words whose lower case and parts are the same in Python as in the tokenizer: no controls, marks or final letters.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
# The pre-tokenizer's pattern and the sign of a word's end.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_END = "</w>"


def _ranks(model: dict):
    """The vocabulary as ranks, a word's end written as a line feed; None if its ids are not in the order of merges.

    The last id is that of a line feed alone, which is no part of a word.
    """
    import tiktoken

    vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    first = min((vocabulary[a + b] for a, b in pairs), default=0)
    if model["model"].get("end_of_word_suffix") != _END or any(vocabulary[a + b] != first + i for i, (a, b) in enumerate(pairs)):
        return None
    sign = byte_of_sign()
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {}
    for token, i in vocabulary.items():
        if token not in special:
            ends = token.endswith(_END)
            ranks[bytes(sign[c] for c in (token[: -len(_END)] if ends else token)) + b"\n" * ends] = i
    # The line feed as a byte of text cannot occur in a word; its id is given to the empty part.
    ranks[b"\n"] = len(vocabulary)
    return tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})


def byte_of_sign() -> dict[str, int]:
    """Bytes by the signs that byte-level vocabularies write them with: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about CHARACTERS characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > CHARACTERS:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


_encoders: dict[int, WordEncoder] = {}


def _encoder(model: str) -> WordEncoder:
    """The encoder of this process; making one takes longer than a small task."""
    key = hash(model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(model)
    return _encoders[key]


@dataclass
class _Window:
    number: int
    filled: int = 0
    pieces: list = field(default_factory=list)


@dataclass
class Packer:
    """Open windows of one task.  A piece is (row, start, ids, doc_tokens); ``closed`` has finished windows."""

    capacity: int = CAPACITY
    windows: int = WINDOWS
    most_room: int = MOST_ROOM
    numbers: int = 0
    #: (room, number of the window) in ascending order.
    rooms: list = field(default_factory=list)
    open: dict = field(default_factory=dict)
    closed: list = field(default_factory=list)

    def _start(self) -> _Window:
        window = _Window(self.numbers)
        self.numbers += 1
        return window

    def _put(self, window: _Window, row, start: int, ids: memoryview, total: int) -> None:
        window.pieces.append((row, start, ids, total, window.filled))
        window.filled += len(ids) // WIDTH
        if window.filled == self.capacity:
            self.closed.append(window)
        else:
            self.open[window.number] = window
            insort(self.rooms, (self.capacity - window.filled, window.number))

    def _take(self, at: int) -> _Window:
        return self.open.pop(self.rooms.pop(at)[1])

    def add(self, row, start: int, ids: memoryview, total: int) -> None:
        """Place a piece, cut where it is longer than a window or needed to fill one."""
        while len(ids) >= self.capacity * WIDTH:
            head, ids = ids[: self.capacity * WIDTH], ids[self.capacity * WIDTH :]
            self._put(self._start(), row, start, head, total)
            start += self.capacity
        while ids:
            at = bisect_left(self.rooms, (len(ids) // WIDTH,))
            if at < len(self.rooms):
                return self._put(self._take(at), row, start, ids, total)
            if len(self.rooms) < self.windows:
                return self._put(self._start(), row, start, ids, total)
            room = self.rooms[0][0]
            fullest = self._take(0)
            if room <= self.most_room:
                self.closed.append(fullest)
            else:
                self._put(fullest, row, start, ids[: room * WIDTH], total)
                start, ids = start + room, ids[room * WIDTH :]

    def pour(self) -> None:
        """Close all windows; those with much room are poured into one another, which leaves one of them with room."""
        rest = []
        while self.rooms:
            room, window = self.rooms[0][0], self._take(0)
            if room <= self.most_room:
                self.closed.append(window)
            else:
                rest += window.pieces
        window = self._start()
        for row, start, ids, total, _ in rest:
            while ids:
                room = (self.capacity - window.filled) * WIDTH
                head, ids = ids[:room], ids[room:]
                window.pieces.append((row, start, head, total, window.filled))
                window.filled += len(head) // WIDTH
                start += len(head) // WIDTH
                if window.filled == self.capacity:
                    self.closed.append(window)
                    window = self._start()
        if window.pieces:
            self.closed.append(window)


class _Rows:
    """Pieces as Arrow batches: the kept columns of their rows, then those of _PIECE."""

    def __init__(self, kept: pa.Schema, packer: Packer, base: int, part: int):
        self.kept, self.packer, self.base, self.part = kept, packer, base, part
        self.schema = pa.schema(
            [
                *kept,
                *(pa.field(c, pa.binary() if c == "ids" else pa.int64()) for c in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part")),
                pa.field("open", pa.bool_()),
            ]
        )

    def batch(self, windows: list[_Window], is_open: bool) -> pa.RecordBatch:
        pieces = [(p, w.number) for w in windows for p in w.pieces]
        rows = list(zip(*(p[0] for p, _ in pieces))) or [()] * len(self.kept)
        columns = [pa.array(list(values), f.type) for values, f in zip(rows, self.kept)]
        n = len(pieces)
        columns += [
            pa.array([p[1] for p, _ in pieces], pa.int64()),
            pa.array([len(p[2]) // WIDTH for p, _ in pieces], pa.int64()),
            pa.array([bytes(p[2]) for p, _ in pieces], pa.binary()),
            pa.array([p[3] for p, _ in pieces], pa.int64()),
            pa.array([self.base + number for _, number in pieces], pa.int64()),
            pa.array([p[4] for p, _ in pieces], pa.int64()),
            pa.array([self.part] * n, pa.int64()),
            pa.array([is_open] * n, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def closed(self, least: int = 0):
        """Batches of finished windows, once there are ``least`` bytes of them."""
        done = self.packer.closed
        if done and len(done) * self.packer.capacity * WIDTH >= least:
            step = max(1, OUT_BYTES // (self.packer.capacity * WIDTH))
            for i in range(0, len(done), step):
                yield self.batch(done[i : i + step], False)
            done.clear()


def _base(turn: int, part: int) -> int:
    """First sequence number of a task; numbers of a task stay below 2^32."""
    return (turn << 58) | (part << 32)


def _pack_batches(model: str, capacity: int, windows: int, most_room: int, end_id: int):
    def run(batches):
        encoder, packer, part = _encoder(model), Packer(capacity, windows, most_room), TaskContext.get().partitionId()
        end, out = end_id.to_bytes(WIDTH, "little"), None
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            kept = pa.schema(list(batch.schema)[:-1])
            out = out or _Rows(kept, packer, _base(0, part), part)
            rows = list(zip(*(c.to_pylist() for c in batch.columns[:-1]))) or [()] * batch.num_rows
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            at = 0
            for part_texts in _slices(texts):
                for found in encoder.ids(part_texts):
                    packer.add(rows[at], 0, memoryview(found + end), len(found) // WIDTH + 1)
                    at += 1
                    yield from out.closed(OUT_BYTES)
        if out:
            yield from out.closed()
            left = list(packer.open.values())
            if left:
                yield out.batch(left, True)

    return run


def _merge(capacity: int, windows: int, most_room: int, width: int, turn: int, last: bool):
    def run(key, table):
        kept = pa.schema(list(table.schema)[:width])
        packer, part = Packer(capacity, windows, most_room), key[0].as_py()
        out = _Rows(kept, packer, _base(turn, part), part)
        values = table.to_pydict()
        rows = list(zip(*(values[f.name] for f in kept))) or [()] * table.num_rows
        pieces = sorted(range(table.num_rows), key=lambda i: (-values["length"][i], values["sequence_id"][i], values["offset"][i]))
        for i in pieces:
            packer.add(rows[i], values["start"][i], memoryview(values["ids"][i]), values["doc_tokens"][i])
        if last:
            packer.pour()
        return pa.Table.from_batches([out.batch(packer.closed, False), out.batch(list(packer.open.values()), True)], schema=out.schema)

    return run


def pack(
    docs: DataFrame,
    model: str,
    text: str = "text",
    keep: dict[str, Column] | None = None,
    capacity: int = CAPACITY,
    windows: int = WINDOWS,
    most_room: int = MOST_ROOM,
    end_id: int = 2,
) -> DataFrame:
    """Pieces of sequences.  Columns: ``keep`` (by default doc_id), start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its text by ``model``, the content of a tokenizer file
    whose pre-tokenizer drops white space, and ``end_id``.  Each id lies in one
    piece; ``start`` counts the document's ids before it, ``offset`` the sequence's.
    ``ids`` are little-endian unsigned 32-bit numbers.  All but one of the
    sequences have at most ``most_room`` ids less than ``capacity``.  ``keep`` names
    expressions of a row that its pieces carry; their names must differ from the others.

    Cases: null and empty texts have the end id alone; a text longer than a window
    is cut; repeated rows are documents of their own; rows of equal length take
    their places in the order in which they are read; other columns are not read, so
    their names cannot clash; an empty table gives no rows.
    """
    keep = {"doc_id": F.col("doc_id")} if keep is None else keep
    rows = docs.select(*[c.alias(name) for name, c in keep.items()], F.col(f"`{text}`").alias("_input"))
    kinds = [f"`{name}` {kind}" for name, kind in rows.dtypes[:-1]]
    schema = ", ".join([*kinds, _PIECE])
    pieces = written(rows.mapInArrow(_pack_batches(model, capacity, windows, most_room, end_id), schema), "packed")
    closed, left, turn, last = [pieces.where(~F.col("open"))], pieces.where("open"), 0, False
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while not last:
        parts, turn = -(-parts // MERGED), turn + 1
        last = parts == 1
        merge = _merge(capacity, windows, most_room, len(kinds), turn, last)
        grouped = left.withColumn("part", F.floor(F.col("part") / MERGED)).groupBy("part")
        pieces = written(grouped.applyInArrow(merge, schema), f"packed-{turn}")
        closed.append(pieces.where(~F.col("open")))
        left = pieces.where("open")
    everything = closed[0]
    for more in closed[1:]:
        everything = everything.unionAll(more)
    return everything.drop("part", "open")
