"""Quality rules as a cascade that stops at the first rejection.

What a rule costs and how much it rejects is estimated on a sample; the rules
then run in the order of rejection per cost, each only on the documents that all
before it have kept.  A document is kept if every rule keeps it, so the order
changes the work and never the verdict.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Documents, about, on which costs and rejections are estimated, chosen by a hash of the text.
SAMPLE = 2000
#: Bytes of text that are measured together.
CHUNK = 600_000

_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rule:
    """``keeps`` takes texts and gives a Boolean for each."""

    name: str
    keeps: Callable[[list[bytes]], np.ndarray]


def _array(values, kind=bool) -> np.ndarray:
    return np.fromiter(values, kind)


def word_length(low: float, high: float) -> Rule:
    """Mean length of words, in bytes, within limits."""

    def keeps(texts):
        n = _array((max(1, len(t.split())) for t in texts), float)
        chars = _array((len(t.translate(None, _SPACE)) for t in texts), float)
        return (chars >= low * n) & (chars <= high * n)

    return Rule("word_length", keeps)


def symbols(percent: int) -> Rule:
    """At most so many symbols for a hundred words."""
    return Rule(
        "symbols",
        lambda texts: _array(
            100 * (len(t) - len(t.translate(None, _SYMBOLS))) <= percent * len(t.split()) for t in texts
        ),
    )


def letters(percent: int) -> Rule:
    """At least so many of a hundred bytes in words are letters; bytes beyond ASCII count as letters."""
    other = bytes(c for c in range(128) if not chr(c).isalpha())
    return Rule(
        "letters",
        lambda texts: _array(
            100 * len(t.translate(None, other)) >= percent * len(t.translate(None, _SPACE)) for t in texts
        ),
    )


def duplicate_lines(percent: int) -> Rule:
    """At most so many of a hundred bytes are in lines that are equal to an earlier one."""

    def keeps(texts):
        lines = [t.split(b"\n") for t in texts]
        return _array(100 * (sum(map(len, x)) - sum(map(len, set(x)))) <= percent * sum(map(len, x)) for x in lines)

    return Rule("duplicate_lines", keeps)


def distinct_words(percent: int) -> Rule:
    """At least so many of a hundred words are distinct, or as many as the square root of their number allows."""

    def keeps(texts):
        words = [t.split() for t in texts]
        return _array(100 * len(set(w)) >= percent * min(len(w), 10 * len(w) ** 0.5) for w in words)

    return Rule("distinct_words", keeps)


def compression(percent: int) -> Rule:
    """The text, compressed, keeps at least so many percent of its bytes."""
    return Rule("compression", lambda texts: _array(100 * len(zlib.compress(t, 1)) >= percent * len(t) for t in texts))


RULES = (word_length(2, 20), symbols(10), letters(80), duplicate_lines(30), distinct_words(20), compression(15))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per document, share rejected), by decreasing rejection per cost, then name."""

    def measure(batches):
        for batch in batches:
            texts = _texts(batch.column(0))
            rows = []
            for i, rule in enumerate(rules):
                began = time.thread_time()
                kept = int(rule.keeps(texts).sum())
                rows.append((i, time.thread_time() - began, len(texts), len(texts) - kept))
            names = ("rule", "cost", "n", "rejected")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)

    share = min(1.0, sample / max(1, docs.count()))
    drawn = docs.select("text").where(F.pmod(F.xxhash64(F.lit("rules"), "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sums = {
        r["rule"]: r
        for r in drawn.mapInArrow(measure, "rule long, cost double, n long, rejected long")
        .groupBy("rule")
        .agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"), F.sum("rejected").alias("rejected"))
        .collect()
    }
    found = [
        (rule, sums[i]["cost"] / sums[i]["n"], sums[i]["rejected"] / sums[i]["n"]) if i in sums else (rule, 0.0, 0.0)
        for i, rule in enumerate(rules)
    ]
    return sorted(found, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0].name))


def cascade(texts: list[bytes], rules: list[Rule]) -> np.ndarray:
    """Number of the rule that rejects each text first, or -1."""
    first = np.full(len(texts), -1)
    alive = np.arange(len(texts))
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        kept = rule.keeps([texts[k] for k in alive])
        first[alive[~kept]] = i
        alive = alive[kept]
    return first


def _repeated(words: list[list[bytes]]) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    count = _array(map(len, words), np.int64)
    known: dict[bytes, int] = {}
    code = _array((known.setdefault(w, len(known)) for text in words for w in text), np.int64)
    doc = np.repeat(np.arange(len(words)), count)
    start = np.flatnonzero(doc[2:] == doc[:-2]) if len(code) > 2 else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(len(words), np.int64)
    # Numbers of pairs, of windows, and of windows in a text, each without gaps, so that no product overflows.
    pair = np.unique(code[start] * len(known) + code[start + 1], return_inverse=True)[1]
    window = np.unique(pair * len(known) + code[start + 2], return_inverse=True)[1]
    _, own, times = np.unique(doc[start] * len(start) + window, return_inverse=True, return_counts=True)
    again = start[times[own] > 1]
    hit = np.zeros(len(code), bool)
    for k in range(3):
        hit[again + k] = True
    return np.bincount(doc[hit], minlength=len(words))


def _measure_batches(rules: list[Rule], least_words: int, most_repeated: int):
    """Replace the last column, the text, by what is measured and decided."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

    def measured(texts: list[bytes]) -> list[np.ndarray]:
        words = [t.split() for t in texts]
        n = _array(map(len, words), np.int64)
        lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
        repeated = _repeated(words)
        failed = (n < least_words) | (100 * repeated > most_repeated * n)
        kept = ~failed
        passed = np.flatnonzero(kept)
        kept[passed] = cascade([texts[i] for i in passed], rules) < 0
        return [
            n,
            _array((len(t.translate(None, _SPACE).decode("utf-8", "replace")) for t in texts), np.int64),
            _array((len(t) - len(t.translate(None, _SYMBOLS)) for t in texts), np.int64),
            _array((len(x) - len(set(x)) for x in lines), np.int64),
            repeated,
            failed,
            kept,
        ]

    def run(batches):
        for batch in batches:
            texts, parts, part, size = _texts(batch.column(batch.num_columns - 1)), [], [], 0
            for text in texts:
                part.append(text)
                size += len(text)
                if size > CHUNK:
                    parts.append(measured(part))
                    part, size = [], 0
            parts.append(measured(part))
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    return run


def quality(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    least_words: int = 50,
    most_repeated: int = 50,
    keep: tuple[str, ...] = ("doc_id",),
    sample: int = SAMPLE,
) -> DataFrame:
    """Measures and verdict of every document.

    Columns: ``keep``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept; those of ``docs`` with the latter names
    are not passed on.  The base rules fail a text of fewer than ``least_words``
    words, or with more than ``most_repeated`` of a hundred words in windows of
    three that occur again; the cascade decides about the others.  Cases: a null
    or empty text has no words and fails; repeated rows are measured alike; an
    empty table gives no rows.
    """
    ordered = [rule for rule, _, _ in estimate(docs, rules, sample)]
    made = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean"
    )
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes), made])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_input"))
    return rows.mapInArrow(_measure_batches(ordered, least_words, most_repeated), schema)
