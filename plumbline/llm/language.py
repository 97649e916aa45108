"""Language of texts and of spans in mixed texts: script ranges, word scores, Viterbi.

A word is a run of letters.  Its script leaves only the languages that are
written in it; among them the character n-grams of the word give each language
a score.  Viterbi decoding over the words, with a penalty for each change of
language, labels spans, and the language with most letters is that of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.shared import fold_of

#: At most about so many labelled texts of each language are learned from, chosen by a hash of the id.
SAMPLE_PER_LANGUAGE = 1000
#: Lengths of the n-grams, and the bits of their hash.
GRAMS, BITS = (2, 3, 4), 15
#: What a change of language between two words costs, in log units.
SWITCH = 12.0
#: A language is a candidate for a script that has this share of its letters in training.
SCRIPT_SHARE = 0.01
#: N-grams of one word overlap; their summed scores are scaled by this and kept within the limit.
SCALE, LIMIT = 0.5, 8.0
#: Characters that are scored at a time.
CHUNK = 100_000
#: Texts whose words are decoded together.
ROWS = 1000
UNKNOWN = "und"

# First code points of Unicode script ranges; a range ends where the next begins.
SCRIPT_STARTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB13, "armenian"),
    (0xFB1D, "hebrew"),
    (0xFB50, "arabic"),
    (0xFE00, "other"),
    (0xFF21, "latin"),
    (0xFF66, "kana"),
    (0xFFA0, "hangul"),
    (0xFFE0, "other"),
    (0x20000, "han"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (len(GRAMS) << BITS) + 1 rows of scores by language; the last is zero
    script: np.ndarray  # by script and language: candidate or not


class _Characters:
    """Tables over code points, made once per process."""

    _made = None

    def __init__(self, top: int = 0x30000):
        self.top = top
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(top)]
        self.letter = np.fromiter((c.isalpha() for c in chars), bool, top)
        self.lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, top)
        starts = np.array([s for s, _ in SCRIPT_STARTS])
        names = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS], np.uint8)
        self.script = names[np.searchsorted(starts, np.arange(top), side="right") - 1]

    @classmethod
    def get(cls) -> "_Characters":
        if cls._made is None:
            cls._made = cls()
        return cls._made


@dataclass
class _Words:
    doc: np.ndarray  # index of the text
    start: np.ndarray  # first character in the text
    end: np.ndarray
    script: np.ndarray
    grams: np.ndarray  # (characters and one boundary per word, len(GRAMS)) rows of the table
    first: np.ndarray  # first row of each word in ``grams``


def _words(texts: list[str]) -> _Words:
    """Words of texts, and the table rows of their n-grams."""
    chars = _Characters.get()
    code = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    code = np.where(code < chars.top, code, np.uint32(32))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    letter = chars.letter[code]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(begin, start, side="right") - 1
    # The letters and the character after each word; the boundary counts as code 0.
    size = end - start + 1
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size)
    code = np.where(letter, chars.lower[code], 0).astype(np.uint64)[np.repeat(start, size) + at]
    grams = np.empty((len(at), len(GRAMS)), np.int32)
    zero = np.int32(len(GRAMS) << BITS)
    value = code * np.uint64(0x9E3779B97F4A7C15)
    for k, n in enumerate(GRAMS):
        mixed = value.copy()
        for back in range(1, n):
            shifted = np.zeros_like(code)
            shifted[back:] = code[:-back]
            # One place before the word is its boundary; what lies further back is not part of it.
            mixed += np.where(at >= back, shifted, 0) * np.uint64((0xC2B2AE3D27D4EB4F * (2 * back + 1)) % (1 << 64))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        row = (mixed >> np.uint64(64 - BITS)).astype(np.int32) + np.int32(k << BITS)
        grams[:, k] = np.where(at >= n - 2, row, zero)
    return _Words(doc, start - begin[doc], end - begin[doc], chars.script[np.maximum(code[first].astype(np.int64), 0)], grams, first)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Index of the first text, and texts of about CHUNK characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, texts[first:]


def _count_batches(batches):
    """Counts of n-grams and of scripts' letters by language; script s has row -1 - s."""
    for batch in batches:
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        for first, part in _chunks(texts):
            words = _words(part)
            size = np.diff(np.append(words.first, len(words.grams)))
            by_word = langs[first + words.doc]
            for lang in sorted(set(by_word)):
                mine = by_word == lang
                rows = np.bincount(words.grams[np.repeat(mine, size)].ravel(), minlength=1)
                used = np.flatnonzero(rows)
                scripts = np.bincount(words.script[mine], weights=(words.end - words.start)[mine], minlength=len(SCRIPTS))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(used) + len(SCRIPTS))),
                        pa.array(np.concatenate([used, -1 - np.arange(len(SCRIPTS))]), pa.int64()),
                        pa.array(np.concatenate([rows[used], scripts.astype(np.int64)]), pa.int64()),
                    ],
                    names=["lang", "row", "n"],
                )


def train(docs: DataFrame, held_out: int = 0, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from texts with a language whose id is not in fold ``held_out``.

    Rows with a null id, text or language are not learned from.  The sample is
    bounded by ``per_language``; languages with fewer texts give all of them.
    """
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != held_out)
    )
    shares = labelled.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), per_language / F.col("count")))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(shares.select("lang", "share")), "lang").where(draw < F.col("share"))
    counts = (
        sample.select("lang", "text")
        .mapInArrow(_count_batches, "lang string, row long, n long")
        .groupBy("lang", "row")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(set(counts["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    which = np.array([number[x] for x in counts["lang"].to_pylist()], np.int64)
    row, n = counts["row"].to_numpy(), counts["n"].to_numpy()
    zero, wide = len(GRAMS) << BITS, max(1, len(languages))
    found = np.zeros((zero + 1, wide))
    letters = np.zeros((len(SCRIPTS), wide))
    np.add.at(found, (row[row >= 0], which[row >= 0]), n[row >= 0])
    np.add.at(letters, (-1 - row[row < 0], which[row < 0]), n[row < 0])
    table = np.zeros((zero + 1, wide), np.float32)
    for k in range(len(GRAMS)):
        part = found[k << BITS : (k + 1) << BITS] + 0.5
        score = np.log(part / part.sum(0))
        table[k << BITS : (k + 1) << BITS] = SCALE * (score - score.mean(1, keepdims=True))
    return LanguageModel(languages, table, letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1))


def _word_scores(words: _Words, model: LanguageModel) -> np.ndarray:
    """Scores by word and language, 0 for the best."""
    gained = model.table[words.grams[:, 0]]
    for k in range(1, len(GRAMS)):
        gained += model.table[words.grams[:, k]]
    score = np.add.reduceat(gained, words.first, axis=0) if len(words.first) else np.zeros((0, gained.shape[1]), np.float32)
    candidate = model.script[words.script]
    score = np.where(candidate | ~candidate.any(1, keepdims=True), score, -1e4)
    return np.maximum(score - score.max(1, keepdims=True), -LIMIT) if len(score) else score


def _viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Best language of every word; text i has words first[i] to first[i] + count[i]."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    came = np.empty(score.shape, np.uint16)
    label = np.empty(len(score), np.uint16)
    value = np.zeros((len(first), score.shape[1]), np.float32)
    own = np.arange(score.shape[1], dtype=np.uint16)
    live = np.searchsorted(-count, -np.arange(count[0] + 1 if len(count) else 1), side="left")  # texts with more than t words
    for t in range(count[0] if len(count) else 0):
        n = live[t]
        at, v = first[:n] + t, value[:n]
        best = v.argmax(1)
        moved = v[np.arange(n), best] - SWITCH
        stay = v >= moved[:, None]
        came[at] = np.where(stay, own, best[:, None])
        value[:n] = np.where(stay, v, moved[:, None]) + score[at]
    now = value.argmax(1)
    for t in range((count[0] if len(count) else 0) - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        label[at] = now[:n]
        now[:n] = came[at, now[:n]]
    return label


def _identify_batches(model: LanguageModel, spans: bool, at: int, kept: int, prefix: str):
    """Column ``at`` is the text; the first ``kept`` columns are passed on."""

    def run(batches):
        names = np.array([*model.languages, UNKNOWN], object)
        wide = len(model.languages)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            scores, docs, starts, ends = [np.zeros((0, max(1, wide)), np.float32)], [], [], []
            for first, part in _chunks(texts):
                words = _words(part)
                scores.append(_word_scores(words, model))
                docs.append(words.doc + first), starts.append(words.start), ends.append(words.end)
            score = np.concatenate(scores)
            doc, start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, starts, ends))
            if not wide:
                score, doc, start, end = score[:0], doc[:0], start[:0], end[:0]
            count = np.bincount(doc, minlength=len(texts))
            begin = np.cumsum(count) - count
            label = _viterbi(score, begin, count)
            letters = np.bincount(doc * max(1, wide) + label, weights=end - start, minlength=len(texts) * max(1, wide))
            letters = letters.reshape(len(texts), -1)
            total = letters.sum(1)
            best = np.where(total > 0, letters.argmax(1), wide)
            out = [names[best], letters.max(1, initial=0) / np.maximum(total, 1)]
            if spans:
                out.append(_spans(doc, start, end, names[label], len(texts)))
            columns = [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), *(pa.array(x, _SPANS) for x in out[2:])]
            kinds = zip(MADE, (pa.string(), pa.float64(), _SPANS)[: len(columns)])
            fields = [pa.field(prefix + name, kind) for name, kind in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *columns], schema=pa.schema([*list(batch.schema)[:kept], *fields]))

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _spans(doc, start, end, name, n: int) -> list[list[dict]]:
    """Runs of words of one language in one text."""
    out: list[list[dict]] = [[] for _ in range(n)]
    if len(doc):
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])))
        last = np.append(cut[1:], len(doc)) - 1
        for a, b in zip(cut, last):
            out[doc[a]].append({"start": start[a], "end": end[b], "lang": name[a]})
    return out


#: Columns that ``identify`` makes.
MADE = ("lang_pred", "score", "spans")


def identify(
    docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, spans: bool = True, prefix: str = ""
) -> DataFrame:
    """Language of every text.  Columns: ``keep`` (by default those of ``docs``), lang_pred, score and spans.

    ``docs`` needs ``text``, and nothing else is an input of a prediction.
    ``score`` is the share of letters in spans of the predicted language.
    Columns of ``docs`` with these names, in either case, are replaced; with a
    ``prefix`` before the names made, none need be.  Cases: null and empty
    texts and texts without a letter are ``und`` with score 0 and no spans, as
    is everything if the model knows no language; words of a script that no
    language is written in take the language of their neighbours; ties go to the
    language that comes first by name; an empty table gives no rows.
    """
    made = [prefix + name for name in MADE]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    read = kept if "text" in kept else [*kept, "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in read])
    fields = [T.StructField(made[0], T.StringType()), T.StructField(made[1], T.DoubleType())]
    if spans:
        fields.append(T.StructField(made[2], T.ArrayType(T.StructType.fromDDL("start int, end int, lang string"))))
    schema = T.StructType([*rows.schema.fields[: len(kept)], *fields])
    return rows.mapInArrow(_identify_batches(model, spans, read.index("text"), len(kept), prefix), schema)
