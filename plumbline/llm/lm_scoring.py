"""Score documents with a causal self-attention model and with word frequencies.

Everything that is counted, words for the base score and pairs of subword ids
for the model's prior, is counted over all training documents, summed in every
task before the shuffle.  The attention layer is fitted on all of them, in
rounds.  Texts are encoded once; what follows reads their ids.  Each text is cut into overlapping windows, in which each token is scored once.
Frequent words are looked up in a table of bounded size; the other words of all
documents are joined with their counts.
"""

from __future__ import annotations

import base64
import math
from collections import Counter, defaultdict
from contextlib import contextmanager
from copy import copy
from dataclasses import dataclass, replace
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.attention_lm import FREQUENT, AttentionModel, Bigrams, windows
from plumbline.llm.shared import fold_of, written
from plumbline.llm.token_counts import PATTERN

#: Training documents, about, that the attention layer is fitted on in the first round, chosen by a hash of the row.
SAMPLE_DOCUMENTS = 800
#: Share of the training documents that a round fits before the last fits all the others, where that is more.
FITTED_SHARE = 0.02
#: Subword ids that a task fits at once; in the first round repeats count, in whole passes up to the limit.
FITTED_IDS, MOST_PASSES = 2_500_000, 5
#: At most so many words are looked up in a table that every task holds.
FREQUENT_WORDS = 200_000
#: Distinct words that a task counts before it hands them on and forgets them.
HELD_WORDS = 150_000
#: Rows of counts that a task hands on together.
MADE_ROWS = 50_000
#: Tasks that add up the parameters of the parts of a round.
MOST_SUMS = 16
#: Subword ids that are scored together.
CHUNK = 100_000
#: Texts that are taken apart together, and that a task is sent at once.
ROWS = 500
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The word that stands for the end of a text; no word is empty.
END_WORD = b""

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Subwords:
    """Ids of a text: those of its words, with A-Z in lower case and a space before each, then the end.

    Words are numbered as they come.  New ones are encoded together, once for
    all texts of a batch, and cut apart again where an id starts with a space.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.end = len(table)
        self._encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_to_numpy
        self._starts = np.zeros(max(table.values()) + 1, bool)
        self._starts[[i for token, i in table.items() if token[:1] == b" "]] = True
        self.forget()

    def forget(self) -> None:
        """Forget all words; their numbers start again, after the end's."""
        self._number = defaultdict(count(1).__next__, {END_WORD: 0})
        self._spelled, self._first = np.array([self.end], np.int32), np.array([0, 1], np.int32)

    def __len__(self) -> int:
        return len(self._number)

    @property
    def words(self) -> list[bytes]:
        """The words that have numbers, in the order of these."""
        return list(self._number)

    def _learn(self, words: list[bytes]) -> None:
        found = self._encode(b"".join(b" " + w for w in words).decode(), disallowed_special=()).astype(np.int32)
        first = np.flatnonzero(self._starts[found])
        if len(first) != len(words):
            # Unusual white space at the edges of words has taken up a space.
            each = [self._encode((b" " + w).decode(), disallowed_special=()).astype(np.int32) for w in words]
            found, first = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
        ends = len(self._spelled) + np.append(first[1:], len(found))
        self._spelled, self._first = np.append(self._spelled, found), np.append(self._first, ends.astype(np.int32))

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Numbers of the words of texts, and of the end."""
        known = len(self._number)
        found = [np.fromiter(map(self._number.__getitem__, chain(words, (END_WORD,))), np.int32, len(words) + 1) for words in texts]
        new = list(islice(reversed(self._number), len(self._number) - known))
        if new:
            self._learn(new[::-1])
        return found

    def spelled(self, numbers: np.ndarray) -> np.ndarray:
        first = self._first[numbers]
        length = self._first[numbers + 1] - first
        behind = np.cumsum(length, dtype=np.int64)
        return self._spelled[np.arange(behind[-1]) + np.repeat(first - (behind - length), length)]

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        return [self.spelled(x) for x in self.numbers(texts)]


@contextmanager
def _small_batches(spark: SparkSession):
    """Tasks are sent ROWS rows at once, as whole texts by Spark's default number take hundreds of MB in buffers."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def _slices(batches):
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def _texts(batch: pa.RecordBatch) -> list[list[bytes]]:
    """Words of the last column."""
    column = batch.column(batch.num_columns - 1).cast(pa.binary())
    return [x.translate(_LOWER).split() if x else [] for x in column.to_pylist()]


def _stored(vocabulary: int) -> type:
    """Type of the ids in files."""
    return np.uint16 if vocabulary <= 1 << 16 else np.int32


def _ids(column: pa.Array, vocabulary: int) -> list[np.ndarray]:
    return [np.frombuffer(x, _stored(vocabulary)).astype(np.int32) for x in column.to_pylist()]


def _encoded_batches(ranks: bytes):
    """Rows of documents with their ids, and behind them counts, over those learned from, of words and of ids."""
    made = {"row": pa.int64(), "ids": pa.binary(), "word": pa.binary(), "id": pa.int64(), "n": pa.int64()}

    def rows(size: int, given, **columns):
        """Columns of the input, or only their types, and those made here."""
        arrays = [x if isinstance(x, pa.Array) else pa.nulls(size, x) for x in given]
        arrays += [pa.array(columns[name], kind) if name in columns else pa.nulls(size, kind) for name, kind in made.items()]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "text", *made])

    def words_of(subwords, held, types):
        used = np.flatnonzero(held)
        words, n = np.array(subwords.words, object)[used], held[used]
        for i in range(0, len(words), MADE_ROWS):
            part = words[i : i + MADE_ROWS]
            yield rows(len(part), types, word=part, n=n[i : i + MADE_ROWS])

    def run(batches):
        subwords = Subwords(ranks)
        stored = _stored(subwords.end + 1)
        single, held = np.zeros(subwords.end + 1, np.int64), np.zeros(0, np.int64)
        row, types = TaskContext.get().partitionId() << 40, ()
        for batch in _slices(batches):
            types = batch.schema.types
            learned = np.flatnonzero([not x for x in batch.column(1).to_pylist()])
            numbers = subwords.numbers(_texts(batch))
            found = [subwords.spelled(x) for x in numbers]
            if len(learned):
                single += np.bincount(np.concatenate([found[i] for i in learned]), minlength=len(single))
                more = np.bincount(np.concatenate([numbers[i] for i in learned]), minlength=len(held))
                more[: len(held)] += held
                held = more
            if len(subwords) > HELD_WORDS:
                yield from words_of(subwords, held, types)
                subwords.forget()
                held = np.zeros(0, np.int64)
            ids = [x.astype(stored).tobytes() for x in found]
            yield rows(batch.num_rows, batch.columns, row=np.arange(row, row + batch.num_rows), ids=ids)
            row += batch.num_rows
        used = np.flatnonzero(single)
        if len(used):
            yield from words_of(subwords, held, types)
            yield rows(len(used), types, id=used, n=single[used])

    return run


def _pair_batches(vocabulary: int, frequent: np.ndarray):
    """(code, n) for pairs of indices, and behind them for pairs of ids whose second is not frequent."""
    m = len(frequent)

    def rows(code, n):
        for i in range(0, len(code), MADE_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(code[i : i + MADE_ROWS]), pa.array(n[i : i + MADE_ROWS])], names=["code", "n"])

    def run(batches):
        index = np.full(vocabulary, m, np.int64)
        index[frequent] = np.arange(m)
        pairs = np.zeros((m + 1) ** 2, np.int64)
        for batch in _slices(batches):
            texts = _ids(batch.column(0), vocabulary)
            flat = index[np.concatenate([[vocabulary - 1], *texts])]
            # Each text ends with the end mark, which so stands before the next one.
            np.add.at(pairs, flat[:-1] * (m + 1) + flat[1:], 1)
            code, n = np.unique(np.concatenate([_rare_pairs(ids, index, m) for ids in texts]), return_counts=True)
            yield from rows((m + 1) ** 2 + code, n)
        used = np.flatnonzero(pairs)
        yield from rows(used, pairs[used])

    return run


def _rare_pairs(ids: np.ndarray, index: np.ndarray, m: int) -> np.ndarray:
    """Codes of the pairs of a text whose second id is not frequent; the end stands before the text."""
    at = np.flatnonzero(index[ids] == m)
    before = np.where(at > 0, ids[at - 1], len(index) - 1).astype(np.int64)
    return before * len(index) + ids[at]


@dataclass
class RarePairs:
    """Infrequent ids after each id, in all training text.

    The model spreads the probability of the infrequent ids by their own counts;
    here they are spread by those after the id before, and Witten-Bell's share of
    them by their own.  That is ``unseen`` for every pair and a gain for pairs seen.
    """

    kinds: np.ndarray  # by id before
    unseen: np.ndarray  # log10, by id before

    @classmethod
    def of(cls, before: np.ndarray, n: np.ndarray, kinds: np.ndarray, vocabulary: int) -> "RarePairs":
        total, k = np.zeros(vocabulary), np.ones(vocabulary)
        total[before], k[before] = n, kinds
        return cls(k, np.log10(k / (total + k)))

    def gains(self, code: np.ndarray, n: np.ndarray, bigrams: Bigrams) -> np.ndarray:
        before, wanted = np.divmod(code, len(self.kinds))
        return np.log10(1 + n / (self.kinds[before] * np.exp(bigrams.unigram[wanted] - bigrams.log_unseen)))


def _gain_batches(rare: RarePairs, bigrams: Bigrams):
    def run(batches):
        for batch in batches:
            code, n = (batch.column(i).to_numpy() for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rare.gains(code, n, bigrams))], names=["code", "gain"])

    return run


def _fitted_batches(model: AttentionModel, vocabulary: int, most_passes: int):
    """Go on fitting from the model's parameters over all ids of each partition: (ids seen, parameters)."""

    def run(batches):
        seen, held, size = 0, [], 0
        model._tables = None

        def fit():
            before, wanted, _ = windows(held, vocabulary - 1)
            model.train(before, wanted, max(1, min(most_passes, round(FITTED_IDS / size))))

        for batch in batches:
            for ids in _ids(batch.column(0), vocabulary):
                held.append(ids)
                size += len(ids)
                if size > FITTED_IDS:
                    fit()
                    seen, held, size = seen + size, [], 0
        if held:
            fit()
        if seen + size:
            flat = np.concatenate([x.ravel() for x in model.params.values()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([seen + size]), pa.array([flat.tobytes()], pa.binary())], names=["n", "params"])

    return run


def _added_batches(batches):
    """Sums over a partition: (ids seen, parameters times the ids seen)."""
    total, flat = 0, 0.0
    for batch in batches:
        for n, params in zip(*(x.to_pylist() for x in batch.columns)):
            total, flat = total + n, flat + n * np.frombuffer(params, np.float32).astype(float)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([flat.tobytes()], pa.binary())], names=["n", "params"])


def _rounds(size: int) -> list[float]:
    """Shares of the training documents at which rounds of fitting end; the last ends with all of them."""
    start = min(1.0, SAMPLE_DOCUMENTS / max(1, size))
    return sorted({start, max(start, FITTED_SHARE), 1.0})


def _fit_attention(model: AttentionModel, train: DataFrame, vocabulary: int) -> None:
    """Fit on all training documents (``doc_id``, ``ids``), each in one round.

    Rounds grow.  The documents of the first are fitted in whole passes, those of
    the others in parts that go on from the parameters so far, which then are
    averaged by the ids of each part.
    """
    size = train.count()
    draw = F.pmod(F.xxhash64(F.lit("attention"), "doc_id", "ids"), F.lit(1 << 30))
    total = train.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] / np.dtype(_stored(vocabulary)).itemsize
    low = 0
    for share in _rounds(size):
        high = math.ceil(share * (1 << 30))
        # Parts are somewhat smaller than what a task fits at once, as hashes deal them out.
        parts = 1 if low == 0 and share < 1 else math.ceil(1.25 * total * (high - low) / (1 << 30) / FITTED_IDS)
        texts = train.select(draw.alias("draw"), "ids").where(F.col("draw").between(low, high - 1))
        texts = texts.repartition(max(1, parts), "draw").sortWithinPartitions("draw", "ids").select("ids")
        # Fitting needs no probabilities of pairs, which are the most of a model.
        light = copy(model)
        light.bigrams = replace(model.bigrams, log_pair=None)
        made = "n long, params binary"
        passes = MOST_PASSES if low == 0 else 1
        fitted = written(texts.mapInArrow(_fitted_batches(light, vocabulary, passes), made), "lm-parameters")
        sums = fitted.coalesce(MOST_SUMS).mapInArrow(_added_batches, made).collect()
        seen = sum(row["n"] for row in sums)
        flat = sum(np.frombuffer(row["params"]) for row in sums)
        at = 0
        for name, x in model.params.items() if seen else ():
            model.params[name] = (flat[at : at + x.size] / seen).reshape(x.shape).astype(np.float32)
            at += x.size
        model._tables = None
        low = high


def _fit(docs: DataFrame, ranks: bytes, out: Column | None = None) -> tuple[AttentionModel, DataFrame, RarePairs, DataFrame, DataFrame]:
    """(model, counts, rare, gains, encoded), learned from the rows that are not ``out``.

    counts of words over all of them, gains of pairs, by code, and all documents with their ids.
    """
    vocabulary = Subwords(ranks).end + 1
    rows = docs.select("doc_id", (F.lit(False) if out is None else out).alias("held_out"), "text")
    made = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, text string, row long, ids binary, word binary, id long, n long"
    found = written(rows.mapInArrow(_encoded_batches(ranks), made), "lm-encoded")
    encoded = found.where("row is not null").select("row", "doc_id", "held_out", "text", "ids")
    train = encoded.where(~F.col("held_out")).select("doc_id", "ids")
    counts = written(found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    found = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    single = np.zeros(vocabulary)
    single[found["id"].to_numpy()] = found["n"].to_numpy()
    frequent = np.argsort(-single, kind="stable")[: min(FREQUENT, int((single > 0).sum()))]
    pairs_of = train.select("ids").mapInArrow(_pair_batches(vocabulary, frequent), "code long, n long")
    pair_counts = written(pairs_of.groupBy("code").agg(F.sum("n").alias("n")), "lm-pairs")
    m = len(frequent)
    # These codes are bounded by the square of the frequent ids, the ids before by the vocabulary.
    first = (m + 1) ** 2
    found = pair_counts.where(F.col("code") < first).toArrow()
    pairs = np.zeros(first)
    pairs[found["code"].to_numpy()] = found["n"].to_numpy()
    model = AttentionModel(Bigrams.of(single, frequent, pairs.reshape(m + 1, m + 1)))
    seen = pair_counts.where(F.col("code") >= first).select((F.col("code") - first).alias("code"), "n")
    before = F.expr(f"code div {vocabulary}").alias("before")
    found = seen.groupBy(before).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    rare = RarePairs.of(*(found[c].to_numpy() for c in ("before", "n", "kinds")), vocabulary)
    light = replace(model.bigrams, log_pair=None, by_class=None, log_class=None)
    gains = seen.mapInArrow(_gain_batches(rare, light), "code long, gain double")
    _fit_attention(model, train, vocabulary)
    return model, counts, rare, gains, encoded


def _frequent_words(counts: DataFrame) -> tuple[dict[bytes, int], int]:
    """(words of the highest counts, lowest count among them): whole steps of counts, FREQUENT_WORDS at most."""
    step = F.floor(F.log2("n") * 8)
    upto, lowest = 0, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        upto += row["k"]
        if upto > FREQUENT_WORDS:
            break
        lowest = row["n"]
    if lowest is None:
        return {}, 1 << 62
    found = counts.where(F.col("n") >= lowest).toArrow()
    return dict(zip(found["word"].to_pylist(), found["n"].to_pylist())), lowest


def _score_batches(shared, vocabulary: int):
    names = ("n_tokens", "n_known", "base", "score", "rare", "pairs")

    def run(batches):
        model, value, rare_pairs = shared.value
        index, m = model.bigrams.index, len(model.bigrams.log_pair) - 1

        def scored(texts: list[np.ndarray]) -> np.ndarray:
            before, wanted, text = windows(texts, vocabulary - 1)
            found = model.log_probability(before, wanted).sum(1)
            return np.bincount(text, weights=found, minlength=len(texts)) / math.log(10)

        for batch in _slices(batches):
            scores, held, size = [], [], 0
            unseen, codes, code_times, code_offsets = [], [], [], [0]
            n_tokens, n_known, base, rare, times, offsets = [], [], [], [], [], [0]
            for words, ids in zip(_texts(batch), _ids(batch.column(3), vocabulary)):
                code, n = np.unique(_rare_pairs(ids, index, m), return_counts=True)
                unseen.append(float(n @ rare_pairs.unseen[code // len(index)]))
                codes.append(code)
                code_times.append(n)
                code_offsets.append(code_offsets[-1] + len(code))
                held.append(ids)
                size += len(ids)
                if size > CHUNK:
                    scores.append(scored(held))
                    held, size = [], 0
                words.append(END_WORD)
                values = list(map(value.get, words))
                found = [v for v in values if v is not None]
                others = Counter(w for w, v in zip(words, values) if v is None)
                rare.extend(others)
                times.extend(others.values())
                n_tokens.append(len(words))
                n_known.append(len(found))
                base.append(math.fsum(found))
                offsets.append(len(rare))
            if held:
                scores.append(scored(held))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], ["word", "n"])
            code_arrays = [pa.array(np.concatenate(codes), pa.int64()), pa.array(np.concatenate(code_times), pa.int32())]
            code_pairs = pa.StructArray.from_arrays(code_arrays, ["code", "n"])
            arrays = [
                pa.array(n_tokens, pa.int64()),
                pa.array(n_known, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(np.concatenate(scores) + unseen),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                pa.ListArray.from_arrays(pa.array(code_offsets, pa.int32()), code_pairs),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=[*batch.schema.names[:3], *names])

    return run


def score(docs: DataFrame, ranks: bytes, held_out: int = 1) -> DataFrame:
    """Score every document.  Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows of ``docs`` (``doc_id``, ``text``; other columns are not
    read) whose id is not in fold ``held_out``; a null id is in no fold, so its
    row is learned from.  Both scores are log10 probabilities of the words, with
    A-Z in lower case, and an end mark; white space between words counts as one
    space.  Cases: a null or empty text is its end mark; repeated rows count and
    are scored each; an empty table gives no rows.
    """
    out = F.coalesce(fold_of(F.col("doc_id")) == held_out, F.lit(False))
    with _small_batches(docs.sparkSession):
        model, counts, rare_pairs, gains, encoded = _fit(docs, ranks, out)
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    log_total = math.log10(total + 0.5 * (kinds + 1))
    known, lowest = _frequent_words(counts)
    known = {w: math.log10(n + 0.5) - log_total for w, n in known.items()}
    shared = docs.sparkSession.sparkContext.broadcast((model, known, rare_pairs))
    rows = encoded.select("row", "doc_id", "held_out", "ids", "text")
    made = "n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:int>>, pairs array<struct<code:bigint,n:int>>"
    made = f"row long, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, {made}"
    with _small_batches(docs.sparkSession):
        scored = written(rows.mapInArrow(_score_batches(shared, Subwords(ranks).end + 1), made), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    other = counts.where(F.col("n") < lowest)
    value = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(log_total)
    rest = (
        rare.join(other, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * value).alias("rare_base"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    pairs = scored.select("row", F.explode("pairs").alias("x")).select("row", "x.code", F.col("x.n").alias("times"))
    gained = pairs.join(gains, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("gain")).alias("gained"))
    return scored.drop("rare", "pairs").join(rest, "row", "left").join(gained, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gained", F.lit(0.0))).alias("score"),
    )
