"""Join of documents by Jaccard similarity of their word n-grams, by MinHash banding.

Each distinct text is one node, however many copies it has.  Its MinHash values
are cut into bands, and nodes that share a band are candidates.  The number of
bands and of rows in a band follows from the recall that is asked for at the
lowest similarity.  Components of the candidate graph bring the texts that are
to be compared together; a large component is cut into blocks, and each pair of
blocks is verified on the full n-gram sets as a product of matrices.  Links are
counted where they are found, and never listed pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.shared import written

#: Words of an n-gram; a text of fewer words is one n-gram.
NGRAM = 5
#: Lowest similarity of a link, and recall that banding must have there.
SIMILARITY, RECALL = 0.8, 0.9999
#: Hash values that a text may have; more of them make fewer false candidates.
MOST_HASHES = 200
#: Texts, and their words, of one block of a component.
BLOCK_TEXTS, BLOCK_WORDS = 400, 400_000
#: Words that are hashed together.
CHUNK = 100_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which ``most`` hashes reach the recall at the similarity."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall cannot be reached with so few hashes")
    return best


def _ngrams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams, how many each text has, and its number of words."""
    words = [text.translate(_LOWER).split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for text in words for w in text]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(flat)}
    code = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    length = np.repeat(np.minimum(counts, n), size)
    mixed = np.full(len(first), n, np.uint64)
    for k in range(n):
        more = k < length
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(more, code[np.where(more, first + k, 0)] if len(code) else 0, 0).astype(np.uint64)
        mixed ^= mixed >> np.uint64(32)
    return mixed, size, counts


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > 6 * CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _sign_batches(n: int, bands: int, rows: int):
    """Replace the last column, the text, by n_words and bands."""

    def run(batches):
        draw = np.random.default_rng(20_011)
        a = draw.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 1 << 63, bands * rows, np.uint64)
        for batch in batches:
            texts = [x or b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            n_words, keys, sizes = [], [], []
            for part in _chunks(texts):
                grams, size, counts = _ngrams(part, n)
                n_words.append(counts), sizes.append(size > 0)
                first = (np.cumsum(size) - size)[size > 0]
                band = np.empty((len(first), bands), np.uint64)
                for k in range(bands if len(first) else 0):
                    key = np.full(len(first), k, np.uint64)
                    for r in range(k * rows, (k + 1) * rows):
                        key = (key ^ np.minimum.reduceat(grams * a[r] + b[r], first)) * np.uint64(0xC2B2AE3D27D4EB4F)
                        key ^= key >> np.uint64(31)
                    band[:, k] = key
                keys.append(band)
            some = np.concatenate(sizes) if sizes else np.zeros(0, bool)
            values = np.concatenate(keys).view(np.int64).ravel() if keys else np.zeros(0, np.int64)
            offsets = np.append(0, np.cumsum(some * bands)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~some) if len(some) else None)
            columns = [*batch.columns[:-1], pa.array(np.concatenate(n_words) if n_words else some.astype(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_words", "bands"])

    return run


def text_keys() -> dict:
    """Two 64-bit hashes that name a text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)}


def _matches(sets: list[np.ndarray], block: np.ndarray, similarity: float, same: bool) -> np.ndarray:
    """Boolean matrix of texts that are similar; between blocks only, unless it is one block."""
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    number = np.diff(np.append(start, len(flat)))
    # An n-gram of one text only adds to no intersection.
    column = np.cumsum(number > 1) - 1
    column, shared = np.repeat(column, number), np.repeat(number > 1, number)
    column, owner = column[shared], owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    near = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(near, False)
    return near if same else near & (block[:, None] != block[None, :])


def _verify_batches(n: int, similarity: float):
    """Rows sorted by (root, i, j) to (node, links, peer) of texts that have links."""

    def links(rows: dict[int, tuple], same: bool):
        nodes = np.array(list(rows), np.int64)
        copies = np.array([r[0] for r in rows.values()], np.int64)
        block = np.array([r[1] for r in rows.values()], np.int64)
        grams, size, _ = _ngrams([r[2] for r in rows.values()], n)
        sets = [np.unique(x) for x in np.split(grams, np.cumsum(size)[:-1])]
        near = _matches(sets, block, similarity, same)
        # The smallest node that is reached by links found here.
        peer = np.arange(len(nodes))
        order = np.argsort(nodes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        label = rank.copy()
        while True:
            reach = np.minimum(label, np.where(near, label[None, :], len(label)).min(1, initial=len(label)))
            if (reach == label).all():
                break
            label = reach
        peer = nodes[order][label]
        some = near.any(1)
        return nodes[some], (near @ copies)[some], peer[some]

    def run(batches):
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("peer", pa.int64())])
        key, rows = None, {}
        for batch in batches:
            names = ("root", "i", "j", "node", "n", "block")
            columns = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names]
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            for r, (root, i, j, node, copies, block) in enumerate(zip(*columns)):
                if key != (root, i, j):
                    if len(rows) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(rows, key[1] == key[2])], schema=schema)
                    key, rows = (root, i, j), {}
                rows[node] = (copies, block, text[r].as_py())
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(rows, key[1] == key[2])], schema=schema)

    return run


def _classes(docs: DataFrame, n: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): every row with the key of its text; every text with its class and links."""
    bands, rows_in_band = banding(similarity, recall)
    keyed = docs.select("doc_id", F.col("text")).withColumns(text_keys())
    rows = written(
        keyed.select("doc_id", "k1", "k2", "text").mapInArrow(
            _sign_batches(n, bands, rows_in_band), f"doc_id {dict(docs.dtypes)['doc_id']}, k1 long, k2 long, n_words long, bands array<long>"
        ),
        "ngram-rows",
    )
    texts = rows.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"),
        F.count("*").alias("n"),
        F.first("n_words").alias("n_words"),
        F.first("bands").alias("bands"),
    )
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "ngram-texts")
    banded = texts.where("bands is not null").select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("last")).where("root < last")
    edges = banded.join(shared, "band").where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    members = connected_components(edges).join(texts.drop("bands"), "node")
    found = _verified(docs, members, n, similarity)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    roots = texts.select("node", "doc_id").join(classes, "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows, (
        texts.drop("bands")
        .join(classes, "node", "left")
        .join(roots, "root", "left")
        .join(links, "node", "left")
        .select(
            "k1",
            "k2",
            "doc_id",
            "n_words",
            F.coalesce("root", "node").alias("class"),
            F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )


def _verified(docs: DataFrame, members: DataFrame, n: int, similarity: float) -> DataFrame:
    """node, links, peer of the members of candidate components."""
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_words").alias("words"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_TEXTS, F.col("words") / BLOCK_WORDS)).cast("int")
    placed = members.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    keyed = docs.select("doc_id", "text").withColumns(text_keys())
    same = (keyed.k1 == placed.k1) & (keyed.k2 == placed.k2) & keyed.doc_id.eqNullSafe(placed.doc_id)
    fetched = placed.join(keyed, same).select("root", "node", "n", "block", "blocks", keyed.text)
    pairs = fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "block", "text"
    )
    dealt = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return written(dealt.mapInArrow(_verify_batches(n, similarity), "node long, links long, peer long"), "ngram-links")


def ngram_join(
    docs: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """Class and number of links of every document.  Columns: doc_id, class_id, n_links.

    One row per row of ``docs`` (``doc_id``, ``text``; other columns are not
    read).  Two documents are linked if their sets of n-grams, of words with A-Z
    in lower case, have a Jaccard similarity of at least ``similarity``; classes
    are connected by links and named by their smallest id.  Cases: a text of
    fewer than ``n`` words is one n-gram; null texts and texts without a word
    have no n-grams, no links, and are classes by themselves; repeated rows
    count as copies; a class has a null name if all its ids are null; an empty
    table gives no rows.
    """
    rows, texts = _classes(docs, n, similarity, recall)
    named = texts.select("k1", "k2", "class_id", "n_links")
    none = F.col("n_words") == 0
    return rows.select("doc_id", "n_words", "k1", "k2").join(named, ["k1", "k2"]).select(
        "doc_id",
        F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay if each class keeps its document of the smallest id.

    Documents without a word stay; of rows equal in id and text one stays.
    """
    rows, texts = _classes(docs, n, similarity, recall)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("x")
    chosen = texts.where("n_words > 0").groupBy("class").agg(first).select("x.doc_id", "x.k1", "x.k2")
    chosen = chosen.unionByName(rows.where("n_words = 0").select("doc_id", "k1", "k2").distinct())
    chosen = chosen.select(*[F.col(c).alias(f"_{c}") for c in chosen.columns])
    keys = {f"_t{name}": column for name, column in text_keys().items()}
    keyed = docs.withColumns(keys)
    same = (F.col("_tk1") == F.col("_k1")) & (F.col("_tk2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    stay = keyed.join(chosen, same).dropDuplicates(["_tk1", "_tk2", "_doc_id"])
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
