"""Merkle manifest, packing and alignment against brute force, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as registered
import corpus_pipeline
from plumbline.llm import alignment, merkle, packing, queries
from tests.llm.alignment_brute import brute

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, start long, n_a long, g string, row long, path string"


def documents(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, "own", 7, 7, "own", 7, "own") for r in rows], DOCS)


LONG = "la casa de the Word " * 4000
EDGES = [
    (1, "a", "en", 3, None),
    (2, "a", None, None, ""),
    (None, None, None, None, None),
    (None, None, None, None, None),
    (4, "b", "en", 9, "Same Text"),
    (4, "b", "en", 9, "Same Text"),
    (4, "b", "en", 9, "other text"),
    (5, "", "en", 1, LONG),
    (6, "é", "fr", 2, "naïve ▁ sign <|endoftext|> 日本"),
]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, path of (left, right) of every node)."""
    paths, level, own = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for path, i in zip(paths, own):
            run = level[i // 16 * 16 :][:16]
            path.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        own = [i // 16 for i in own]
        level = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def manifest_rows(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) by plain loops."""

    def leaf(doc_id, source, lang, n_chars, text):
        return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))

    groups = collections.defaultdict(list)
    for r in rows:
        changed = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            changed = (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r[0], leaf(*changed)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort()
        trees.append(tree([x[2] for x in groups[name]]))
    root, above = tree([t[0] for t in trees])
    out = []
    for name, (subroot, paths), upper in zip(names, trees, above):
        for (_, _, own, doc_id, changed), path in zip(groups[name], paths):
            folded = changed
            for left, right in path + upper:
                folded = sha(left, folded, right)
            out.append((doc_id, own, subroot, root, sha(*(a + b for a, b in path + upper)), folded, folded == root))
    return sorted(out, key=repr)


def spark_manifest(docs):
    lowered = F.translate("text", queries._UPPER, queries._LOWER)
    own = merkle.leaf_digest([F.col(c) for c in merkle.COLUMNS])
    changed = merkle.leaf_digest([lowered if c == "text" else F.col(c) for c in merkle.COLUMNS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed).otherwise(own)
    rows = merkle.manifest(docs, keep={"doc_id": F.col("doc_id"), "tampered": tampered})
    folded = merkle.fold(F.col("tampered"), F.col("path"))
    chosen = ["doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), folded, folded == F.col("root")]
    return sorted((tuple(r) for r in rows.select(*chosen).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [300, 2, 15], [1] * 20, [260] + [3] * 300])
def test_manifest_is_brute_force(spark, sizes):
    draw = random.Random(len(sizes))
    rows = [(draw.randrange(10**6), f"s{k}" if k else None, "en", 3, draw.choice(["Abc", "abc", "x", None])) for k, n in enumerate(sizes) for _ in range(n)]
    assert spark_manifest(documents(spark, rows)) == manifest_rows(rows)


def test_manifest_edges(spark, monkeypatch):
    docs = documents(spark, EDGES)
    assert spark_manifest(docs) == manifest_rows(EDGES)
    assert merkle.manifest(docs.limit(0)).count() == 0
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    assert spark_manifest(docs) == manifest_rows(EDGES)


def test_manifest_windows_hold_a_block_at_most(spark):
    docs = documents(spark, [(i, "one", "en", 1, "same") for i in range(3000)])
    rows = merkle.manifest(docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("block" in x.rsplit("], [", 2)[-2] for x in windows)
    assert rows.select("root").distinct().count() == 1 and not any(x in plan for x in ("Python", "InArrow", "CartesianProduct"))


@pytest.fixture(scope="module")
def word_model():
    return (queries.TOKENIZERS / "word_bpe_49k.json").read_text()


def whole(pieces):
    """Ids of documents by doc_id, put together from their pieces; checks sequences."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    padded = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= packing.CAPACITY
        padded += packing.CAPACITY - at
    return by_doc, padded


def test_packing_holds_each_id_once_with_little_padding(spark, word_model):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(40)
    by_doc, padded = whole(packing.pack(docs, word_model).collect())
    tokenizer, total = Tokenizer.from_str(word_model), 0
    for r in docs.collect():
        want = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == want.tobytes() and {p.doc_tokens for p in own} == {len(want)}
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        total += len(want)
    assert padded < 0.02 * total + packing.CAPACITY


def test_packing_edges(spark, word_model):
    docs = documents(spark, EDGES)
    pieces = packing.pack(docs, word_model).collect()
    by_doc, padded = whole(pieces)
    assert [p.ids for p in by_doc[1]] == [p.ids for p in by_doc[2]] == [b"\2\0\0\0"] and len(by_doc[None]) == 2 and len(by_doc[4]) == 3
    assert sum(p.length for p in by_doc[5]) == 20001 and max(p.length for p in by_doc[5]) == packing.CAPACITY
    assert padded < packing.CAPACITY + packing.MOST_ROOM * len(pieces)
    assert packing.pack(docs.limit(0), word_model).count() == 0


def test_words_by_ranks_are_those_of_the_tokenizer(word_model):
    draw, encoder = random.Random(3), packing.WordEncoder(word_model, known=500)
    signs = "abcXYZ'stremvdl.,;!?0123456789éÉßñÑçœŒ<|>-_&%$#@ªº²½µÀÿŸǅǆȺĳĲİΣσ́ \n\t\x1f\x85\xa0日"
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 60))) for _ in range(2000)]
    texts += ["I'LL don't 'S", "<|endoftext|> x<|startoftext|>y", "<|x|>", "x" * 5000, "ΑΣ"]
    found = [x for i in range(0, len(texts), 100) for x in encoder.ids(texts[i : i + 100])]
    wanted = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert found == wanted


def test_packer_takes_the_tightest_window_and_emits_the_fullest():
    packer = packing.Packer(capacity=10, windows=2, most_room=2)

    def add(name, n):
        packer.add((name,), 0, memoryview(b"1234" * n), n)

    add("a", 5), add("b", 6), add("c", 4)
    assert [[p[0][0] for p in w.pieces] for w in packer.closed] == [["b", "c"]]
    add("d", 8), add("e", 6)
    # None takes e; the fullest, d, has little room and is emitted; e gets a window of its own.
    assert [p[0][0] for p in packer.closed[-1].pieces] == ["d"] and len(packer.open) == 2
    add("f", 7)
    # The fullest has much room now and takes the head of f.
    assert [(p[0][0], p[1], len(p[2]) // 4) for p in packer.closed[-1].pieces] == [("e", 0, 6), ("f", 0, 4)]
    packer.pour()
    assert sum(w.filled for w in packer.closed) == 5 + 6 + 4 + 8 + 6 + 7 and not packer.open


@pytest.fixture(scope="module")
def encoders():
    return alignment.Encoders((queries.TOKENIZERS / "byte_bpe_50k.json").read_text(), (queries.TOKENIZERS / "piece_bpe_32k.model").read_bytes())


def test_alignment_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = registered.queries()["op12_align_tokenizers"](spark, SF_DIR).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute([(r.doc_id, r.text) for r in docs]))


@pytest.mark.parametrize("work", [1, 2, 7, 100, 1 << 16])
def test_pieces_of_any_size_give_the_same(encoders, work):
    draw = random.Random(5)
    signs = [*"ab cd  \n\t.,'s1é<>日😀́\x85\x1f\0ſ§“”İ▁", "<|endoftext|>", "<s>", "</s>", " the ", " world"]
    texts = [None, "", " ", "a ", " a", "  ", "\n", *("".join(draw.choices(signs, k=draw.randint(1, 40))) for _ in range(300))]
    columns = [c.to_pylist() for c in alignment.aligned(encoders, texts, work)]
    counts = collections.Counter()
    for pairs, times in zip(*columns[5:]):
        counts.update(dict(zip(pairs, times)))
    wanted = brute(list(enumerate(texts)))
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in columns[4]]
    assert list(zip(*columns[:4], digests)) == [(*w[1:5], w[7]) for w in wanted]
    sums = [sum(counts[p] * n for p, n in zip(pairs, times)) for pairs, times in zip(*columns[5:])]
    assert sums == [w[6] for w in wanted]


def test_crossings_divide_the_work():
    a, b = np.array([1, 4, 4, 9, 20]), np.array([2, 4, 20])
    crossings = alignment.merge_path(a, b, 2)
    assert crossings.sum(1).tolist() == [0, 2, 4, 6, 8]
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    for i, j in crossings:
        assert sorted([(x, 0) for x in a[:i]] + [(x, 1) for x in b[:j]]) == merged[: i + j]


def test_alignment_edges_and_infrequent_pairs(spark, encoders):
    docs = documents(spark, EDGES)
    model_a, model_b = (queries.TOKENIZERS / "byte_bpe_50k.json").read_text(), (queries.TOKENIZERS / "piece_bpe_32k.model").read_bytes()
    rows = alignment.align(docs, model_a, model_b)
    none = {r.doc_id for r in rows.where("n_a = 0 AND n_b = 0 AND groups = '' AND size(pairs) = 0").collect()}
    assert none == {1, 2, None, 6} and rows.count() == len(EDGES)
    counts = alignment.pair_counts(rows)
    wanted = {r.row: tuple(r) for r in alignment.link_sums(rows, counts).collect()}
    for frequent in (0, 3):
        assert {r.row: tuple(r) for r in alignment.link_sums(rows, counts, frequent).collect()} == wanted
    assert alignment.align(docs.limit(0), model_a, model_b).count() == 0


CLASHING = ["lang_pred", "Score", "spans", "N_words", "items", "n_hit", "Contaminated", "row", "_made", "_tk1", "_k1", "h"]


@pytest.mark.parametrize("change", [str.lower, str.upper])
def test_pipeline_keeps_columns_of_its_input(spark, change):
    texts = [(i, f"the casa of and de la word {i} " * 5 if i else None) for i in range(12)] + [(None, "ohne eine nummer und der das")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({change(c): F.lit(f"own {c}") for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            kept = stage(spark, rows, SF_DIR)
            assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString(), name
        got = stage(spark, docs, SF_DIR).collect()
        assert got and all(r[change(c)] == f"own {c}" for r in got for c in CLASHING), name
    assert corpus_pipeline.sharded(spark, docs, SF_DIR).count() == len(texts)
