"""The training-text operators against brute force, round trips and edge cases."""

import base64
import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from plumbline.llm import (
    attention_lm,
    chat,
    decontaminate,
    html_text,
    language,
    lm_scoring,
    mixing,
    ngram_join,
    quality,
    queries,
    sharding,
    token_counts,
)
from plumbline.llm.components import connected_components
from tests.compare import duck, duck_result, spark_result

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, node long"


def documents(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, lang, s, None, -1, "h", 0) for i, t, lang, s in rows], DOCS)


LONG = "la casa de the word " * 3000
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (None, "some words without an id", None, None),
    (4, "same text in two rows of words", "en", "b"),
    (4, "same text in two rows of words", "en", "b"),
    (5, "123 456 !!!", "en", "a"),
    (6, LONG, "es", "b"),
    (7, "one", "en", None),
]


@pytest.fixture(scope="module")
def ranks():
    return token_counts.read_ranks(queries.RANKS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert spark_result(registered.queries()[name](spark, SF_DIR)) == duck_result(duck(SF_DIR), queries.SQL[name])


def test_native_mixing_has_no_python(spark):
    plan = registered.queries()["op2_mix_sources"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "InPandas", "InArrow", "Cartesian"))


def test_edge_rows_and_empty_tables(spark, ranks):
    docs, bench = documents(spark, EDGES), spark.createDataFrame([(1, "la casa de the word")], "item_id long, text string")
    operators = {
        "lm": lambda d: lm_scoring.score(d, ranks),
        "mix": mixing.mix,
        "mixed": mixing.mixed,
        "decontaminate": lambda d: decontaminate.contamination(d, bench),
        "language": lambda d: language.identify(d, language.train(d)),
        "quality": quality.quality,
        "tokens": lambda d: token_counts.count_tokens(d, ranks),
        "join": ngram_join.ngram_join,
        "keep": ngram_join.keep_one,
        "shard": sharding.shard,
    }
    for name, operator in operators.items():
        assert operator(docs.limit(0)).count() == 0, name
        rows = operator(docs).collect()
        assert name in ("mixed", "keep") or len(rows) == len(EDGES), name
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7]
    joined = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()}
    assert joined[4] == (4, 1) and joined[1] == (1, 0) and joined[2] == (2, 0) and joined[None] == (None, 0)
    found = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 5)) and found[6].lang_pred in ("en", "es")
    hits = {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, bench).collect()}
    assert hits[6] and not hits[4]


def test_other_tables_edges(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/x", "<p>x &amp; y"), (2, None, None), (3, "http://a/y", ""), (3, "http://a/y", "")],
        "page_id long, url string, html string",
    )
    assert sorted((r.page_id, r.text) for r in html_text.extract(pages).collect()) == [(1, "x & y"), (2, ""), (3, ""), (3, "")]
    assert html_text.extract(pages.limit(0)).count() == 0
    talks = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "a", "hi <|end|>"), (1, 2, "b", None), (None, None, None, "x"), (2, 0, "system", "only")],
        "conv_id long, turn long, role string, text string",
    )
    rows = {(r.conv_id, r.perspective): r for r in chat.rotate(talks).collect()}
    assert set(rows) == {(1, "a"), (1, "b"), (None, "unknown")}
    mine = rows[1, "a"]
    assert [mine.text[s.start : s.end] for s in mine.spans] == ["hi < |end|><|end|>"]
    assert "<|user name=b|>\n<|end|>" in mine.text and chat.rotate(talks.limit(0)).count() == 0


def test_wu_manber_is_brute_force():
    draw = random.Random(3)
    words = [b"a", b"b", b"c", b"d"]
    for _ in range(300):
        items = [(str(i), b" ".join(draw.choices(words, k=draw.randint(0, 9)))) for i in range(4)]
        text = draw.choices(words, k=draw.randint(0, 60))
        spans, named = decontaminate.search(text, decontaminate.tables(items, 5))
        hit, want = set(), set()
        for name, item in items:
            w = item.split()
            m = min(5, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for k in range(len(text) - m + 1):
                    if text[k : k + m] == w[i : i + m]:
                        want.add(name)
                        hit |= set(range(k, k + m))
        assert {i for a, b in spans for i in range(a, b)} == hit and named == want


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.contamination(docs, bench, keep=["doc_id"]).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, decontaminate.contamination(docs, bench, keep=["doc_id"]).collect())) == whole


def test_ngram_join_is_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    common, own = collections.Counter(), collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            own[g].append(i)
    for v in own.values():
        common.update(itertools.combinations(sorted(v), 2))
    root, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in common.items():
        if k >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
            links.update((a, b))
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {i: (find(i), links[i]) for i in sets}


def test_blocks_of_a_component_give_the_same(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"x{n}"] + base[k:]) for n, k in enumerate(draw.choices(range(200), k=60))]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    whole = sorted(map(tuple, ngram_join.ngram_join(docs).collect()))
    assert {c for _, c, _ in whole} == {0} and all(n == 59 for _, _, n in whole)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    assert sorted(map(tuple, ngram_join.ngram_join(docs).collect())) == whole


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), *((100 + i, 101 + i) for i in range(30))]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **{100 + i: 100 for i in range(31)}}


def test_banding_reaches_the_recall():
    for s, recall in ((0.8, 0.9999), (0.5, 0.99)):
        bands, rows = ngram_join.banding(s, recall)
        assert 1 - (1 - s**rows) ** bands >= recall and bands * rows <= ngram_join.MOST_HASHES


def test_mixing_is_near_its_targets_and_nested(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    full = {r.doc_id: r for r in mixing.mix(docs).collect()}
    half = {r.doc_id: r for r in mixing.mix(docs, share=0.5).collect()}
    assert all(half[i].times <= full[i].times <= 3 for i in full)
    taken, largest, target = collections.Counter(), collections.Counter(), {}
    for r in full.values():
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.times for r in full.values())


def test_packing():
    draw = random.Random(1)
    for _ in range(50):
        items = [(draw.randint(1, 100), i) for i in range(draw.randint(1, 60))]
        room, want = {}, []
        for size, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
            fits = [(r, b) for b, r in room.items() if r >= size]
            r, b = min(fits) if fits else (120, len(room))
            room[b] = r - size
            want.append((item, b))
        assert sharding.pack(items, 120) == want


def test_shards_are_even_whole_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs, 16).join(docs, "doc_id").collect()
    size, slots, texts = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        assert r.text_crc32 == zlib.crc32(r.text.encode())
        size[r.shard] += len(r.text.encode()) + 1
        slots[r.shard].append(r.slot)
        texts[r.text].add(r.shard)
    assert len(size) == 16 and max(size.values()) <= 1.03 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in texts.values())


def test_language_of_held_out_and_of_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = registered.queries()["op6_identify_language"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    model = language.train(docs)
    first = {x: docs.where((F.col("lang") == x) & (F.col("n_chars") > 500)).first().text[:400] for x in ("en", "de")}
    row = language.identify(documents(spark, [(1, first["en"] + " " + first["de"], None, None)]), model).first()
    assert [s.lang for s in row.spans] == ["en", "de"] and abs(row.spans[0].end - 400) < 20


def test_quality_measures_are_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for r in docs.collect():
        w, lines = r.text.encode().split(), [x for x in r.text.split("\n") if x.split()]
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        kept = not failed and all(rule.keeps([r.text.encode()])[0] for rule in quality.RULES)
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols) == (len(w), len(b"".join(w).decode()), sum(r.text.count(c) for c in "#*$%&|<>"))
        assert (x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) == (len(lines) - len(set(lines)), len(hit), failed, kept)


def test_token_tree_follows_edits(ranks):
    counter, draw = token_counts.Counter(ranks), random.Random(2)
    pieces = ["a", "b", " ", "  ", "\n", "'", "'re", "r", "1", "23", ".", "!", "é", "あ", "<|endoftext|>"]
    for _ in range(300):
        tree = token_counts.TokenTree("".join(draw.choices(pieces, k=draw.randint(0, 80))), counter, draw.choice([1, 2, 5]))
        for _ in range(4):
            a = draw.randint(0, len(tree.text))
            tree.apply(token_counts.Edit(a, min(len(tree.text), a + draw.choice([0, 1, 9])), "".join(draw.choices(pieces, k=draw.randint(0, 5)))))
            assert tree.n_tokens == counter.whole(tree.text) and tree.sums[1][0] == len(tree.text)
    text = "word " * 5000 + "me@example.org" + " word" * 5000
    tree = token_counts.TokenTree(text, counter)
    tree.apply_all(token_counts.redactions(text))
    assert tree.n_tokens == counter.whole(text.replace("me@example.org", "<mail>")) and tree.encoded < 300


def test_html_structure_and_shared_runs():
    menu = "".join(f"<li>menu {i}</li>" for i in range(9))
    page = "<html><head><title>t</title></head><body>{m}<nav>x</nav><div class='ad box'><div>buy</div></div><p>own {i}<br>b &lt;</p><script>'</p>'</script><p>end{i}"
    pages = [html_text.blocks(page.format(m=menu, i=i)) for i in range(3)]
    assert list(html_text.main_texts(pages, 8, 2)) == [f"own {i} b <\nend{i}" for i in range(3)]
    article = "<article><h1>T</h1><p>" + "same words in all pages " * 4 + "</p></article>"
    assert next(html_text.main_texts([html_text.blocks(menu + article)] * 2, 8, 2)).startswith("T\nsame words")


@pytest.mark.parametrize(
    "inside, text",
    [
        ('<p>a</p><svg class="i"/><p>rest', "a\nrest"),
        ('<p>a</p><svg class="i"/><p>rest</p><svg><path/></svg><p>b', "a\nrest\nb"),
        ("<p>a</p><svg><p>rest</p><svg><text>x</text></svg><p>b", "a\nrest\nb"),
        ("<p>a<svg><foreignObject><div>x</div></foreignObject></svg> b", "a b"),
        ("<p>a</p><iframe src=x><p>rest", "a\nrest"),
        ("<p>a</p><textarea><p>rest", "a\nrest"),
        ("<p>a</p><title><p>rest", "a\nrest"),
        ("<p>a</p><template><p>rest", "a\nrest"),
        ("<p>a <math><mi>x</mi></math> b <math/> c <noscript>d</noscript>", "a x b c d"),
        ("<p>a</p><script>x<p>rest", "a"),
        ("<p>a<iframe>x</iframe> b", "a b"),
    ],
)
def test_elements_without_an_end_take_no_text_along(inside, text):
    assert list(html_text.main_texts([html_text.blocks(f"<article>{inside}")], 8, 2)) == [text]


def test_repetition_decides_beside_an_article():
    notice = "<div>this notice is on all of the pages of the host</div>"
    page = "<body><h1>Headline {i}</h1><div>lead of its own {i}</div>{n}<article><p>body {i}</p></article></body>"
    pages = [html_text.blocks(page.format(i=i, n=notice)) for i in range(3)]
    assert list(html_text.main_texts(pages, 8, 2)) == [f"Headline {i}\nlead of its own {i}\nbody {i}" for i in range(3)]


def test_copies_of_a_page_are_one_page(spark):
    body = "<nav>{n}</nav><p>a text without an article that is in the table three times</p>"
    notice = "<p>this notice is on two distinct pages of the host</p>"
    rows = [(1, "http://a/x", body.format(n=1)), (1, "http://a/x", body.format(n=1)), (2, "http://a/x?ref=b", body.format(n=2))]
    rows += [(3, "http://a/y", notice + "<p>one"), (4, "http://a/z", notice + "<p>two"), (4, "http://a/z", notice + "<p>two")]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    own = "a text without an article that is in the table three times"
    assert sorted((r.page_id, r.text) for r in found) == [(1, own), (1, own), (2, own), (3, "one"), (4, "two"), (4, "two")]


@pytest.mark.parametrize("least", [2, 3])
def test_parts_of_a_host_change_nothing(spark, monkeypatch, least):
    draw = random.Random(5)
    notices = [" ".join(draw.choices("abcdefgh", k=10)) for _ in range(30)]
    html = ["".join(f"<p>{n}</p>" for n in draw.sample(notices, 3)) + f"<p>own {i}" for i in range(40)]
    rows = [(i, f"http://{'ab'[i % 2]}/{i}", x) for i, x in enumerate(html + html[:10])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def texts():
        return sorted((r.page_id, r.url, r.text) for r in html_text.extract(pages, 8, least).collect())

    whole = texts()
    monkeypatch.setattr(html_text, "PART_BYTES", 100)
    assert texts() == whole
    assert 0 < sum(t.count("\n") for _, _, t in whole) < 3 * len(rows)


def test_shared_runs_are_brute_force():
    draw = random.Random(4)
    for _ in range(200):
        streams = [draw.choices("abc", k=draw.randint(0, 12)) for _ in range(3)]
        run = draw.choice([1, 2, 3, 5])
        for p, cover in enumerate(html_text.covered(streams, run, 2)):
            want = [False] * len(streams[p])
            for i in range(len(streams[p]) - run + 1):
                part = streams[p][i : i + run]
                if sum(any(s[k : k + run] == part for k in range(len(s) - run + 1)) for s in streams) >= 2:
                    want[i : i + run] = [True] * run
            assert list(cover) == want


def test_attention_sums_to_one_and_scores_each_token_once():
    draw = np.random.default_rng(0)
    counts = np.append(draw.integers(0, 50, 30), 40)
    frequent = np.argsort(-counts, kind="stable")[:20]
    model = attention_lm.AttentionModel(attention_lm.Bigrams.of(counts, frequent, draw.integers(0, 5, (20, 20))))
    text = draw.integers(0, 30, 100).astype(np.int32)
    before, wanted, _ = attention_lm.windows([text], 30)
    assert (wanted[wanted >= 0] == text).all()
    model.train(before, wanted, 2)
    total = sum(np.exp(model.log_probability(before[1:2], np.full((1, attention_lm.STRIDE), w))) for w in range(31))
    assert np.allclose(total, 1, atol=1e-4)
    # What comes later changes nothing.
    changed = before.copy()
    changed[1, -1] = (changed[1, -1] + 1) % 30
    a, b = model.log_probability(before, wanted), model.log_probability(changed, wanted)
    assert np.allclose(a[1, :-1], b[1, :-1]) and np.allclose(a[0], b[0])


def test_gradient_is_that_of_the_score_and_reads_each_id_once(monkeypatch):
    draw = np.random.default_rng(4)
    counts = np.append(draw.integers(0, 50, 30), 40)
    frequent = np.argsort(-counts, kind="stable")[:20]
    model = attention_lm.AttentionModel(attention_lm.Bigrams.of(counts, frequent, draw.integers(0, 5, (20, 20))))
    before, wanted, _ = attention_lm.windows([draw.integers(0, 9, n).astype(np.int32) for n in (70, 5, 33)], 30)
    into = {n: np.zeros_like(x) for n, x in model.params.items()}
    read, projected = [], attention_lm.AttentionModel._projected
    monkeypatch.setattr(attention_lm.AttentionModel, "_projected", lambda m, token: read.append(len(token)) or projected(m, token))
    model._gradient(before, wanted, into)
    assert read == [len(np.unique(np.where(before >= 0, model.bigrams.index[before], 0)))] and read[0] < 12
    model.params = {n: x.astype(float) for n, x in model.params.items()}
    for name, x in model.params.items():
        way, losses = draw.standard_normal(x.shape), []
        for step in (1e-7, -1e-7):
            model.params[name], model._tables = x + step * way, None
            losses.append(-model.log_probability(before, wanted).sum() / (wanted >= 0).sum())
        model.params[name] = x
        assert math.isclose((losses[0] - losses[1]) / 2e-7, (into[name] * way).sum(), rel_tol=1e-3, abs_tol=1e-5), name


def test_base_scores_are_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    words = {i: t.encode().lower().split() + [b""] for i, t in docs.items()}
    counts = collections.Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    total, kinds = sum(counts.values()), len(counts)
    for r in registered.queries()["op1_lm_score"](spark, SF_DIR).collect():
        want = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.train_tokens == total
        assert r.n_tokens == len(words[r.doc_id]) and r.n_known == sum(counts[w] > 0 for w in words[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and -1e7 < r.score < 0


def test_counts_of_infrequent_ids_are_used():
    ids = np.arange(6)
    counts, frequent = np.array([50, 40, 5, 3, 2, 30]), np.array([0, 1, 5])
    rare = lm_scoring.RarePairs.of(np.array([0, 3]), np.array([7, 2]), np.array([2, 1]), 6)
    seen = {(0, 2): 6, (0, 4): 1, (3, 4): 2}
    whole = np.array([[9, 9, 9, 7], [9, 9, 9, 0], [9, 9, 9, 3], [1, 30, 1, 2]])
    bigrams = attention_lm.Bigrams.of(counts, frequent, whole)
    assert bigrams.log_pair[3, 1] > bigrams.log_pair[3, 0] + 1 and bigrams.log_pair[0, 3] > bigrams.log_pair[1, 3] + 0.5
    for before in ids:
        n = np.array([seen.get((before, w), 0) for w in (2, 3, 4)])
        gain = rare.gains(before * 6 + np.array([2, 3, 4]), n, bigrams) + rare.unseen[before]
        found = 10**gain * np.exp(bigrams.unigram[[2, 3, 4]] - bigrams.log_unseen)
        assert math.isclose(found.sum(), 1, rel_tol=1e-6) and (before != 0 or found.argmax() == 0)


def test_infrequent_pairs_of_all_documents_count(spark, ranks, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 4)
    monkeypatch.setattr(lm_scoring, "SAMPLE_DOCUMENTS", 3)
    monkeypatch.setattr(lm_scoring, "FITTED_SHARE", 0.5)
    first, second = ["red", "blue", "green", "black"], ["dog", "cat", "bird", "fish"]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1][:8]
    learned = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1][:80]
    rows = [(i, f"the {first[k % 4]} {second[k % 4]} the", "en", "a") for k, i in enumerate(learned)]
    rows += [(i, f"the {first[k % 4]} {second[(k + k // 4) % 4]} the", "en", "a") for k, i in enumerate(held)]
    score = {r.doc_id: r.score for r in lm_scoring.score(documents(spark, rows), ranks).collect()}
    assert min(score[i] for i in held[:4]) > max(score[i] for i in held[4:]) + 0.5


def test_frequent_ids_are_those_of_all_documents(spark, ranks, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAMPLE_DOCUMENTS", 1)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 30)
    words = "one two three four five six seven eight nine ten".split()
    train = documents(spark, [(i, f"{words[i % 10]} " * 5, "en", "a") for i in range(200)]).select("doc_id", "text")
    bigrams = lm_scoring._fit(train, ranks)[0].bigrams
    subwords = lm_scoring.Subwords(ranks)
    assert all((bigrams.index[x] < len(bigrams.log_pair) - 1).all() for x in subwords.ids([[w.encode()] for w in words]))


def test_attention_is_fitted_on_all_training_documents(spark, ranks, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAMPLE_DOCUMENTS", 5)
    fitted, written = [], lm_scoring.written

    def kept(df, name):
        out = written(df, name)
        if name == "lm-parameters":
            fitted.append(out)
        return out

    monkeypatch.setattr(lm_scoring, "written", kept)
    rows = [(i, f"number {i} of {i % 7} rows " * (1 + i % 3), "en", "a") for i in range(60)]
    assert lm_scoring.score(documents(spark, rows), ranks).count() == 60
    learned = [t.encode().split() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert sum(r.n for f in fitted for r in f.collect()) == sum(map(len, lm_scoring.Subwords(ranks).ids(learned)))


def test_words_are_spelled_alike_whatever_was_forgotten(spark, ranks, monkeypatch):
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=token_counts.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    texts = [f"Some {chr(97 + i % 5)}{i} words\u0085 \u3000 twice Twice {'é' * (i % 3)} {'x' * i}" for i in range(40)] + [""]
    words = [t.translate(str.maketrans(queries._UPPER, queries._LOWER)).encode().split() for t in texts]
    want = [[x for w in ws for x in plain.encode_ordinary(" " + w.decode())] + [plain.max_token_value + 1] for ws in words]
    subwords = lm_scoring.Subwords(ranks)
    for low in range(0, len(words), 7):
        numbers = subwords.numbers(words[low : low + 7])
        assert [subwords.spelled(x).tolist() for x in numbers] == want[low : low + 7]
        assert [[subwords.words[i] for i in x] for x in numbers] == [[*w, lm_scoring.END_WORD] for w in words[low : low + 7]]
        if low == 14:
            subwords.forget()
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 10)
    monkeypatch.setattr(lm_scoring, "ROWS", 3)
    counts = lm_scoring._fit(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), ranks)[1]
    assert {r.word: r.n for r in counts.collect()} == collections.Counter(w for ws in words for w in [*ws, lm_scoring.END_WORD])


def test_language_model_sends_texts_in_small_batches(spark, ranks, monkeypatch):
    sent, written, default = {}, lm_scoring.written, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def kept(df, name):
        sent[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return written(df, name)

    monkeypatch.setattr(lm_scoring, "written", kept)
    assert lm_scoring.score(documents(spark, EDGES), ranks).count() == len(EDGES)
    assert sent["lm-encoded"] == sent["lm-scored"] == lm_scoring.ROWS < int(default)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == default


def test_pipeline_applies_each_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    language_kept = corpus_pipeline.known_language(spark, docs, SF_DIR)
    assert language_kept.columns == docs.columns and language_kept.count() == docs.where("text rlike '[a-zA-Z]'").count()
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    classes = {r.doc_id: r.class_id for r in ngram_join.ngram_join(language_kept).collect()}
    bad = {r.doc_id for r in registered.queries()["op4_decontaminate"](spark, SF_DIR).where("contaminated").collect()}
    stay = {i for i, c in classes.items() if i == c} - bad
    times = {r.doc_id: r.times for r in mixing.mix(docs.where(F.col("doc_id").isin(*stay))).collect()}
    assert collections.Counter(r.doc_id for r in got) == collections.Counter({i: n for i, n in times.items() if n})
