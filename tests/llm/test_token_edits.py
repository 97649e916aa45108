"""Edits of long texts, and of texts in small blocks."""

import random
import time

import pytest

from plumbline.llm import queries, token_counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.read_ranks(queries.RANKS))


@pytest.mark.parametrize(("block", "look"), [(1, 1), (3, 2), (7, 5), (64, 1)])
def test_blocks_and_windows_of_any_size_give_the_same(counter, monkeypatch, block, look):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    monkeypatch.setattr(token_counts, "LOOK", look)
    draw = random.Random(block)
    pieces = ["a", "b", " ", "  ", "\n", "'", "'re", "r", "e", "v", "1", "23", ".", "!", "é", "あ", "\n\n", " x"]
    for _ in range(300):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 60)))
        tree = token_counts.TokenTree(text, counter, draw.choice([1, 2, 5]))
        for _ in range(5):
            a = draw.randint(0, len(text))
            b = min(len(text), a + draw.choice([0, 1, 2, 9, 30]))
            new = "".join(draw.choices(pieces, k=draw.randint(0, 12)))
            tree.apply(token_counts.Edit(a, b, new))
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.n_chars == len(text) == tree.sums[1][0]
            assert tree.n_tokens == counter.whole(text) and tree.n_pieces == len(counter.pattern.findall(text))


def test_many_edits_of_a_long_text_take_seconds(counter):
    text = "write to me@example.org or call +49 170 1234567 about it. " * 20_000
    began = time.process_time()
    tree = token_counts.TokenTree(text, counter)
    edits = token_counts.redactions(text)
    tree.apply_all(edits)
    assert time.process_time() - began < 60
    wanted = text.replace("me@example.org", "<mail>").replace("+49 170 1234567", "<number>")
    assert len(edits) == 40_000 and tree.text == wanted and tree.n_tokens == counter.whole(wanted)


def test_numbers_inside_of_mails_are_left_to_the_mail():
    text = "12345678@example.org 1234567890 x@1234567.org 9876543210"
    kinds = sorted((e.start, e.text) for e in token_counts.redactions(text))
    assert [k for _, k in kinds] == ["<mail>", "<number>", "<mail>", "<number>"]
