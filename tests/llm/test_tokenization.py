"""Ids of texts cut at white space, and pairs found by a table."""

import random

import numpy as np
import pytest

from veilwright.llm import repair, tokenization
from veilwright.llm.queries import BYTE_BPE, WORD_BPE

FILES = [(BYTE_BPE, True), (WORD_BPE, False)]


@pytest.mark.parametrize(("path", "keeps_space"), FILES)
@pytest.mark.parametrize("limit", [300, 1_000_000])
def test_ids_are_those_of_the_plain_call(monkeypatch, path, keeps_space, limit):
    monkeypatch.setattr(tokenization, "LIMIT", limit)
    draw = random.Random(3)
    signs = [" ", "\n", ",", ".", "a", "B", "don't", "'S", "é", "ΑΣ", "ß", "中文", "́", "\xa0", "\t", "\x00", "<|endoftext|>", "1", "23",
             "y" * 22 + ",", "y" * 23, "y" * 24 + ".", "q" * 40, "İ", "word", "word,", "Word.", "(a),", "foo-bar,", "ÀÉ,", "</w>", "Ġ"]
    texts = ["".join(draw.choice(signs) if draw.random() < 0.7 else " " for _ in range(draw.randrange(14))) for _ in range(3000)]
    texts += ["", None, " ", "\n", "a", "\na", "a\n", "one line\nand another, with stops.\nEnd."]
    encoder = tokenization.Encoder(path, keeps_space)
    found = [x for s in range(0, len(texts), 250) for x in encoder.ids(texts[s:s + 250])]
    plain = encoder.full.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in found] == [e.ids for e in plain]


@pytest.mark.parametrize(("path", "keeps_space"), FILES)
def test_a_word_is_encoded_once_whatever_stands_around_it(monkeypatch, path, keeps_space):
    encoder, asked = tokenization.Encoder(path, keeps_space), []
    words = encoder._words
    monkeypatch.setattr(encoder, "_words", lambda w: asked.extend(w) or words(w))
    encoder.ids(["and some words, words. and words" + ("" if keeps_space else " WORDS Words"), "and some words, more."])
    # In byte-level ids a word that begins a line is another one: it has no blank.
    assert sorted(asked) == ["and", "more", "some", "words"]


def test_pieces_met_again_stay_when_the_table_is_full():
    pieces = tokenization.Pieces(10, np.dtype("H"), [b""])
    keys = np.array([[i, 0, 1 << 56] for i in range(12)], np.uint64)
    pieces.enter(keys, np.arange(24, dtype="H"), np.full(12, 2))
    pieces.again[pieces.find(keys[3:5])] = True
    pieces.turn()
    at = pieces.find(keys)
    assert np.flatnonzero(at >= 0).tolist() == [3, 4]
    assert pieces.ids[tokenization.spread(pieces.first[at[3:5]], pieces.size[at[3:5]])].tolist() == [6, 7, 8, 9]


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
@pytest.mark.parametrize("table", [True, False])
def test_occurrences_of_pairs(monkeypatch, kind, table):
    if not table:
        monkeypatch.setattr(repair, "FACTORS", [])
    draw = np.random.default_rng(4)
    keys = draw.integers(0, 3000, 20_000).astype(kind) * kind(65537)
    chosen = np.unique(keys)[::7]
    at, slot = repair.occurrences(keys, chosen)
    assert at.tolist() == np.flatnonzero(np.isin(keys, chosen)).tolist()
    assert (chosen[slot] == keys[at]).all()
