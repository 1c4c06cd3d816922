"""Words that are cut and looked up many at a time give what each word alone gives."""

import random

import numpy as np
import pytest

from veilwright.llm import toxicity

LANDMARKS = ["idiot", "words", "haßlich", "x", "common"]


def plainly(text: bytes) -> np.ndarray:
    kernel, out, stop = toxicity.Kernel(LANDMARKS, 0.75), [], True
    for w in text.split():
        row = np.rint(np.minimum(kernel(toxicity.clean(w)), 1) * 255).astype(np.uint8).max(axis=0)
        if stop:
            out.append(row)
        else:
            out[-1] = np.maximum(out[-1], row)
        stop = w.rstrip(b"\"')]*&%$#|").endswith((b".", b"!", b"?"))
    return np.array(out, np.uint8).reshape(-1, len(LANDMARKS))


@pytest.mark.parametrize(("limit", "group"), [(250_000, 1_000_000), (20, 100)])
def test_sentences_are_those_of_single_words(monkeypatch, limit, group):
    monkeypatch.setattr(toxicity.Describer, "LIMIT", limit)
    monkeypatch.setattr(toxicity.Describer, "GROUP", group)
    draw = random.Random(5)
    signs = ["idiot", "Id!ot", "wörds", "ΑΣ", "İ", "x", ".", "!", "?", "\"", ")", "*", "-", "\x00", "\x85", "\xa0", "(", " ", "\n", "\t", "\x0b",
             "\x1c", "y" * 22, "z" * 30, "COMMON", "..."]
    texts = ["".join(draw.choice(signs) + draw.choice([" ", "", " "]) for _ in range(draw.randrange(20))).encode() for _ in range(400)]
    texts = [*texts, b"", None, b" ", b"...", b". a"]
    found = list(toxicity.Describer(toxicity.Kernel(LANDMARKS, 0.75)).texts(texts))
    assert len(found) == len(texts)
    for t, m in zip(texts, found, strict=True):
        assert np.array_equal(m, plainly(t or b"")), t


def test_words_that_differ_by_marks_share_a_row():
    describer = toxicity.Describer(toxicity.Kernel(LANDMARKS, 0.75))
    list(describer.texts([b"Words words, (WORDS) words."]))
    assert describer.table.n == 1


def test_maxima_of_stretches():
    draw = np.random.default_rng(1)
    rows, at = draw.integers(0, 255, (50, 3)).astype(np.uint8), draw.integers(0, 50, 500)
    start = np.unique(np.concatenate(([0], draw.integers(0, 500, 40))))
    assert np.array_equal(toxicity.highest(rows, at, start), np.maximum.reduceat(rows[at], start, axis=0))
