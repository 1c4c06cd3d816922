"""What a worker remembers from task to task."""

import tracemalloc

import numpy as np
import pyarrow as pa

from veilwright.llm import common, jaccard_join, tokenization, toxicity
from veilwright.llm.queries import BYTE_BPE


def profile(text):
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([b"%s" % text]), pa.array([7])], ["doc_id", "text", "text_key"])
    return next(jaccard_join._profile(jaccard_join.JaccardJoin())(iter([batch])))


def test_an_operator_forgets_what_another_one_left():
    describer = toxicity.describer_of(["word", "other"], 0.5)
    list(describer.texts([b"some words in a text"]))
    assert toxicity._describers
    profile(b"these are the words of a text")
    assert not toxicity._describers and len(common.WORD_HASH) == 7
    tokenization.encoder(BYTE_BPE, True).ids(["words"])
    assert not common.WORD_HASH and tokenization._encoders
    profile(b"these are the words of a text")
    assert not tokenization._encoders and len(common.WORD_HASH) == 7


def test_an_operator_keeps_its_own_memory_and_its_results():
    first = profile(b"these are the words of a text")
    common.WORD_HASH.pop(b"words")
    second = profile(b"these are the words of a text")
    assert len(common.WORD_HASH) == 7
    assert first.equals(second)
    one = toxicity.describer_of(["word", "other"], 0.5)
    before = list(one.texts([b"some words. in a text"]))[0]
    assert toxicity.describer_of(["word", "other"], 0.5) is one
    profile(b"these are the words of a text")
    again = toxicity.describer_of(["word", "other"], 0.5)
    assert again is not one
    assert np.array_equal(before, list(again.texts([b"some words. in a text"]))[0])


def test_learning_keeps_the_sentences_as_bytes():
    draw = np.random.default_rng(3)
    words = sorted({"".join(draw.choice(list("abcdefghijklmnop"), 7)) for _ in range(128)})
    rows = [(i % 2, draw.integers(0, 100, (100, len(words))).astype(np.uint8)) for i in range(500)]
    for toxic, m in rows:
        m[0, :8] += np.uint8(150 * toxic)
    tracemalloc.start()
    model = toxicity.learn(words, rows, toxicity.Toxicity())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(m.nbytes for _, m in rows)  # as numbers of eight bytes they alone are eight times as much
    scores = [model.score(model.margins(m)) for _, m in rows]
    assert np.mean(scores[1::2]) > 0.8 and np.mean(scores[0::2]) < 0.2


def test_newton_steps_by_blocks_are_those_of_the_whole_matrix(monkeypatch):
    draw = np.random.default_rng(4)
    cells = draw.integers(0, 255, (300, 6)).astype(np.uint8)
    at = np.flatnonzero(draw.random(300) < 0.8)
    y = np.where(cells[at, 0] + draw.integers(0, 90, len(at)) > 170, 1.0, -1.0)
    c = np.where(y > 0, 3.0, 0.5)
    turn = np.eye(7)
    turn[:6, :6] = draw.random((6, 6)) / 255
    x, w = np.hstack((cells[at], np.ones((len(at), 1)))) @ turn, np.zeros(7)
    ridge = np.diag([1e-3] * 6 + [1e-6])
    for _ in range(30):
        on = y * (x @ w) < 1
        w = np.linalg.solve((x[on] * c[on, None]).T @ x[on] + ridge, x[on].T @ (c[on] * y[on]))
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(toxicity._svm(cells, at, y, c, turn), w, atol=1e-5)
