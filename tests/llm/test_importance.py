"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from llm.conftest import LONG, ODD, frame

from veilwright.llm import importance
from veilwright.llm.importance import Features, Resampling, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def windows(text, p):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % p.buckets
                    for k in range(1, p.words + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, p):
    """(doc_id, words, features, weight, score, rank) of each row, in no order."""
    found = [(i, *windows(t, p)) for i, t in docs]
    s = Counter(b for _, _, bs in found for b in bs)
    t = Counter(b for x in target for b in windows(x, p)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + p.buckets) / ((s[b] + 1) * (all_t + p.buckets)))) for b in s}
    rows = []
    for i, n, bs in found:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        if i is None:
            score = None
        else:
            h = int(hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, n, len(bs), weight, score, None])
    able = sorted([r for r in rows if r[1] >= p.least_words and r[4] is not None], key=lambda r: (-r[4], r[0]))
    for place, r in enumerate(able[:p.percent * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, rows), key=str)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()], key=str)


TARGET = ["Seven other animals look on", None, "", "a quick question about the stone wall", "漢字 Ünïcode"]


def items(spark, texts=TARGET):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


@pytest.mark.parametrize("p", [Resampling(percent=50, least_words=1), Resampling(words=3, buckets=50, percent=40, least_words=2),
                               Resampling(words=2, buckets=100_000, percent=100, least_words=3, seed="s")])
def test_same_as_plain(spark, p):
    docs = [(i, t) for i, t in ODD if t is None or len(t) < 10_000] + [
        (100 + i, " ".join(f"w{(i * j) % 17}  ,x" for j in range(i % 40))) for i in range(150)]
    out = resample(frame(spark, docs).repartition(3), items(spark), p)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank", "text_key"]
    assert got(out) == plain(docs, TARGET, p)


def test_windows_reach_over_the_cuts(monkeypatch):
    p = Resampling(words=3, buckets=1000)
    for size in (1, 7, 50, 4096):
        monkeypatch.setattr(importance.chunks, "__defaults__", (size,))
        for text in ("", "one", "One two", "a-b  c\x00d e f g", "漢字 ab " * 9, LONG[:5000], "x" * 500 + " y z"):
            n, found = Features(p).of(text.encode())
            words, expected = windows(text, p)
            assert n == words and Counter(found.tolist()) == Counter(expected)


def test_odd_rows(spark, odd, none):
    rows = {r.doc_id: r for r in resample(odd, items(spark)).collect() if r.doc_id is not None}
    assert (rows[3].n_features, rows[3].weight, rows[3]["rank"]) == (0, 0, None) and rows[8].n_words == 80_000 // 2
    assert resample(none, items(spark)).count() == 0
    # An empty target is no error, and neither is one whose texts are all missing.
    assert resample(odd, items(spark).where("false")).count() == resample(odd, items(spark, [None])).count() == len(ODD)
    assert all(r["rank"] is None for r in resample(odd, items(spark), Resampling(percent=0)).collect())


def test_invalid_bytes_are_no_error():
    assert Features(Resampling()).of(b"a \xff\xfe b\xc3")[0] == 3


def test_same_draw_under_other_partitions(spark):
    docs = [(i % 90, f"text number {i % 7} with words {i % 11} " * 4) for i in range(180)]  # repeated ids
    one = got(resample(frame(spark, docs).repartition(1), items(spark), Resampling(percent=30)))
    assert one == got(resample(frame(spark, docs).repartition(5), items(spark), Resampling(percent=30)))
    assert sorted(r[5] for r in one if r[5]) == list(range(1, 55))
