"""Phrases against a count by hand, with budgets that make every part of the partitioning work."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veilwright.llm import collocations
from veilwright.llm.collocations import Chunk, Collocations, mine, subtree, unpack, words_of

COLUMNS = "doc_id long, text string, lang string, rank int, phrase string, n long"


def plain(rows, p):
    """lang → rows (rank, phrase, a, l, r, n, score), counted phrase by phrase."""
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for m in range(1, 5):
                count[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = {}
    for lang, f in count.items():
        kept = []
        often = [g for g, a in f.items() if a >= p.least and len(g) > 1]
        for g in often:
            a = f[g]
            longer = [h for h in often if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))]
            if any(100 * f[h] >= p.inside * a for h in longer):
                continue
            score, _, l, r = min((p.scale * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        kept.sort()
        out[lang] = [(i + 1, name.decode(), -a, l, r, total[lang], -score)
                     for i, (score, a, name, l, r) in enumerate(kept[:p.top])]
    return {lang: v for lang, v in out.items() if v}


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.lang].append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    return {lang: sorted(v) for lang, v in out.items()}


def corpus(rng, n):
    """Zipf words, one pair and one passage that stand nearly everywhere, odd blanks and marks, several languages."""
    rows = []
    for i in range(n):
        words = [f"W{min(int(x), 60)}" for x in rng.zipf(1.4, 40)]
        text = "".join(w + str(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " é "])) for w in words)
        if i % 3:
            text = "of the " * 4 + text + " New York City Hall opens"
        rows.append((i, text, [None, "en", "en", "en", "und", "ß"][i % 6]))
    return rows + [(None, "of the same", "en"), (7, None, "en"), (8, "", None), (9, " \t ..", "leer")]


@pytest.mark.parametrize("p", [
    Collocations(least=5, budget=60, small=1, chunk=500),  # heavy prefixes of one to three words
    Collocations(least=5, top=4, inside=50),
    Collocations(least=3, inside=101, budget=10_000, small=200),
], ids=["heavy", "top", "all"])
def test_same_as_counting(spark, p):
    rows = corpus(np.random.default_rng(5), 120)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS).repartition(3)
    assert found(mine(docs, p)) == plain(rows, p)


def test_repeated_rows_and_ties(spark):
    """Equal scores go by count, then by bytes; a row that occurs 40 times counts 40 times."""
    rows = [(1, "b a. d c. é è", "en")] * 40 + [(2, "z y. z y", "en")] * 20
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS)
    got = found(mine(docs))
    assert [x[1] for x in got["en"]] == ["b a", "d c", "z y", "é è"] and got == plain(rows, Collocations())


def test_no_rows(spark, none, odd):
    docs = spark.createDataFrame([], COLUMNS)
    out = mine(docs)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
    assert mine(none).count() == 0
    assert mine(odd, Collocations(least=3)).where("phrase = 'the quick'").count() in (0, 1)


def test_long_text_is_cut_between_words(spark, monkeypatch):
    """Suffixes at the cut of a slice see the words after it."""
    monkeypatch.setattr(collocations, "SLICE", 7)
    words = [f"w{i % 11}" for i in range(400)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(words).encode()]})]
    count = Counter()
    for _, chunk in collocations._chunks(iter(batches), 50):
        windows, n = chunk.counted()
        names = collocations._joined(collocations._spelled(chunk), windows, 4).to_pylist()
        count.update(dict(zip(names, n.tolist(), strict=True)))
    assert count == Counter(" ".join(words[i:i + 4] + [""] * max(0, i + 4 - len(words))).encode() for i in range(400))


def test_codes_are_bounded():
    chunk = Chunk()
    chunk.add([b"x%d" % i for i in range(60_000)], [])
    assert chunk.holds([b"x1"] * 9000) and not chunk.holds([b"y%d" % i for i in range(9000)])
    assert words_of("A.b\tC\n\n\x0bd".encode()) == [b"a", b".", b"b", b"c", b".", b".", b".", b"d"]


def test_subtree_reads_counts_from_leaves():
    leaves = [("a b c d", 3), ("a b c e", 2), ("a b  ", 1), ("a c  ", 4), ("b   ", 9)]
    rows = []
    for some in (leaves[:2], leaves[2:]):  # packed by two tasks
        words = sorted({w for s, _ in some for w in s.split(" ")})
        codes = np.array([[words.index(w) for w in s.split(" ")] for s, _ in some], "<u2")
        rows.append(("x", " ".join(words).encode(), codes.tobytes(), np.array([n for _, n in some], "<u4").tobytes()))
    nodes = subtree(*unpack(iter(rows)), {("x", b"a"): 100}, 2)
    assert sorted((phrase, n, before) for _, phrase, _, n, before in nodes) == [
        ("a b", 6, [100]), ("a b c", 5, [100, 6]), ("a b c d", 3, [100, 6, 5]), ("a b c e", 2, [100, 6, 5]),
        ("a c", 4, [100]), ("b", 9, [])]


def test_packed_suffixes_come_back(monkeypatch):
    """Rows of a task, unpacked, hold every suffix as often as the text does."""
    words = [f"w{i % 23}" for i in range(900)]
    plan = collocations.Partition({("en", b"w3"): 1}, [("en", b"w1 "), ("en", b"w20 "), ("en", b"w3 w4 w5 "), ("en", b"w5 ")])
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "text": [" ".join(words).encode(), b"w3. w3 w4! w9"]})

    class Held:
        value = plan

    count = Counter()
    for out in collocations._route(Held, 300)(iter([batch])):
        for row in out.to_pylist():
            names, spelled, of, code, n = unpack(iter([(row["lang"], row["words"], row["codes"], row["counts"])]))
            for c, k in zip(code.tolist(), n.tolist(), strict=True):
                suffix = b" ".join(spelled[i] for i in c)
                assert row["group"] == plan.group("en", suffix + b" ")
                count[suffix] += k
    expected = Counter(" ".join(words[i:i + 4] + [""] * max(0, i + 4 - len(words))).encode() for i in range(900))
    assert count == expected + Counter([b"w3   ", b"w3 w4  ", b"w4   ", b"w9   "])
