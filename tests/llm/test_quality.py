"""The verdict of the quality rules against a plain version, and documents that the word rule alone must reject."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from llm.conftest import SCHEMA

from veilwright.llm import quality
from veilwright.llm.quality import CLASSES, COMMON, QualityRules, judge

ENGLISH = "the of and to in is that for it with as was on be by this are from or at".split()
FRENCH = "le la les de des et en un une du que qui dans pour pas sur par au".split()


def invented(rng, n):
    return ["".join(rng.choice(list("aeiourstln"), int(rng.integers(3, 9)))) for _ in range(n)]


def prose(rng, n, common):
    """Invented words, one in four a common one; short sentences."""
    made = invented(rng, n)
    words = [str(rng.choice(common)) if rng.random() < 0.25 else w for w in made]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def corpus():
    rng = np.random.default_rng(11)
    rows = [(i, prose(rng, int(rng.integers(60, 400)), ENGLISH), "en") for i in range(260)]
    rows += [(1000 + i, prose(rng, int(rng.integers(60, 400)), FRENCH), "fr") for i in range(160)]
    rows += [(2000 + i, prose(rng, 200, ENGLISH), "xx") for i in range(5)]  # too few for a reference
    bad = [(5000, prose(rng, 300, FRENCH), "en"), (5001, prose(rng, 300, ENGLISH), "fr"),
           (5002, " ".join(invented(rng, 300)), "en"), (5003, " ".join(invented(rng, 250)), "fr")]
    short = [(6000, " ".join(invented(rng, 30)), "en")]  # too short to say
    return rows + bad + short + [(7000, None, "en"), (7001, "", None), (None, prose(rng, 100, ENGLISH), "en")]


def distance(a, b):
    if not sum(a) or not sum(b):
        return None
    a, b = np.array(a) / sum(a), np.array(b) / sum(b)
    m = (a + b) / 2

    def part(x):
        return sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u > 0)

    return math.sqrt(max(0.0, (part(a) + part(b)) / 2))


def limit(values, p):
    """From whole steps, as counts of steps would give it."""
    steps = sorted(math.floor(v * quality.STEPS) for v in values)

    def percentile(share):
        return next(s for i, s in enumerate(steps) if 100 * (i + 1) >= share * len(steps)) / quality.STEPS

    return percentile(50) + p.spread * (percentile(50) - percentile(10))


def plain(rows, p):
    made = []
    for d, text, lang in rows:
        text, lang = text or "", lang or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        known = [x.lower() for x in w if x.lower() in COMMON]
        classes = [sum(1 for ch in text if (ch.isupper() if name == "upper" else re.match(e, ch))) for name, e in CLASSES]
        letters = sum(map(len, w))
        seen = defaultdict(int)
        for i in range(len(w) - 4):
            seen[tuple(w[i:i + 5])] += 1
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < p.least_words or 100 * len(hit) > p.repeat_percent * len(w)
        made.append((d, lang, len(w), failed, [*classes, len(text) - letters, letters - sum(classes)],
                     [known.count(x) for x in COMMON] + [len(w) - len(known)]))
    sums = {}
    for lang in {r[1] for r in made}:
        good = [r for r in made if r[1] == lang and not r[3]]
        if len(good) >= p.least_documents:
            sums[lang] = (np.sum([r[4] for r in good], axis=0), np.sum([r[5] for r in good], axis=0))
    far = [(distance(r[4], sums[r[1]][0]), distance(r[5], sums[r[1]][1])) if r[1] in sums else (None, None) for r in made]
    bands, whole = defaultdict(list), defaultdict(list)
    for r, (_, w) in zip(made, far, strict=True):
        if not r[3] and r[2] >= p.word_words and w is not None:
            bands[r[1], math.floor(2 * math.log2(r[2]))].append(w)
            whole[r[1]].append(w * math.sqrt(r[2]))
    out = {}
    for r, (c, w) in zip(made, far, strict=True):
        kept = not r[3] and not (c is not None and r[2] >= p.char_words and c > p.char_limit)
        if kept and w is not None and r[2] >= p.word_words:
            own = bands[r[1], math.floor(2 * math.log2(r[2]))]
            most = limit(own, p) if len(own) >= p.least_documents else limit(whole[r[1]], p) / math.sqrt(r[2])
            kept = w <= max(p.word_floor, most)
        out[r[0]] = kept
    return out


@pytest.mark.parametrize("p", [QualityRules(), QualityRules(spread=2.0, least_documents=60, word_words=100)])
def test_verdict_equals_plain(spark, p):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in rows], SCHEMA).repartition(3)
    assert {r.doc_id: r.kept for r in judge(docs, p).collect()} == plain(rows, p)


def test_word_rule_alone_rejects(spark):
    """Another language's documents and documents without common words have plain characters, so only the word rule can tell."""
    rows = corpus()
    docs = spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in rows], SCHEMA)
    got = {r.doc_id: r for r in judge(docs).collect()}
    for d in (5000, 5001, 5002, 5003):
        assert not got[d].kept and not got[d].base_failed and got[d].char_distance < QualityRules().char_limit
    sound = [got[d].kept for d, _, _ in rows if d is not None and d < 5000]
    assert sum(sound) >= 0.98 * len(sound) and got[6000].kept
    assert not got[7000].kept and not got[7001].kept and got[None].kept
    # Too few documents for a reference: the plain rules decide.
    assert all(got[2000 + i].kept and got[2000 + i].word_distance is None for i in range(5))
