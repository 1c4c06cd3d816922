"""Each operator against a plain version of itself, on rows with every oddity."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from llm.conftest import LONG, ODD, PROSE, frame
from tokenizers import Tokenizer

from veilwright.llm import (chat, decontamination, html_text, jaccard_join, packing, ppm, quality, repair, sharding,
                            toxicity)
from veilwright.llm.components import components
from veilwright.llm.queries import BYTE_BPE, WORD_BPE


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def words(text, lower=True):
    b = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", b.lower() if lower else b)


# 1 -----------------------------------------------------------------------------------------------------------------

def linked(docs, percent=90):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if None not in (docs[i][0], docs[j][0]) and common and \
                    100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), None if d is None else least[find(i)], None if d is None else links[i])
                   for i, (d, _) in enumerate(docs))


JOINED = ("doc_id", "n_shingles", "component_id", "n_links")


def test_join_of_odd_rows(odd, none):
    assert rows(jaccard_join.jaccard_join(odd), *JOINED) == linked(ODD)
    assert jaccard_join.jaccard_join(none).count() == 0


def test_join_near_the_limit(spark):
    rng = np.random.default_rng(3)
    docs = []
    for base in range(12):
        size = int(rng.integers(5, 400))
        text = [f"t{base}_{i}" for i in range(size)]
        for _ in range(14):
            copy = list(text)
            for _ in range(int(rng.integers(0, max(2, size // 50)))):
                copy[int(rng.integers(0, size))] = f"n{rng.integers(0, 1000)}"
            docs.append((len(docs), " ".join(copy)))
    small = jaccard_join.JaccardJoin(block_docs=5, leaf=3, fan=2)  # many blocks and deep trees
    assert rows(jaccard_join.jaccard_join(frame(spark, docs), small), *JOINED) == linked(docs)


def test_sets_of_a_large_component_are_not_repeated(spark, monkeypatch):
    """Blocks meet by rounds: what is shuffled to be compared holds a set once, however many blocks its component has."""
    text = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*text, f"n{i}"])) for i in range(60)]
    sent, plain = [], type(spark.range(0)).mapInArrow

    def seen(df, *args, **more):
        if "shingle_set" in df.columns:
            exchanged = "Exchange" in df._jdf.queryExecution().executedPlan().toString()
            sent.append((exchanged, df.count()))
        return plain(df, *args, **more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", seen)
    small = jaccard_join.JaccardJoin(block_docs=5, slab_shingles=3000)
    assert rows(jaccard_join.jaccard_join(frame(spark, docs), small), *JOINED) == linked(docs)
    assert sum(n for exchanged, n in sent if exchanged) <= 60
    assert sum(n for _, n in sent) > 60 and len(sent) > 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 103), 100), **dict.fromkeys(range(200, 260), 200)}


# 2 -----------------------------------------------------------------------------------------------------------------

def check_shards(df, docs, n=16):
    got = df.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots.get(i, ())) for i in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_shards(spark, odd, none):
    check_shards(sharding.shard(odd), ODD)
    assert sharding.shard(none).count() == 0
    docs = [(i, f"copy {i // 3}" if i < 300 else f"text {i}") for i in range(800)]
    got = check_shards(sharding.shard(frame(spark, docs)), docs)
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())


def test_shards_of_a_group_that_fits_none(spark):
    docs = [(i, "same" if i % 3 else f"text {i}") for i in range(480)]
    got = check_shards(sharding.shard(frame(spark, docs)), docs)
    assert len({r.shard for r in got if r.size == 5}) <= 12


# 3 -----------------------------------------------------------------------------------------------------------------

def test_kernel_forgives_gaps():
    k = toxicity.Kernel(["idiot"], 0.75)
    same, gapped, other = k(["idiot", "id-i-ot", "meadow"])[:, 0]
    assert abs(same - 1) < 1e-5 and same > gapped > 20 * other


def kernel_by_hand(a, b, decay):
    def features(w):
        c, out = toxicity._codes(w), Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[c[i], c[j], c[k]] += decay ** (k - i + 1)
        return out
    x, y = features(a), features(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return (sum(v * y[t] for t, v in x.items()) / norm) ** toxicity.POWER


def test_kernel_by_hand():
    for a, b in (("idiot", "idiotic"), ("abcabc", "cabcab"), ("réeux", "réeuxvi"), ("pathetic", "apathetic")):
        assert abs(toxicity.Kernel([a], 0.7)([b])[0, 0] - kernel_by_hand(a, b, 0.7)) < 1e-5


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        w = list(rng.choice(vocabulary, 60))
        toxic = i % 4 == 0
        if toxic:
            w[10], w[30] = "Blockhead!", "blockhead,"
        docs.append((i, ". ".join(" ".join(w[k:k + 12]) for k in range(0, 60, 12))))
        labels.append((i, int(toxic)))
    docs += [(1000, "what a b-lock-head you are. you bloockhead"), (1001, "what a fine day this is"), (1002, None), (1003, "")]
    truth = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(frame(spark, docs), truth).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[1000].score > 2 * got[1001].score and got[1002].predicted == got[1003].predicted == 0
    assert toxicity.classify(odd, truth).count() == len(ODD)
    assert toxicity.classify(none, truth).count() == 0
    assert {r.score for r in toxicity.classify(odd, truth.where("toxic = 0")).collect()} == {0.0}


# 4 -----------------------------------------------------------------------------------------------------------------

def test_scores(odd, none):
    learnt = [(d, t) for d, t in ODD if d is None or zlib.crc32(str(d).encode()) % 10]
    count = Counter(w for _, t in learnt for w in words(t))
    n, v = sum(count.values()) + len(learnt), len(count) + 1
    expected = Counter()
    for d, t in ODD:
        c = [count[w] for w in words(t)] + [len(learnt)]
        base = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in c)
        expected[d, len(c), sum(k > 0 for k in c), n, round(base, 4)] += 1
    small = ppm.Scoring(chunk_bytes=1000, bucket_bytes=50_000)
    got = ppm.score(odd, small).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert ppm.score(none).count() == 0


# 5 and 6 -----------------------------------------------------------------------------------------------------------

def tokenizer(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_shards(spark, odd, none):
    encode = tokenizer(BYTE_BPE)
    got = repair.encode_corpus(odd, repair.RePair(BYTE_BPE, shard_ids=700, least=2)).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    starts = np.cumsum([0, *[r.n_tokens for r in got]])
    assert [r.start for r in got] == starts[:-1].tolist()
    expected = Counter()
    for d, t in ODD:
        x = np.array([*encode(t), 2], "<u4")
        expected[d, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert repair.encode_corpus(none, repair.RePair(BYTE_BPE)).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    p = repair.RePair("", least=2, pairs=50)
    for kind in range(4):
        parts = [np.array(x, np.uint32) for x in (
            [[7] * n for n in (1, 2, 3, 9, 50)], [rng.integers(0, 5, 200) for _ in range(5)],
            [[1, 2, 3] * 20, [2, 3, 1], [9]], [[3]])[kind]]
        row = repair._shard(0, 0, 100, list(range(len(parts))), parts, p)
        row = dict(zip([c.split()[0] for c in repair.FORMAT.split(", ")], row, strict=True))
        assert all((repair.decode_document(row, i) == x).all() for i, x in enumerate(parts))
        if kind == 0:
            assert row["n_ids"] > 2 * len(np.frombuffer(row["symbols"], "<u2"))


def test_packing(odd, none):
    encode = tokenizer(WORD_BPE)
    got = packing.pack(odd, packing.Packing(WORD_BPE, capacity=64)).collect()
    expected = Counter()
    for d, t in ODD:
        x = np.array([*encode(t), 0], "<u4")
        for i, s in enumerate(range(0, len(x), 64)):
            expected[d, i, s, len(x[s:s + 64]), zlib.crc32(x[s:s + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *[n for _, n in b]])[:-1].tolist() and sum(n for _, n in b) <= 64
    assert len(bins) == -(-sum(r.length for r in got) // 64)
    assert packing.pack(none, packing.Packing(WORD_BPE)).count() == 0


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = Counter(rng.integers(1, 12, 6).tolist())
        room = int(rng.integers(0, 30))
        best = {0}
        for x in counts.elements():
            best |= {b + x for b in best if b + x <= room}
        chosen = packing.fullest(dict(counts), sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in chosen.items()) == max(best) and all(counts[k] >= n for k, n in chosen.items())


def test_public_tokenizer_files():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE


# 7 -----------------------------------------------------------------------------------------------------------------

def test_quality(spark, odd, none):
    docs = ODD + [(100, "\n".join(["same line here"] * 4 + ["x"])), (101, PROSE + "### $$$ |"), (102, "a b c d e " * 30)]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.judge(frame(spark, docs)).collect())
    expected = Counter()
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
                 len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    assert got == expected
    assert quality.judge(none).count() == 0


def test_quality_verdict(spark):
    rng = np.random.default_rng(4)
    plain = PROSE.split()
    docs = [(i, " ".join(rng.permutation(plain * 5))) for i in range(40)]
    docs += [(50, " ".join(w + "%$#*&" for w in rng.permutation(plain * 5)))]
    got = {r.doc_id: r for r in quality.judge(frame(spark, docs), quality.QualityRules(repeat_percent=100)).collect()}
    assert all(got[i].kept for i in range(40)) and not got[50].kept
    # The distance by hand.
    counts = {r.doc_id: r for r in quality.features(frame(spark, docs)).collect()}
    whole = np.sum([r.char_counts for r in counts.values()], axis=0)
    a, b = np.array(counts[50].char_counts) / sum(counts[50].char_counts), whole / whole.sum()
    m = (a + b) / 2

    def kl(x):
        return sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u > 0)

    assert abs(got[50].char_distance - math.sqrt((kl(a) + kl(b)) / 2)) < 1e-9


# 8 -----------------------------------------------------------------------------------------------------------------

def test_html():
    show = html_text.extract
    assert show("<p>one<p>two &amp; three<br>four<div>five</div>") == "one\n\ntwo & three\nfour\n\nfive"
    assert show("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>") == "- a\n- b\n  3. x\n  4. y"
    assert show("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x</td><td>22</td></table>") == \
        "name       n\nlong name  1\nx          22"
    assert show("<head><title>t</title><style>p{}</style></head><body>a<script>1<2</script> b<!-- c --></body>") == "a b"
    assert show("<div style='display:none'>no</div><p hidden>no</p>yes<template>no</template>") == "yes"
    assert show("<pre>a\n  b</pre>c") == "a\n  b\n\nc"
    assert show("") == show(None) == "" and show("a < b & c") == "a < b & c" and show("<div") == "<div"
    assert show("<div>" * 5000 + "deep") == "deep"


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    assert rows(html_text.extract_pages(pages), "page_id", "text", "n_chars") == Counter(
        [(1, "a", 1), (None, "", 0), (2, "", 0)])
    assert html_text.extract_pages(pages.where("false")).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------

def test_decontamination(spark, none):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame(
        [(2, item), (10, item), (3, "short item"), (4, None), (5, "..."), (None, item)], "item_id long, text string")
    docs = ODD + [(50, "Intro, words! " + item.upper().replace(" ", "--") + " outro"), (51, "a Short; Item b"),
                  (52, item[:30]), (53, " ".join(["filler"] * 500) + " short item")]

    def plain(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        hit, items = set(), set()
        for name, text in ((2, item), (10, item), (3, "short item")):
            q = text.encode().split()
            k = min(13, len(q))
            windows = {tuple(q[i:i + k]) for i in range(len(q) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    items.add(str(name))
        return (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                bool(hit) and 20 * len(hit) >= len(w))

    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = Counter((d, *plain(t)) for d, t in docs)
    df = frame(spark, docs)
    assert rows(decontamination.scan(df, bench), *columns) == expected
    blocks = decontamination.Decontamination(block_bytes=100)
    assert rows(decontamination.scan(df, bench, blocks), *columns) == expected
    assert rows(decontamination.scan(df, bench.where("false")), "n_hit") == Counter({(0,): len(docs)})
    assert decontamination.scan(none, bench).count() == 0
    spans = {r.doc_id: r.spans for r in decontamination.scan(df, bench).collect()}
    assert b"a Short; Item b"[slice(*spans[51])] == b"Short; Item"


# 10 ----------------------------------------------------------------------------------------------------------------

def test_escapes():
    for text in ("", "<|im_end|>", "\\", "\\<|", "a\\n\n<|<|\\\\", "\\n"):
        for line in (False, True):
            out = chat.escape(text, line)
            assert chat.unescape(out) == text and "<|" not in out and not (line and "\n" in out)


def test_fold(spark):
    log = [(1, 0, "message", None, "user", "hi"), (1, 1, "delta", 1, "assistant", "Hel"), (1, 2, "delta", 1, "assistant", "lo"),
           (1, 3, "edit", 0, "user", "hi there"), (1, 4, "regenerate", 1, "assistant", None), (1, 5, "delta", 1, None, "Good day"),
           (1, 6, "message", None, "user", "x"), (1, 7, "delete", 6, None, None), (2, 0, "delta", None, "assistant", None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string")
    assert rows(chat.fold(events), "conv_id", "seq", "role", "text") == Counter(
        [(1, 0, "user", "hi there"), (1, 1, "assistant", "Good day"), (2, 0, "assistant", "")])


def test_chats(spark):
    table = [(1, 1, "assistant", "b"), (1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", "b"), (2, None, None, None),
             (None, 3, "assistant", "é🙂\\"), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    expected = set()
    for conv in (1, 2, 3, None):
        turns = sorted((r[1:] for r in table if r[0] == conv), key=lambda r: (r[0] or 0))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        made = "".join(chat.Template().turn(r or "", t or "")[0] for _, r, t in turns)
        expected.add((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                      hashlib.sha256(loss.encode()).hexdigest(), len(made)))
    assert {tuple(r) for r in chat.format_chats(chat.as_events(df)).collect()} == expected
    assert chat.format_chats(chat.as_events(df.where("false"))).count() == 0
