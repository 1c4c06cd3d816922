"""Operators on inputs that only the whole job gets right."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from llm.conftest import PROSE, frame

from pyspark.sql import functions as F

from veilwright.llm import chat, html_text, jaccard_join, sharding
from veilwright.llm.components import components


def joined(docs, words, percent):
    """Brute force over all pairs: (doc_id, component_id, n_links) of the rows with an id."""
    docs = [(d, t.lower().split()) for d, t in docs if d is not None]
    sets = [{tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for _, w in docs]
    root, links = list(range(len(docs))), [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                root = [root[j] if r == root[i] else r for r in root]
    return Counter((d, min(docs[k][0] for k in range(len(docs)) if root[k] == root[i]), links[i])
                   for i, (d, _) in enumerate(docs))


def found(spark, docs, *p):
    named = jaccard_join.jaccard_join(frame(spark, docs).coalesce(1), *p).where("doc_id is not null")
    return Counter(tuple(r) for r in named.select("doc_id", "component_id", "n_links").collect())


def edited(rng, sizes, copies, share):
    docs = []
    for base, size in enumerate(sizes):
        text = [f"t{base}_{i}" for i in range(size)]
        for _ in range(copies):
            copy = list(text)
            for _ in range(int(rng.integers(0, max(2, size // share)))):
                copy[int(rng.integers(0, len(copy)))] = f"n{rng.integers(0, 1000)}"
            copy += [f"a{rng.integers(0, 1000)}" for _ in range(int(rng.integers(0, max(2, size // 6))))]
            docs.append((len(docs), " ".join(copy)))
    return docs


def test_join_after_a_row_without_id(spark):
    docs = [(None, PROSE * 9 + "end"), (1, PROSE * 9 + "end"), (2, PROSE.replace("fox", "cat") + PROSE * 9 + "end"),
            (3, " ".join(f"w{i}" for i in range(90))), (4, " ".join(f"w{i}" for i in range(92)))]
    docs = [(None, docs[3][1]), *docs]
    assert found(spark, docs) == joined(docs, 3, 90)
    assert joined(docs, 3, 90)[3, 3, 1] == joined(docs, 3, 90)[4, 3, 1] == 1


def test_join_of_many_near_copies_of_one_group(spark):
    rng = np.random.default_rng(8)
    docs = edited(rng, [60] * 3 + [4, 9, 300], 40, 40)
    assert found(spark, docs) == joined(docs, 3, 90)


def test_near_duplicates_of_the_pipeline(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(5, 400, 14)]
    docs = edited(rng, sizes, 12, 40)
    loose, strict = joined(docs, 5, 80), joined(docs, 3, 90)
    assert found(spark, docs, corpus_pipeline.NEAR) == loose
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, docs), SF).collect()} == {
        d for d, c, _ in loose if d == c} != {d for d, c, _ in strict if d == c}


def test_join_meets_few_at_a_low_limit():
    """Few fingerprints say nothing: texts that have no shingle in common share none."""
    rng = np.random.default_rng(6)
    seen = Counter()
    for i in range(600):
        h = jaccard_join.shingles(" ".join(f"x{i}_{k}" for k in range(int(rng.integers(20, 400)))).encode(), 5)
        seen.update(set(jaccard_join.signatures(h, corpus_pipeline.NEAR).tolist()))
    assert sum(n > 1 for n in seen.values()) <= 10


def test_html_below_many_open_elements():
    page = ("a<p style='display:none'>no</p><template>no</template><noscript>no</noscript><ul><li>x<li>y</ul>"
            "<table><tr><th>name<th>n<tr><td>long name<td>1</table><b>z</b> end<div>block</div>tail")
    plain = html_text.extract(page)
    assert "no" not in plain.split() and "- x\n- y" in plain and "long name  1" in plain
    for tag in ("div", "font", "span"):
        assert html_text.extract(f"<{tag}>" * 300 + page) == plain
    assert html_text.extract("<font>" * 100_000 + page) == plain
    assert html_text.extract("<p><table><tr><td>" + "<div>" * 20_000 + "deep</div>er") == "deep\ner"


def test_html_drawings_and_formulas():
    assert html_text.extract("<svg><title>t</title><desc>no</desc><path d='x'/><g/><text>drawn</text></svg> after") == "drawn after"
    assert html_text.extract("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>") == "x=1"


def test_shards_of_a_hot_group_next_to_many_pairs(spark):
    texts = ["hot"] * 1000 + [f"pair {i // 2}" for i in range(1600)] + ["warm"] * 150 + [f"text {i}" for i in range(250)]
    got = sharding.shard(frame(spark, list(enumerate(texts)))).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    homes = defaultdict(set)
    for r in got:
        homes[texts[r.doc_id]].add(r.shard)
    assert len(homes["hot"]) <= 7 and len(homes["warm"]) == 1  # 187 rows a shard: five full ones and a rest of 65
    assert sum(len(homes[f"pair {i}"]) > 1 for i in range(800)) <= 16


def test_shards_of_groups_that_leave_no_room(spark):
    texts = [f"group {i % 24}" for i in range(480)]  # 30 rows a shard, groups of 20: every third one must be split
    got = sharding.shard(frame(spark, list(enumerate(texts)))).collect()
    homes = defaultdict(set)
    for r in got:
        homes[texts[r.doc_id]].add(r.shard)
    assert set(Counter(r.shard for r in got).values()) == {30}
    assert sorted(len(s) for s in homes.values()) == [1] * 16 + [2] * 8


def test_surplus_rows_of_one_group_lie_in_many_buckets(spark, monkeypatch):
    """A third of the rows hold one text: no window slice of the last step holds more than a few times its share."""
    seen = []
    plain = sharding.running

    def watch(df, group, draw, order, weight, name, buckets=None):
        if name == "rank" and list(group) == ["shard"]:
            n = buckets or 256
            rows = df.groupBy("shard", F.floor(draw * n)).count().collect()
            seen.append((max(r["count"] for r in rows), sum(r["count"] for r in rows) / n))
        return plain(df, group, draw, order, weight, name, buckets)

    monkeypatch.setattr(sharding, "running", watch)
    texts = ["hot"] * 3000 + [f"text {i}" for i in range(6001)]
    got = sharding.shard(frame(spark, list(enumerate(texts)))).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len({r.shard for r in got if texts[r.doc_id] == "hot"}) <= 7
    assert all(most < 2 * share for most, share in seen)


def test_components_of_a_hub(spark, setting):
    """Most edges at one node, with and without broadcasts."""
    edges = [(0, i) for i in range(1, 700)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001), (5, 5)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    want = {i: 0 for i in range(700)} | {i: 1000 for i in range(1000, 1061)} | {2000: 2000, 2001: 2000}
    assert {r.node: r.root for r in components(df).collect()} == want
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert {r.node: r.root for r in components(df).collect()} == want


def test_chats_come_through_the_fold(spark):
    """The log that a table is turned into has deltas, edits and regenerations; folded, it is the table again."""
    text = "a long <|im_end|> answer \\ ü 🙂\n" * 90
    rows = [(i % 5, i // 5, "assistant" if i % 2 else "user", text[i:i * 31] if i % 4 else f"short {i}") for i in range(60)]
    rows += [(7, None, None, None), (None, 1, "user", "x"), (7, 1, "user", "same"), (7, 1, "user", "same"), (7, 1, "user", ""),
             (8, 2, "assistant", "a" * 400), (8, 3, "assistant", "b" * 401)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, seq long, kind string")
    log = chat.as_events(df.drop("seq", "kind"))
    kinds = {r["kind"] for r in log.select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}
    folded = Counter((r.conv_id, r.seq, r.role, r.text) for r in chat.fold(log.repartition(5)).collect())
    assert folded == Counter((c, t, r or "", x or "") for c, t, r, x in rows)
    # Columns of other names that clash don't matter.
    assert Counter(map(tuple, chat.format_chats(chat.as_events(df)).collect())) == Counter(
        map(tuple, chat.format_chats(chat.as_events(df.drop("seq", "kind"))).collect()))


@pytest.mark.parametrize("words", [1, 4, 1 << 10])
def test_dropping_many_documents_moves_none(spark, setting, monkeypatch, words):
    """Many names: documents aren't shuffled, and none is lost to a filter that is full by chance. NULL ids and copies too."""
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(corpus_pipeline, "FILTER_WORDS", words)
    docs = spark.range(300).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 150)
                                   .alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(docs.where("doc_id < 40"))
    gone = docs.where("pmod(xxhash64(text), 3) = 0").select("doc_id", corpus_pipeline._text_key().alias("text_key"))
    rest = corpus_pipeline._without(docs, gone, corpus_pipeline._text_key())
    assert rest.columns == docs.columns
    want = docs.where("pmod(xxhash64(text), 3) <> 0")
    assert sorted(map(str, rest.collect())) == sorted(map(str, want.collect()))
    if words > 4:
        clean = rest._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
        assert "LeftAnti" not in clean and "broadcast" in clean
