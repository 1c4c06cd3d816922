"""Benchmark passages in documents, found with one Aho-Corasick automaton.

Windows of ``words`` consecutive words of each benchmark item (an item of fewer words is one window) are patterns of
a single automaton over word numbers. Every document is scanned once, whole; each hit marks its words, and hit words map
back to offsets of the original text.

The automaton grows with the benchmark, not with the corpus. Items are collected in blocks whose bytes are summed
first, and a benchmark beyond ``block_bytes`` is scanned for block after block: the driver holds two at most, and each result is written to
the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import arrays, remembers, texts

#: Bytes below 0x80 that are no ASCII letter or digit become blanks; everything else is part of a word.
BLANKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Decontamination:
    """Contaminated: at least one hit word, and at least ``percent`` percent of the document's words are hit."""

    words: int = 13
    percent: int = 5
    block_bytes: int = 32_000_000


def item_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(BLANKS).split() if text else []


class Windows:
    """The automaton of a block of items and the items of each window."""

    def __init__(self, items: list[tuple], words: int) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in item_words(text)]
            for i in range(max(1, len(w) - words + 1) if w else 0):
                found.setdefault(tuple(w[i:i + words]), set()).add(item)
        self.items = [sorted(s, key=str) for s in found.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, key in enumerate(found):
            self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.any = bool(found)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Marks of hit words (None: no hit) and the items with occurring windows."""
        if not self.any or not words:
            return None, set()
        get = self.number.get
        hits = list(self.automaton.iter(tuple([get(w, 0) for w in words])))
        if not hits:
            return None, set()
        edge = np.zeros(len(words) + 1, np.int64)
        items: set = set()
        for end, (window, n) in hits:
            edge[end + 1 - n] += 1
            edge[end + 1] -= 1
            items.update(self.items[window])
        return np.cumsum(edge[:-1]) > 0, items


SCAN = "doc_id long, text_key long, n_words long, hits array<int>, items array<long>, spans array<int>"


def _scan(block, p: Decontamination):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("windows", lambda: None)
        windows = Windows(block.value, p.words)
        for batch in batches:
            n, hits, items, spans = [], [], [], []
            for (text,) in arrays(batch, "text"):
                words = item_words(text)
                marks, found = windows.scan(words)
                n.append(len(words))
                if marks is None:
                    hits.append([])
                    items.append([])
                    spans.append([])
                    continue
                edges = np.diff(np.concatenate(([0], marks.view(np.int8), [0])))
                first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
                at = [m.span() for m in WORD.finditer(text.lower())]
                hits.append(np.stack((first, last), 1).ravel().tolist())
                spans.append([x for a, b in zip(first, last, strict=True) for x in (at[a][0], at[b][1])])
                items.append(sorted(found, key=str))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")),
                 batch.column(batch.schema.get_field_index("text_key")), pa.array(n, pa.int64()),
                 pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64())),
                 pa.array(spans, pa.list_(pa.int32()))],
                ["doc_id", "text_key", "n_words", "hits", "items", "spans"])
    return job


def _blocks(benchmark: DataFrame, p: Decontamination) -> Iterator[list[tuple]]:
    """Items (id, text) by block, one block at a time; a block is collected only after its bytes are known to be few."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")) \
        .where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // p.block_bytes))
    if n == 1:
        yield [(r[0], bytes(r[1])) for r in rows.collect()]
        return
    dealt = stage(rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(2 * n))), "items")
    for i in range(2 * n):
        yield [(r[0], bytes(r[1])) for r in dealt.where(F.col("block") == i).select("item_id", "text").collect()]


def scan(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (byte offsets of hit passages in the
    UTF-8 text, start and end by turns), text_key.

    A NULL or empty text has no words and no hits, a NULL id stays NULL, repeated rows are scanned each by itself. Items
    without id or words have no window; an empty benchmark hits nothing. Only the named columns are read.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("text_key", F.xxhash64("text"))
    blocks = _blocks(benchmark, p)
    shared, more = spark.sparkContext.broadcast(next(blocks)), next(blocks, None)
    if more is None:
        return _digest(rows.mapInArrow(_scan(shared, p), SCAN), p)
    parts = []
    while shared is not None:
        # The driver and the workers hold one block; its scan is written before the next one is taken.
        parts.append(stage(rows.mapInArrow(_scan(shared, p), SCAN), "scan"))
        shared.destroy()
        shared, more = (spark.sparkContext.broadcast(more), next(blocks, None)) if more is not None else (None, None)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _digest(_joined(whole, len(parts)), p)


def _joined(scans: DataFrame, blocks: int) -> DataFrame:
    """The scans of all blocks as one: a block's rows of a document are one in each scan; repeated rows are alike."""
    keys = ["doc_id", "text_key", "n_words"]
    whole = scans.groupBy(*keys).agg(
        (F.count(F.lit(1)) / blocks).cast("int").alias("copies"),
        F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.flatten(F.collect_set("spans")).alias("spans"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def _digest(scans: DataFrame, p: Decontamination) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), (F.size("hits") / 2).cast("int") - 1),
                        lambda i: F.sequence(F.get("hits", (2 * i).cast("int")), F.get("hits", (2 * i + 1).cast("int"))))
    n_hit = F.when(F.size("hits") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(pairs)))).cast("long")
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    with_hits = scans.withColumn("n_hit", n_hit)
    return with_hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= p.percent * F.col("n_words"))).alias("contaminated"),
        "spans", "text_key")
