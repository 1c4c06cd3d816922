"""Token-id shards compressed by Re-Pair grammars, with random access by document.

Ids are written in ascending doc_id order into shards. In a shard, frequent pairs of neighbouring symbols are replaced by new
symbols, round after round; a round replaces its most frequent pairs together, overlaps resolved from the left. No rule
crosses the end of a document. A shard stores its rules, their expansion lengths, the symbols that are left and where each
document begins, so one document is decoded from its own symbols alone.

A shard is a row of a Parquet table, committed by Spark's own writer: a lost executor leaves no half shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.staging import scratch_path
from .common import column, partitions
from .tokenization import encoder


FACTORS = [0x9E3779B97F4A7C15 * n % (1 << 64) for n in range(1, 129, 2)]  # tried in turn


@dataclass(frozen=True)
class RePair:
    """``shard_ids``: a shard is closed at so many ids. ``rounds`` of at most ``pairs`` new rules, each for a pair that occurs
    ``least`` times or more in the shard."""

    tokenizer: str
    keeps_space: bool = True
    end_id: int = 2
    shard_ids: int = 1_000_000
    rounds: int = 5
    pairs: int = 2000
    least: int = 24


def compress(ids: np.ndarray, ends: np.ndarray, base: int, p: RePair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, which of them end a document, and the rules (n x 2) of symbols base, base+1, ..."""
    # Two symbols make one key; small vocabularies fit in half the bytes and sort in half the time.
    half = 16 if base + p.rounds * p.pairs < 1 << 16 else 32
    kind = np.uint32 if half == 16 else np.uint64
    shift, low = kind(half), kind((1 << half) - 1)
    never = kind(2 ** (2 * half) - 1)  # the key of no pair: no symbol is that large
    seq, stops = ids.astype(kind), np.flatnonzero(ends)
    rules = np.empty((0, 2), kind)
    for _ in range(p.rounds):
        if len(seq) < 2:
            break
        keys = (seq[:-1] << shift) | seq[1:]
        outer = stops[stops < len(keys)]
        keys[outer] = never
        count = np.sort(keys)[:len(keys) - len(outer)]
        if not len(count):
            break
        first = np.flatnonzero(np.concatenate(([True], count[1:] != count[:-1])))
        times = np.diff(np.append(first, len(count)))
        often = np.flatnonzero(times >= p.least)
        if not len(often):
            break
        if len(often) > p.pairs:
            often = often[np.argsort(-times[often], kind="stable")[:p.pairs]]
        chosen = np.sort(count[first[often]])
        at, slot = occurrences(keys, chosen)
        # In a run of overlapping occurrences every second one stays.
        run = np.flatnonzero(np.diff(at) == 1) + 1
        if len(run):
            new = np.ones(len(at), bool)
            new[run] = False
            place = np.arange(len(at))
            into = place - np.maximum.accumulate(np.where(new, place, 0))
            even = into % 2 == 0
            at, slot = at[even], slot[even]
        seq[at] = slot.astype(kind) + kind(base + len(rules))
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, stops = seq[keep], stops - np.searchsorted(at, stops)  # so many second halves lie at or before a stop
        rules = np.concatenate((rules, np.stack((chosen >> shift, chosen & low), axis=1)))
    last = np.zeros(len(seq), bool)
    last[stops] = True
    return seq.astype(np.uint32), last, rules.astype(np.uint32)


def occurrences(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` has one of ``chosen`` (sorted, different), and which."""
    # A table in which no two chosen keys share a place; a key that meets another one there is none of them.
    bits = keys.dtype.itemsize * 8
    size = min(bits - 1, 9 + len(chosen).bit_length())
    for factor in FACTORS:
        place = (chosen * chosen.dtype.type(factor >> (64 - bits) | 1)) >> chosen.dtype.type(bits - size)
        if len(np.unique(place)) == len(chosen):
            table = np.zeros(1 << size, np.uint16 if len(chosen) <= 1 << 16 else np.uint32)
            table[place] = np.arange(len(chosen))
            slot = table[(keys * keys.dtype.type(factor >> (64 - bits) | 1)) >> keys.dtype.type(bits - size)]
            break
    else:
        slot = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
    at = np.flatnonzero(chosen[slot] == keys)
    return at, slot[at]


def lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each rule expands to."""
    out: list[int] = []
    for a, b in rules.tolist():  # a rule names earlier rules only
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.int64)


class Grammar:
    """Decodes symbols of a shard."""

    def __init__(self, base: int, rules: np.ndarray) -> None:
        done = [None] * len(rules)
        for i, (a, b) in enumerate(rules.tolist()):  # a rule names earlier rules only
            done[i] = [*(done[a - base] if a >= base else [a]), *(done[b - base] if b >= base else [b])]
        lens = np.array([len(d) for d in done], np.int64)
        self.length = np.concatenate((np.ones(base, np.int64), lens))
        self.flat = np.concatenate((np.arange(base, dtype=np.uint32),
                                    np.fromiter((x for d in done for x in d), np.uint32, int(lens.sum()))))
        self.start = np.concatenate((np.arange(base), base + np.cumsum(lens) - lens))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        shift = self.start[symbols] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))]


FORMAT = ("part int, shard int, n_docs long, n_ids long, base long, width int, rules binary, lengths binary, "
          "symbols binary, symbol_starts binary, id_starts binary, doc_ids array<long>")


def _shard(part: int, shard: int, base: int, docs: list, parts: list[np.ndarray], p: RePair) -> list:
    lens = np.array([len(x) for x in parts], np.int64)
    ids = np.concatenate(parts)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(lens) - 1] = True
    symbols, last, rules = compress(ids, ends, base, p)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    stops = np.flatnonzero(last) + 1
    return [part, shard, len(docs), len(ids), base, width, rules.astype("<u4").tobytes(),
            lengths(base, rules).astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
            np.concatenate(([0], stops)).astype("<u4").tobytes(),
            np.concatenate(([0], np.cumsum(lens))).astype("<u4").tobytes(), docs]


def _encode(p: RePair):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p.tokenizer, p.keeps_space)
        base = max(enc.full.get_vocab_size(), p.end_id + 1)
        end = np.array([p.end_id], np.uint32)
        part, shard, docs, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            row = _shard(part, shard, base, docs, parts, p)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5,
                     pa.list_(pa.int64())]
            names = [x.split()[0] for x in FORMAT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                some = batch.slice(s, 500)
                for doc, got in zip(column(some, "doc_id"), enc.ids(column(some, "text")), strict=True):
                    docs.append(doc)
                    parts.append(np.concatenate((got.astype(np.uint32), end)))
                    size += len(parts[-1])
                    if size >= p.shard_ids:
                        yield out()
                        shard, docs, parts, size = shard + 1, [], [], 0
        if docs:
            yield out()
    return job


def write_shards(docs: DataFrame, path: str, p: RePair) -> None:
    """Encode every text (NULL: empty), append the end id, and write the shards in ascending doc_id order (NULL first; rows
    that repeat an id in an order of their texts). Only doc_id and text are read. An empty table writes no shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    placed = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), tie)
    placed.sortWithinPartitions(F.col("doc_id"), tie, F.col("text")).mapInArrow(_encode(p), FORMAT).write.parquet(path)


def open_shard(row: dict) -> tuple[Grammar, np.ndarray, np.ndarray, np.ndarray]:
    """Grammar, symbols, and for each document its first symbol and its first id."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    return (Grammar(row["base"], rules), np.frombuffer(row["symbols"], f"<u{row['width']}"),
            np.frombuffer(row["symbol_starts"], "<u4"), np.frombuffer(row["id_starts"], "<u4"))


def decode_document(row: dict, i: int) -> np.ndarray:
    """Random access: the ids of the i-th document of a shard."""
    grammar, symbols, starts, _ = open_shard(row)
    return grammar.expand(symbols[starts[i]:starts[i + 1]])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            grammar, symbols, _, starts = open_shard(row)
            data = memoryview(grammar.expand(symbols).astype("<u4").tobytes())
            at = starts.astype(np.int64)
            sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                 pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FORMAT).parquet(path)
    meta = files.select("part", "shard", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("ids")).select(
        F.col("part").alias("p"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = meta.select(F.col("part").alias("sp"), F.col("shard").alias("ss"),
                         F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shift"))
    starts = shards.join(parts, shards.sp == parts.p).select("sp", "ss", (F.col("before") + F.col("shift")).alias("base_id"))
    docs = files.mapInArrow(_decode, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(starts, (docs.part == starts.sp) & (docs.shard == starts.ss)).select(
        "doc_id", (F.col("base_id") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, p: RePair) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    write_shards(docs, path, p)
    return read_shards(spark, path)
