"""Best-fit packing of documents into sequences by minimum bin slack.

A bin is filled so that it leaves the least slack: the largest length still there is its seed, and a subset-sum dynamic
program over the available lengths (one bit for each reachable sum) finds the fullest feasible combination, which is then
removed. Which documents have a length does not matter, so the program runs on the histogram of lengths - at most ``capacity``
numbers, whatever the corpus - and a combination is applied as often as the counts allow. That makes a plan of bounded
size; Spark ranks the pieces of each length and reads their places off the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import column, draw_of, running
from .tokenization import encoder


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    keeps_space: bool = False
    end_id: int = 0
    capacity: int = 2048


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination with the largest sum up to ``room``; ``lengths`` descending, each at most ``counts`` times."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        k = 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def bin_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, ranks per bin, first bin, first offset) and the number of bins."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(counts, 0)
    lengths = sorted(counts, reverse=True)
    rows, bins = [], 0
    while counts:
        seed = lengths[0]
        counts[seed] -= 1
        pattern = fullest(counts, lengths, capacity - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        offset = 0
        for k in sorted(pattern, reverse=True):
            n = pattern[k]
            rows.append((k, used[k], n, bins, offset))
            offset += k * n
            used[k] += n * times
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
                lengths.remove(k)
        bins += times
    return np.array(rows, np.int64).reshape(-1, 5), bins


def _pieces(p: Packing):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p.tokenizer, p.keeps_space)
        end = np.array([p.end_id], enc.dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for doc, got in zip(column(part, "doc_id"), enc.ids(column(part, "text")), strict=True):
                    all_ids = np.concatenate((got, end)).astype("<u4")
                    for i, s in enumerate(range(0, len(all_ids), p.capacity)):
                        piece = all_ids[s:s + p.capacity]
                        out.append((doc, i, s, len(piece), zlib.crc32(piece.tobytes())))
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])
    return job


def _place(plan: np.ndarray):
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    rows = plan[order]
    keys = (rows[:, 0] << 44) + rows[:, 1]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            r = rows[at]
            into = rank - r[:, 1]
            named = {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length",
                                                                             "ids_crc32")}
            named["sequence_id"] = pa.array(r[:, 3] + into // r[:, 2])
            named["offset"] = pa.array(r[:, 4] + (into % r[:, 2]) * length)
            yield pa.RecordBatch.from_arrays(list(named.values()), list(named))
    return job


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL text is an empty one: its piece is the end id alone. NULL and repeated ids are packed like any other. An empty
    table gives an empty result; only doc_id and text are read. The driver sees the histogram of at most ``capacity``
    lengths, never a document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stage(rows.mapInArrow(_pieces(p), PIECE), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan, _ = bin_plan(histogram, p.capacity)
    columns = ("doc_id", "piece", "ids_crc32")
    ranked = running(pieces, ["length"], draw_of(*map(F.col, columns)), [F.col(c) for c in columns], F.lit(1), "rank")
    return ranked.mapInArrow(_place(plan), PIECE + ", sequence_id long, offset long")
