"""Quantiles of many columns in one scan, with a proven bound of their rank error.

A sketch keeps sorted items in levels; an item of level i stands for 2^i values. A full level is compacted: its items are sorted
and every second one moves up. Any value's rank so changes by at most 2^i, whatever the data, and the sketch adds these
changes up: ``error`` is how far, in rows, the rank of an answer may lie from the rank that was asked for. Sketches merge by
joining their levels, and their errors add (Manku, Rajagopalan and Lindsay 1998). Nothing is random: the bound always holds, and
up to ``size`` values answers are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import as_number, col, unpivot_numbers
from .ranking import prefix_sums

LEVELS = 40  # a sketch of 2^40 times its size still keeps the error that was asked for
FAN_IN = 64  # sketches that are merged by one task


class RankSketch:
    def __init__(self, size: int) -> None:
        self.size = max(2, size)
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.odd: list[int] = [0]  # which of two neighbours moves up next, by level
        self.n = self.error = 0

    def add(self, values: np.ndarray) -> None:
        for at in range(0, len(values), self.size):
            self.levels[0] = np.concatenate((self.levels[0], values[at:at + self.size]))
            self.n += len(values[at:at + self.size])
            self._compact()

    def merge(self, levels: Sequence[np.ndarray], n: int, error: int) -> None:
        while len(self.levels) < len(levels):
            self.levels.append(np.empty(0))
            self.odd.append(0)
        for i, items in enumerate(levels):
            self.levels[i] = np.concatenate((self.levels[i], items))
        self.n += n
        self.error += error
        self._compact()

    def _compact(self) -> None:
        i = 0
        while i < len(self.levels):
            if len(self.levels[i]) >= self.size:
                items = np.sort(self.levels[i])
                even = len(items) // 2 * 2
                if i + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.odd.append(0)
                self.levels[i + 1] = np.concatenate((self.levels[i + 1], items[self.odd[i]:even:2]))
                self.levels[i] = items[even:]
                self.odd[i] ^= 1
                self.error += 1 << i
            i += 1

    def quantiles(self, probabilities: Sequence[float]) -> list[float]:
        """For each probability p a value whose rank is within ``error`` of p·(n-1), from 0; empty without values."""
        if not self.n:
            return []
        items = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(v), 1 << i, np.int64) for i, v in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        upto = np.cumsum(weight[order])
        asked = np.array(probabilities, float) * (self.n - 1)
        return items[order][np.minimum(np.searchsorted(upto, asked, "right"), len(items) - 1)].tolist()


PARTS = "column int, cut int, level int, items array<double>, n long, error long, low double, high double, rows long"


def _rows(sketches: dict, extremes: dict, cut: int) -> pd.DataFrame:
    """A row per level; the first one carries the counts."""
    out = []
    for key, s in sketches.items():
        low, high, rows = extremes[key]
        for i, items in enumerate(s.levels):
            first = i == 0
            out.append((*key, cut, i, items, s.n if first else 0, s.error if first else 0, low, high, rows if first else 0))
    names = ["key", "column", "cut", "level", "items", "n", "error", "low", "high", "rows"]
    return pd.DataFrame(out, columns=names)


def quantile_sketches(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], error: float = 1e-3,
                      ids: Sequence[str] = ()) -> DataFrame:
    """``(ids…, column, rows, n, low, high, rank_error, quantiles array<double>)`` per column and id; NULL and NaN are no values.

    ``error``: the share of the values by which ranks may be off. Each task scans its rows once and sends its sketches, which are
    merged some at a time.
    """
    size = int(np.ceil(LEVELS / error))
    k = len(columns)
    keyed = df.select(F.to_json(F.struct(*[col(i).cast("string").alias(f"i{j}") for j, i in enumerate(ids)]))
                      .alias("key") if ids else F.lit("").alias("key"),
                      *[as_number(df, n).alias(f"x{i}") for i, n in enumerate(columns)])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketches: dict[tuple[str, int], RankSketch] = {}
        extremes: dict[tuple[str, int], tuple[float | None, float | None, int]] = {}
        for pdf in batches:
            for name, part in pdf.groupby("key", sort=False):
                for i in range(k):
                    x = part[f"x{i}"].to_numpy(dtype=np.float64)
                    x = x[~np.isnan(x)]
                    key = (name, i)
                    sketches.setdefault(key, RankSketch(size)).add(x)
                    low, high, rows = extremes.get(key, (None, None, 0))
                    if len(x):
                        low = float(x.min()) if low is None else min(low, float(x.min()))
                        high = float(x.max()) if high is None else max(high, float(x.max()))
                    extremes[key] = (low, high, rows + len(part))
        yield _rows(sketches, extremes, TaskContext.get().partitionId() // FAN_IN)

    def merge(last: bool):
        def job(pdf: pd.DataFrame) -> pd.DataFrame:
            s = RankSketch(size)
            pdf = pdf.sort_values(["from", "level"], kind="stable")  # the same result whatever order rows arrive in
            for _, part in pdf.groupby("from", sort=False):
                s.merge([np.asarray(v, float) for v in part["items"]], int(part["n"].sum()), int(part["error"].sum()))
            low, high = pdf["low"].min(), pdf["high"].max()
            key = (pdf["key"].iloc[0], int(pdf["column"].iloc[0]))
            ends = (None if pd.isna(low) else float(low), None if pd.isna(high) else float(high), int(pdf["rows"].sum()))
            if not last:
                return _rows({key: s}, {key: ends}, 0).assign(**{"from": int(pdf["cut"].iloc[0])})
            return pd.DataFrame({"key": [key[0]], "column": [key[1]], "rows": [ends[2]], "n": [s.n], "low": [ends[0]],
                                 "high": [ends[1]], "rank_error": [s.error], "quantiles": [s.quantiles(probabilities)]})
        return job

    made = keyed.mapInPandas(scan, "key string, " + PARTS).withColumn("from", F.spark_partition_id())
    some = made.groupBy("key", "column", "cut").applyInPandas(merge(False), "key string, " + PARTS + ", from int")
    whole = some.groupBy("key", "column").applyInPandas(
        merge(True), "key string, column int, rows long, n long, low double, high double, rank_error long, quantiles array<double>")
    names = F.array(*[F.lit(c) for c in columns])
    kinds = ", ".join(f"i{j} string" for j in range(len(ids)))
    back = [F.from_json("key", kinds)[f"i{j}"].cast(df.schema[i].dataType).alias(i) for j, i in enumerate(ids)]
    return whole.select(*back, F.get(names, F.col("column")).alias("column"), "rows", "n", "low", "high", "rank_error", "quantiles")


def rank_gaps(df: DataFrame, columns: Sequence[str], answers: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``(column, probability, gap, rank_error)``: how far, in rows, the ranks of a sketch's answers really are from the ranks asked
    for. One scan that counts the values below and up to each answer."""
    flat = answers.select("column", "n", "rank_error", F.posexplode("quantiles").alias("i", "value"))
    asked = F.get(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("i")) * (F.col("n") - 1)
    points = flat.select("column", "n", "rank_error", "i", "value", asked.alias("asked"))
    counts = unpivot_numbers(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("rows"))
    ranked = prefix_sums(counts, ["column"], ["value"], ["rows"]).select(
        F.col("column").alias("c"), F.col("value").alias("v"), F.col("rows_before").alias("below"),
        (F.col("rows_before") + F.col("rows") - 1).alias("last"))
    hit = points.join(ranked, (F.col("column") == F.col("c")) & (F.col("value") == F.col("v")))
    gap = F.greatest(F.col("below") - F.ceil("asked"), F.floor("asked") - F.col("last"), F.lit(0))
    return hit.select("column", F.get(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("i")).alias("probability"),
                      gap.cast("long").alias("gap"), "rank_error")


# The functions that run in tasks travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
