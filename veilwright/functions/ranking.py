"""Exact ranks, prefix sums and quantiles without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import col, unpivot_numbers
from .joins import lookup
from .staging import stage


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Add ``{m}_before``, the sum of ``m`` over the rows of the same group that sort earlier, and ``{m}_total``.

    The rows are range partitioned on (group, order) and written, which fixes the slices. A slice is one range
    partition; only sums per slice are added up across slices, and windows run inside a slice. A group may
    therefore hold any share of the rows. ``order`` should identify a row inside its group.
    """
    keys = list(group)
    if not keys:
        df = df.withColumn("_all", F.lit(0))
        keys = ["_all"]
    ranged = df.repartitionByRange(*[col(c) for c in [*keys, *order]])
    staged = stage(ranged.withColumn("_slice", F.spark_partition_id()), "ranked")
    if len(staged.inputFiles()) <= 1:
        return _inside_one_slice(staged, df.columns, keys, order, measures, bool(group))
    totals = staged.groupBy(*[col(k) for k in keys], "_slice").agg(
        *[F.sum(col(m)).alias(f"_t_{m}") for m in measures]
    )
    across = (
        Window.partitionBy(*[col(k) for k in keys]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*[col(k) for k in keys])
    offsets = totals.select(
        *[col(k) for k in keys], "_slice",
        *[F.coalesce(F.sum(col(f"_t_{m}")).over(across), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(col(f"_t_{m}")).over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = (
        Window.partitionBy(*[col(k) for k in keys], "_slice")
        .orderBy(*[col(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = lookup(staged, offsets, [*keys, "_slice"], [f"_o_{m}" for m in measures] + [f"{m}_total" for m in measures])
    out = placed.select(
        *[col(c) for c in df.columns],
        *[
            (col(f"_o_{m}") + F.coalesce(F.sum(col(m)).over(inside), F.lit(0))).alias(f"{m}_before")
            for m in measures
        ],
        *[col(f"{m}_total") for m in measures],
    )
    return out.drop("_all") if not group else out


def _inside_one_slice(staged: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str],
                      measures: Sequence[str], grouped: bool) -> DataFrame:
    """All rows fitted into one range partition of bounded size: plain windows over it."""
    whole = Window.partitionBy(*[col(k) for k in keys])
    before = whole.orderBy(*[col(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = staged.select(
        *[col(c) for c in columns],
        *[F.coalesce(F.sum(col(m)).over(before), F.lit(0)).alias(f"{m}_before") for m in measures],
        *[F.sum(col(m)).over(whole).alias(f"{m}_total") for m in measures],
    )
    return out if grouped else out.drop("_all")


def row_ranks(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add a 0-based rank inside each group."""
    counted = prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, ["_one"])
    return counted.withColumnRenamed("_one_before", name).drop("_one", "_one_total")


def quantiles_from_counts(freq: DataFrame, group: Sequence[str], value: str, count: str,
                          probabilities: Sequence[float]) -> DataFrame:
    """Interpolated quantiles ``group…, probability, quantile`` from distinct values with their counts."""
    ranked = prefix_sums(freq, group, [value], [count])
    ranked = ranked.withColumnRenamed(f"{count}_total", "_total")
    first, past = col(f"{count}_before"), col(f"{count}_before") + col(count)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])

    def position(p):
        return p * (col("_total") - F.lit(1)).cast("double")

    def covers(rank):
        return (rank >= first) & (rank < past)

    hits = ranked.select(
        *[col(g) for g in group], col(value).alias("_v"), first.alias("_first"), past.alias("_past"), "_total",
        F.explode(F.filter(wanted, lambda p: covers(F.floor(position(p))) | covers(F.ceil(position(p)))))
        .alias("probability"),
    )
    place = F.col("probability") * (F.col("_total") - F.lit(1)).cast("double")
    low, high = F.floor(place), F.ceil(place)
    ends = hits.groupBy(*[col(g) for g in group], "probability").agg(
        F.max(F.when((low >= F.col("_first")) & (low < F.col("_past")), F.col("_v"))).alias("_low"),
        F.max(F.when((high >= F.col("_first")) & (high < F.col("_past")), F.col("_v"))).alias("_high"),
        F.max(place - low).alias("_part"),
    )
    return ends.select(
        *[col(g) for g in group], "probability",
        (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias("quantile"),
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    ids: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of many numeric columns in one job; NULL and NaN are left out."""
    long = unpivot_numbers(df, columns, ids).where(F.col("value").isNotNull())
    freq = long.groupBy(*[col(i) for i in ids], "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return quantiles_from_counts(freq, [*ids, "column"], "value", "n", probabilities)
