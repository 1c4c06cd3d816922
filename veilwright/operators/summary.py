"""Counts and summary statistics, of one table or of several variants side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_number, col, numeric_columns
from ..functions.joins import lookup
from ..functions.ranking import exact_quantiles
from ..functions.sketches import quantile_sketches


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def stack_variants(variants: Mapping[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """All variants as one table with a leading ``variant`` column, over the columns they share."""
    tables = list(variants.values())
    shared = list(columns) if columns is not None else [
        c for c in tables[0].columns if all(c in t.columns for t in tables[1:])
    ]
    parts = [t.select(F.lit(v).alias("variant"), *[col(c) for c in shared]) for v, t in variants.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_distribution(df: DataFrame, target: str, ids: Sequence[str] = ()) -> DataFrame:
    """``(ids…, target, n, share)``; the total is taken from the counts, not from a second scan of rows."""
    counts = df.groupBy(*[col(i) for i in ids], col(target)).agg(F.count(F.lit(1)).alias("n"))
    if not ids:
        return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())
    totals = counts.groupBy(*[col(i) for i in ids]).agg(F.sum("n").alias("_total"))
    out = lookup(counts, totals, ids, ["_total"])
    return out.withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def min_max(df: DataFrame, column: str) -> DataFrame:
    x = as_number(df, column)
    return df.agg(F.min(x).alias("low"), F.max(x).alias("high"))


def _moments(df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One row per (ids, column) from a single wide aggregate: the rows are never multiplied by the columns."""
    plan = []
    for i, n in enumerate(columns):
        x = as_number(df, n)
        parts = [
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        ]
        plan.append(F.struct(F.lit(n).alias("column"), *parts).alias(f"s{i}"))
    grouped = df.groupBy(*[col(i) for i in ids]) if ids else df.groupBy()
    wide = grouped.agg(*plan)
    return wide.select(*[col(i) for i in ids], F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def describe(df: DataFrame, columns: Sequence[str] | None = None, ids: Sequence[str] = (),
             exact: bool = True, error: float = 1e-4) -> DataFrame:
    """Per column: count, mean, std, min, quartiles, max. ``exact=False`` takes the quartiles from sketches, whose ranks are off by
    ``error`` of the rows at most."""
    names = list(columns) if columns is not None else [n for n in numeric_columns(df) if n not in ids]
    labels = (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    key = [*ids, "column"]
    order = [*key, "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    if not exact:
        sketches = quantile_sketches(df, names, [p for _, p in labels], error, ids).select(
            *key, *[F.get("quantiles", F.lit(i)).alias(a) for i, (a, _) in enumerate(labels)])
        return lookup(_moments(df, names, ids), sketches, key, [a for a, _ in labels]).select(*order)
    quartiles = exact_quantiles(df, names, [p for _, p in labels], ids).groupBy(*key).agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(a) for a, p in labels]
    )
    return lookup(_moments(df, names, ids), quartiles, key, [a for a, _ in labels]).select(*order)


def compare_moments(original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean and sample standard deviation per numeric column, original next to synthetic."""
    names = list(columns) if columns is not None else [
        n for n in numeric_columns(original) if n in synthetic.columns
    ]
    both = stack_variants({"original": original, "synthetic": synthetic}, names)
    long = _moments(both, names, ["variant"])

    def pick(variant: str, stat: str):
        return F.max(F.when(F.col("variant") == variant, F.col(stat))).alias(f"{variant}_{stat}")

    return long.groupBy("column").agg(
        pick("original", "mean"), pick("original", "std"), pick("synthetic", "mean"), pick("synthetic", "std")
    )


def mean_accuracy(results: DataFrame) -> DataFrame:
    """Mean accuracy per model over the variants."""
    return results.groupBy("Model").agg(F.avg("Accuracy").alias("mean_accuracy"))


def compare_models(results: DataFrame) -> DataFrame:
    """Accuracy and precision per model, original next to synthetic; a missing variant gives NULL."""

    def pick(variant: str, metric: str):
        return F.max(F.when(F.col("Dataset") == variant, F.col(metric))).alias(f"{variant}_{metric}".lower())

    return results.groupBy("Model").agg(
        pick("Original", "Accuracy"), pick("Synthetic", "Accuracy"),
        pick("Original", "Precision"), pick("Synthetic", "Precision"),
    )
