"""Missing cells: counting, dropping, imputing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_number, col, field_type, from_number, numeric_columns, unpivot_text
from ..functions.ranking import exact_quantiles
from ..functions.sketches import quantile_sketches
from ..sources.tables import nan_to_null

STRATEGIES = (None, "drop", "mean", "median", "mode")


def drop_missing(df: DataFrame) -> DataFrame:
    """Keep the rows without any NULL or NaN."""
    return nan_to_null(df).dropna("any")


def _counts(df: DataFrame, prefix: str) -> DataFrame:
    df = nan_to_null(df)
    cells = [F.when(col(n).isNull(), 1).otherwise(0) for n in df.columns]
    per_row = sum(cells[1:], cells[0]) if cells else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"),
        F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias(f"{prefix}_missing"),
    ).withColumn(f"{prefix}_columns", F.lit(len(df.columns)))


def missing_report(raw: DataFrame, processed: DataFrame, name: str = "") -> DataFrame:
    """One row: rows, columns and missing cells before and after. One pass over each table."""
    before, after = _counts(raw, "original"), _counts(processed, "processed")
    return before.select(
        F.lit(name).alias("dataset"), "original_rows", "original_columns",
        after.select("processed_rows").scalar().alias("processed_rows"),
        after.select("processed_columns").scalar().alias("processed_columns"),
        F.col("original_missing").alias("missing_before"),
        after.select("processed_missing").scalar().alias("missing_after"),
        (F.col("original_rows") - after.select("processed_rows").scalar()).alias("dropped_rows"),
    )


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    out = []
    for n in df.columns:
        if values.get(n) is None:
            out.append(col(n))
            continue
        kind = field_type(df, n)
        fill = F.lit(values[n])
        fill = fill.cast(kind) if isinstance(values[n], str) else from_number(fill.cast("double"), kind)
        out.append(F.coalesce(col(n), fill).alias(n))
    return df.select(*out)


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill numeric columns with their mean. Types stay; whole-number columns take the rounded mean."""
    df = nan_to_null(df)
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return df
    row = df.agg(*[F.avg(as_number(df, n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return _fill(df, {n: row[f"m{i}"] for i, n in enumerate(names)})


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, error: float = 1e-4) -> DataFrame:
    """Fill numeric columns with their median.

    Exact medians come from counts of distinct values with distributed prefix sums. ``exact=False`` uses quantile
    sketches: one scan, no shuffle of values, and a rank that is off by ``error`` of the rows at most.
    """
    df = nan_to_null(df)
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return df
    if exact:
        rows = exact_quantiles(df, names, [0.5]).collect()  # one row per column
        return _fill(df, {r["column"]: r["quantile"] for r in rows})
    rows = quantile_sketches(df, names, [0.5], error).collect()  # one row per column
    return _fill(df, {r["column"]: r["quantiles"][0] for r in rows if r["quantiles"]})


def modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, mode)`` as text: the most frequent value, the smallest one on a tie.

    Two aggregations, both combined map-side, so a value that fills a third of the table is no hot spot.
    """
    df = nan_to_null(df)
    names = list(columns) if columns is not None else df.columns
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    counts = (
        unpivot_text(df, names).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    as_num = F.when(F.col("column").isin(*[n for n in names if n in numeric]), F.col("value").try_cast("double"))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("n"), as_num.alias("num"), F.col("value").alias("value"))).alias("best")
    )
    return best.select("column", F.col("best.value").alias("mode"))


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill any column with its most frequent value."""
    df = nan_to_null(df)
    rows = modes(df, columns).collect()  # one row per column
    return _fill(df, {r["column"]: r["mode"] for r in rows})


def handle_missing(df: DataFrame, strategy: str | None = "drop") -> DataFrame:
    """``None`` leaves the table as it is; ``drop``, ``mean``, ``median`` and ``mode`` as named.

    Means and medians exist for numeric columns only: text columns keep their NULLs there, use ``mode`` or ``drop``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}: one of {STRATEGIES}")
    if strategy is None:
        return df
    return {"drop": drop_missing, "mean": impute_mean, "median": impute_median, "mode": impute_mode}[strategy](df)
