"""Train/test splits and folds that stay the same however the table is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.hashing import BUCKETS, key_bucket, key_hash
from ..functions.ranking import row_ranks


def _keys(df: DataFrame, keys: Sequence[str] | str | None) -> list[str]:
    if keys is None:
        return list(df.columns)
    return [keys] if isinstance(keys, str) else list(keys)


def with_split(df: DataFrame, keys: Sequence[str] | str | None, test_size: float = 0.2, seed: int = 42,
               name: str = "is_test") -> DataFrame:
    """Mark a ``test_size`` share of the keys; without a key, equal rows land on the same side."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie between 0 and 1")
    return df.withColumn(name, key_bucket(_keys(df, keys), seed) < F.lit(round(test_size * BUCKETS)))


def train_test_split(df: DataFrame, keys: Sequence[str] | str | None = None, test_size: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``: two filters over the same scan, no shuffle."""
    marked = with_split(df, keys, test_size, seed, "_is_test")
    return marked.where(~F.col("_is_test")).drop("_is_test"), marked.where(F.col("_is_test")).drop("_is_test")


def with_folds(df: DataFrame, keys: Sequence[str] | str | None, folds: int = 5, seed: int = 42,
               stratify: str | None = None, name: str = "fold") -> DataFrame:
    """Add a fold number 0..folds-1.

    Plain folds are a hash, no shuffle. With ``stratify`` the rows of each label are dealt out in turn, so every
    fold has the label's share to within one row; the ranks come from range-partitioned prefix sums, so a
    dominating label is no single task.
    """
    names = _keys(df, keys)
    if stratify is None:
        return df.withColumn(name, key_bucket(names, seed + 1, folds).cast("int"))
    marked = df.withColumn("_draw", key_hash(names, seed + 1))
    ranked = row_ranks(marked, [stratify], ["_draw", *names], "_rank")
    return ranked.withColumn(name, F.pmod(F.col("_rank"), F.lit(folds)).cast("int")).select(
        *[col(c) for c in df.columns], name
    )
