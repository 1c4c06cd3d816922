"""Key lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col
from .staging import broadcast_limit, plan_bytes, stage

HOT_SHARE = 256  # a key is hot when it holds more than 1/HOT_SHARE of all rows


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    parts = [left[f"`{k.replace('`', '``')}`"].eqNullSafe(right[f"`{prefix}{k.replace('`', '``')}`"]) for k in keys]
    return reduce(lambda a, b: a & b, parts)


def lookup(base: DataFrame, dim: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys. ``dim`` has one row per key; Catalyst and AQE choose the strategy."""
    right = dim.select(*[col(k).alias(f"_k_{k}") for k in keys], *[col(p) for p in payload])
    joined = base.join(right, _same(base, right, keys, "_k_"), "left")
    return joined.drop(*[f"_k_{k}" for k in keys])


def lookup_weighted(base: DataFrame, dim: DataFrame, keys: Sequence[str], payload: Sequence[str],
                    weight: str) -> DataFrame:
    """``lookup`` for a ``dim`` that records how many base rows each key has.

    Keys above 1/256 of the rows (at most 256 of them, by arithmetic) are answered by a broadcast; only rows of other
    keys are shuffled.
    """
    if plan_bytes(dim) <= broadcast_limit(base.sparkSession):
        return lookup(base, dim, keys, payload)

    names = base.columns
    total = dim.agg(F.sum(col(weight))).first()[0] or 0
    is_hot = col(weight) > F.lit(total / HOT_SHARE)
    hot = dim.filter(is_hot).select(*[col(k).alias(f"_h_{k}") for k in keys], *[col(p).alias(f"_hot_{p}") for p in payload],
                                    F.lit(True).alias("_is_hot"))
    marked = base.join(F.broadcast(hot), _same(base, hot, keys, "_h_"), "left").drop(*[f"_h_{k}" for k in keys])
    answered = marked.where("_is_hot").select(*[col(c) for c in names], *[col(f"_hot_{p}").alias(p) for p in payload])
    rest = marked.where("_is_hot is null").select(*[col(c) for c in names])
    return answered.unionByName(lookup(rest, dim.filter(~F.coalesce(is_hot, F.lit(False))), keys, payload))


def lookup_counted(base: DataFrame, dim: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """``lookup`` by one key. A ``dim`` that is too large for a broadcast first learns how many base rows each key has, so that hot
    keys are answered without a shuffle of their rows."""
    if plan_bytes(dim) <= broadcast_limit(base.sparkSession):
        return lookup(base, dim, [key], payload)
    counts = base.groupBy(col(key)).agg(F.count(F.lit(1)).alias("_base_rows"))
    weighted = stage(lookup(dim, counts, [key], ["_base_rows"]).fillna(0, ["_base_rows"]), "counted")
    return lookup_weighted(base, weighted, [key], payload, "_base_rows")
