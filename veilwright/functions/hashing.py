"""Row draws that depend on a row's key and a seed only, never on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

BUCKETS = 10_000


def _key_text(keys: Sequence[str]) -> Column:
    if len(keys) == 1:
        return F.coalesce(col(keys[0]).cast("string"), F.lit(""))
    return F.concat_ws("\u001f", *[F.coalesce(col(k).cast("string"), F.lit("\u0000")) for k in keys])


def key_hash(keys: Sequence[str], seed: int) -> Column:
    """A 32-bit draw per key from md5, which other SQL engines can reproduce."""
    text = F.concat(F.lit(f"{seed}:"), _key_text(keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def key_bucket(keys: Sequence[str], seed: int, buckets: int = BUCKETS) -> Column:
    return F.pmod(key_hash(keys, seed), F.lit(buckets))


def uniform(row_id: Column, seed: int, stream: int) -> Column:
    """A double in (0,1) from a row id; a fixed (id, seed, stream) always gives the same number."""
    bits = F.shiftrightunsigned(F.xxhash64(row_id, F.lit(seed), F.lit(stream)), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
