"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and UTF-8 bytes only, so that Python gets bytes without a detour and no other column is read."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased: both are what bytes.lower and bytes.split do."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A dictionary that computes missing values and starts anew when it is full, so its memory is bounded."""

    def __init__(self, compute: Callable, limit: int) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


_remembering: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    """Called when a task begins whose operator remembers things from task to task. A worker outlives its job: what another operator
    has left there is forgotten, so a worker holds the memory of one operator at a time."""
    if name not in _remembering:
        for done in _remembering.values():
            done()
        _remembering.clear()
        _remembering[name] = forget


WORD_HASH = Memo(xxhash.xxh64_intdigest, 400_000)


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def arrays(batch: pa.RecordBatch, *names: str, rows: int = 256) -> Iterator[tuple]:
    """The rows of a batch, turned into Python values a few at a time."""
    for s in range(0, batch.num_rows, rows):
        part = batch.slice(s, rows)
        yield from zip(*[column(part, n) for n in names], strict=True)


def running(df: DataFrame, group: Sequence[str], draw: Column, order: Sequence[Column], weight: Column, name: str,
            buckets: int | None = None) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the same group that come before, in the order (bucket of draw, order).

    ``draw`` is a number in [0, 1) that depends on the row. A group is cut into buckets of draws, so a group with most of
    the rows is still summed by many tasks; only one total for each group and bucket crosses buckets.
    """
    buckets = buckets or max(256, 2 * partitions(df.sparkSession))
    keys = [*group, "__bucket"]
    rows = df.withColumns({"__bucket": F.floor(draw * buckets).cast("int"), "__weight": weight.cast("long")})
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(F.sum("__weight").alias("__total")).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    joined = summed.join(totals, same, "left")
    return joined.withColumn(name, F.col("__base") + F.col("__inside")).drop(
        "__bucket", "__weight", "__inside", "__base", *[f"__k_{k}" for k in keys])


def draw_of(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)).cast("double") / float(1 << 30)
