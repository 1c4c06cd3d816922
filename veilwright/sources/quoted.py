"""Delimited text with line breaks inside quoted cells, read by many tasks per file.

A line break ends a record only outside quotes, and whether a byte lies inside quotes depends on all quotes before it. So the text
is scanned twice, as lines, in the byte ranges Spark cuts a file into:

1. Quotes are counted per range. The parity of all ranges before it tells how a range begins, and a row per range is all that the
   driver sees.
2. Each task joins the lines of its ranges to records. The lines before the first record that begins in a range belong to a record
   of an earlier range, and the last record may go on in later ones: these pieces, two for each range at most, are put together by
   one aggregation per record that crosses a border.

Records are then parsed one by one with Spark's own parser of delimited text. Quotes must follow the common rules: a cell that has
quotes is quoted, and quotes inside it are doubled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = "file string, origin long, part long, first boolean, whole boolean, text string"


def split_bytes(spark: SparkSession) -> int:
    """The largest byte range of a file that one task reads."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


COUNTED = "file string, block long, odd boolean, ends_closed boolean, ends_open boolean"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether its quotes are odd in number, and whether a record ends in it if it begins outside or inside quotes."""
    found: dict[tuple[str, int], list[bool]] = {}  # the ranges of one task
    for batch in batches:
        odd = np.asarray(pc.count_substring(batch.column(2), '"')) & 1
        files, blocks = batch.column(0).to_pylist(), np.asarray(batch.column(1))
        cuts = [0, *[i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]], len(files)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            state = found.setdefault((files[a], int(blocks[a])), [False, False, False])
            at = (np.cumsum(odd[a:b]) + state[0]) & 1
            state[1] |= bool((at == 0).any())
            state[2] |= bool((at == 1).any())
            state[0] = bool(at[-1])
    names = ["file", "block", "odd", "ends_closed", "ends_open"]
    rows = [(f, b, *s) for (f, b), s in found.items()]
    cells = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 3]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True)], names)


def _starts(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """For each range: whether it begins inside quotes, and the range in which the record that is open there began."""
    out: dict[tuple[str, int], tuple[bool, int]] = {}
    file, inside, origin = None, False, 0
    for r in lines.mapInArrow(_count, COUNTED).orderBy("file", "block").collect():  # a row per range
        if r["file"] != file:
            file, inside = r["file"], False
        if not inside:
            origin = r["block"]
        out[file, r["block"]] = (inside, origin)
        if inside and r["ends_open"]:
            origin = r["block"]  # that record ends here, another may begin
        inside ^= r["odd"]
    return out


def _assemble(starts: Mapping[tuple[str, int], tuple[bool, int]]):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        here: tuple[str, int] | None = None
        held: list[str] = []  # lines of the record that is open
        inside = False
        origin = part = 0
        first = crossing = False  # the next record is the file's first; the open one began in an earlier range

        def close() -> None:
            """The end of a range: what is open goes on in the next one."""
            if here is not None and held:
                rows.append((here[0], origin, here[1], first, False, "\n".join(held)))

        for batch in batches:
            for file, block, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, block) != here:
                    close()
                    here, held = (file, block), []
                    inside, origin = starts.value[here]
                    first, crossing = block == 0, inside
                odd = value.count('"') % 2 == 1
                held.append(value)
                inside ^= odd
                if inside:
                    continue
                text = "\n".join(held)
                held = []
                if crossing:
                    rows.append((file, origin, block, False, False, text))
                    crossing = False
                elif text.strip("\r"):
                    rows.append((file, block, block, first, True, text))
                    first = False
                origin = block
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        close()
        yield _batch(rows)

    return job


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    cells = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True)],
                                      ["file", "origin", "part", "first", "whole", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``text``: each record after the header of its file, line breaks inside cells kept."""
    lines = _lines(spark, path)
    starts = spark.sparkContext.broadcast(_starts(lines))
    pieces = lines.mapInArrow(_assemble(starts), PIECES)
    whole = pieces.where("whole and not first").select("text")
    # One record's pieces; a header may cross a border as well.
    crossing = pieces.where("not whole").groupBy("file", "origin").agg(
        F.max("first").alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"),
    ).where("not header")
    return whole.unionByName(crossing.select("text"))


def read_quoted(spark: SparkSession, path: str, names: Sequence[str], sep: str) -> DataFrame:
    """The cells of all records as text columns."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    text = F.regexp_replace("text", "\r$", "")
    parsed = records(spark, path).select(F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


# The functions that run in tasks travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
