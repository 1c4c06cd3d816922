"""Generalisation hierarchies kept as ``value;level 1;…;*`` text, one line per ground value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def read_hierarchy(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """``(value string, labels array<string>)``; empty cells stay empty text, a byte-order mark is removed."""
    raw = (
        spark.read.option("header", False).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("encoding", "UTF-8").option("emptyValue", "").csv(path)
    )
    cells = [F.coalesce(F.col(c), F.lit("")) for c in raw.columns]
    first = F.regexp_replace(cells[0], f"^{BOM}", "")
    return raw.select(first.alias("value"), F.array(*cells[1:]).alias("labels"))


def write_hierarchy(table: DataFrame, path: str, height: int, sep: str = ";") -> str:
    """Write ``(value, labels)`` in the same text form."""
    table.select("value", *[F.get("labels", F.lit(i)).alias(f"level_{i + 1}") for i in range(height)]).write.mode(
        "overwrite"
    ).option("header", False).option("sep", sep).option("escape", '"').csv(path)
    return path
