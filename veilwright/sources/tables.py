"""Delimited tables in and out."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, require_columns
from .quoted import largest_file, read_quoted, split_bytes

# Cell texts that mean "missing" in delimited files.
NA_TOKENS = ("", "NA", "N/A", "NaN", "nan", "-NaN", "-nan", "null", "NULL", "None", "n/a", "<NA>",
             "#N/A", "#NA", "#N/A N/A", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN")


def dataset_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def _reader(spark: SparkSession, sep: str, multi_line: bool):
    return (
        spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("encoding", "UTF-8").option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )


def _typed(text: DataFrame) -> DataFrame:
    """Give each text column the narrowest of bigint, double, boolean, string that fits every cell."""
    fits = []
    for i, name in enumerate(text.columns):
        c = col(name)
        for kind in ("bigint", "double", "boolean"):
            whole = c.rlike(r"^\s*[+-]?\d+\s*$") if kind == "bigint" else F.lit(True)
            if kind == "boolean":
                whole = F.lower(F.trim(c)).isin("true", "false")
            ok = c.isNull() | (whole & c.try_cast(kind).isNotNull())
            fits.append(F.min(F.coalesce(ok, F.lit(False))).alias(f"{i}_{kind}"))
        fits.append(F.count(c).alias(f"{i}_filled"))
    row = text.agg(*fits).first().asDict()
    out = []
    for i, name in enumerate(text.columns):
        kind = "string"
        if not row[f"{i}_filled"]:
            kind = "double"
        elif row[f"{i}_bigint"]:
            kind = "bigint"
        elif row[f"{i}_double"]:
            kind = "double"
        elif row[f"{i}_boolean"]:
            kind = "boolean"
        out.append((F.trim(col(name)) if kind != "string" else col(name)).cast(kind).alias(name))
    return text.select(*out)


def load_table(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None,
               na_tokens: Sequence[str] = NA_TOKENS, multi_line: bool = True) -> tuple[DataFrame, str]:
    """Read delimited text with a header and return ``(table, name of the file without its ending)``.

    With ``schema`` nothing is scanned before the query runs: pass one for large inputs. Without it, types are
    found by one aggregate over the text, after missing-value tokens have become NULL, so a single ``NA`` does not
    turn a number column into text.

    With ``multi_line`` quoted cells may hold line breaks. Files that one task can take (``spark.sql.files.maxPartitionBytes``) are
    then read file by file, larger ones by many tasks each (``sources.quoted``). Without it every line is a record.
    """
    text = _reader(spark, sep, multi_line).csv(path)
    if schema is not None:
        names = [f.name for f in schema.fields]
        text = _reader(spark, sep, multi_line).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    if multi_line and largest_file(spark, path) > split_bytes(spark):
        text = read_quoted(spark, path, text.columns, sep)
    cleaned = text.select(
        *[F.when(~col(n).isin(*na_tokens), col(n)).alias(n) for n in text.columns]
    )
    if schema is None:
        return _typed(cleaned), dataset_name(path)
    typed = cleaned.select(
        *[(col(f.name) if isinstance(f.dataType, T.StringType) else F.trim(col(f.name)).cast(f.dataType)).alias(f.name)
          for f in schema.fields]
    )
    return nan_to_null(typed), dataset_name(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers have one spelling inside the engine: NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n) for n in df.columns]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",") -> str:
    """Write a table as Parquet, or as delimited text with a header and no row index."""
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: parquet or csv")
    return path


def write_anonymised(df: DataFrame, path: str) -> str:
    """The anonymised table as ``;``-separated text with a header."""
    return write_table(df, path, "csv", ";")


def synthetic_path(folder: str, dataset: str, synthesizer: str) -> str:
    return f"{folder.rstrip('/')}/{dataset}_{synthesizer.upper()}_synthetic"


def write_synthetic(df: DataFrame, folder: str, dataset: str, synthesizer: str = "GAUSSIANCOPULA",
                    fmt: str = "parquet") -> str:
    return write_table(df, synthetic_path(folder, dataset, synthesizer) + ("" if fmt == "parquet" else ".csv"), fmt)


def preview(df: DataFrame, rows: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """The first rows; with ``order`` a deterministic top-k instead of whichever rows come first."""
    require_columns(df, order)
    return df.orderBy(*[col(o) for o in order]).limit(rows) if order else df.limit(rows)
