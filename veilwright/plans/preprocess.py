"""Load, clean, encode, write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.encoding import BinaryEncoder, OneHotEncoder, category_columns
from ..operators.missing import handle_missing, missing_report
from ..sources.cache import fingerprint, read_or_compute
from ..sources.tables import load_table


@dataclass
class Preprocessed:
    name: str
    raw: DataFrame
    cleaned: DataFrame
    reused: bool
    target: str | None
    encoding: str
    id_columns: tuple[str, ...]

    @cached_property
    def encoder(self) -> BinaryEncoder | OneHotEncoder:
        kind = BinaryEncoder if self.encoding == "binary" else OneHotEncoder
        return kind.fit(self.cleaned, columns=category_columns(self.cleaned, self.target, self.id_columns))

    @cached_property
    def encoded(self) -> DataFrame:
        """Numbers only, apart from the target and id columns; worked out when first asked for."""
        return self.encoder.transform(self.cleaned)

    @cached_property
    def report(self) -> DataFrame:
        return missing_report(self.raw, self.cleaned, self.name)


def preprocess(spark: SparkSession, path: str, sep: str = ",", target: str | None = None,
               strategy: str | None = "drop", encoding: str = "binary", schema: T.StructType | None = None,
               cache_folder: str | None = None, id_columns: Sequence[str] = ()) -> Preprocessed:
    """``raw`` is always the table as read, so the report compares before with after.

    With ``cache_folder`` the cleaned table is written once per (source files, options) and reused while both stay
    the same.
    """
    if encoding not in ("binary", "one-hot"):
        raise ValueError("encoding must be 'binary' or 'one-hot'")
    raw, name = load_table(spark, path, sep, schema)
    cleaned, reused = handle_missing(raw, strategy), False
    if cache_folder is not None:
        options = {"sep": sep, "strategy": strategy, "schema": raw.schema.json()}
        key = fingerprint(spark, path, options)
        cleaned, reused = read_or_compute(spark, cache_folder, f"{name}-cleaned", key, lambda: handle_missing(raw, strategy))
    return Preprocessed(name, raw, cleaned, reused, target, encoding, tuple(id_columns))
