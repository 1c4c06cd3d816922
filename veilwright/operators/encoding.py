"""Categories to numbers, with one vocabulary shared by every table that is encoded."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require_columns, text_columns, unpivot_text
from ..functions.joins import lookup_counted
from ..functions.ranking import row_ranks
from ..functions.staging import stage


def category_columns(df: DataFrame, target: str | None, exclude: Sequence[str] = ()) -> list[str]:
    """Text columns other than the target."""
    return [n for n in text_columns(df) if n != target and n not in exclude]


INLINE_CATEGORIES = 256  # vocabularies up to this size travel in the plan, larger ones stay a table


def vocabulary(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """``(column, value)``: the distinct categories of all tables together; a NULL row tells that cells are missing."""
    longs = [unpivot_text(t, columns).distinct() for t in tables]
    out = reduce(DataFrame.unionByName, longs)
    return out.distinct() if len(longs) > 1 else out


def _sorted(values: Sequence[str]) -> list[str]:
    return sorted(values, key=lambda s: s.encode())  # byte order, as Spark and other SQL engines sort


@dataclass
class BinaryEncoder:
    """Category → ordinal 1..n in alphabetical order → the bits of the ordinal, most significant first.

    A vocabulary that was counted and found small is kept as a mapping; a large one stays a table
    ``(column, value, ordinal)`` on the cluster and is joined, with only its size known to the driver.
    """

    columns: list[str]
    sizes: dict[str, int]
    with_missing: set[str]
    inline: dict[str, dict[str, int]] | None = None
    ordinals: DataFrame | None = None

    @classmethod
    def fit(cls, tables: DataFrame | Sequence[DataFrame], target: str | None = None,
            columns: Sequence[str] | None = None, inline_limit: int = INLINE_CATEGORIES) -> BinaryEncoder:
        tables = [tables] if isinstance(tables, DataFrame) else list(tables)
        names = list(columns) if columns is not None else category_columns(tables[0], target)
        if not names:
            return cls([], {}, set(), {})
        words = vocabulary(tables, names)
        rows = words.limit(inline_limit + 1).collect()
        if len(rows) <= inline_limit:
            found = {n: _sorted([r["value"] for r in rows if r["column"] == n and r["value"] is not None])
                     for n in names}
            gaps = {r["column"] for r in rows if r["value"] is None}
            inline = {n: {v: i + 1 for i, v in enumerate(vs)} for n, vs in found.items()}
            return cls(names, {n: len(vs) for n, vs in found.items()}, gaps, inline)
        words = stage(words, "words")
        gaps = {r["column"] for r in words.where("value is null").collect()}  # one row per column at most
        ranked = row_ranks(words.where("value is not null"), ["column"], ["value"]).select(
            "column", "value", (F.col("rank") + 1).cast("bigint").alias("ordinal")
        )
        ordinals = stage(ranked, "ordinals")
        sizes = {r["column"]: r["n"] for r in ordinals.groupBy("column").agg(F.max("ordinal").alias("n")).collect()}
        return cls(names, {n: sizes.get(n, 0) for n in names}, gaps, None, ordinals)

    def width(self, column: str) -> int:
        return self.sizes[column].bit_length()

    def bit_columns(self, column: str) -> list[tuple[str, int]]:
        """Names and shifts of the generated columns that vary over the fitted tables."""
        w = self.width(column)
        every = [(f"{column}_{i}", w - 1 - i) for i in range(w)]
        constant = self.sizes[column] <= 1 and column not in self.with_missing
        return [] if constant else every

    @property
    def new_columns(self) -> list[str]:
        return [name for c in self.columns for name, _ in self.bit_columns(c)]

    def _with_ordinals(self, df: DataFrame) -> DataFrame:
        """Add ``_ord{i}`` for the i-th category column: 1..n, NULL for a missing or unseen category."""
        require_columns(df, self.columns)
        out = df
        for i, c in enumerate(self.columns):
            if self.inline is not None:
                pairs = [F.lit(x) for item in self.inline[c].items() for x in item]
                found = F.try_element_at(F.create_map(*pairs), col(c)) if pairs else F.lit(None)
                out = out.withColumn(f"_ord{i}", found.cast("bigint"))
                continue
            words = self.ordinals.where(F.col("column") == c).select(
                F.col("value").alias(c), F.col("ordinal").alias(f"_ord{i}")
            )
            out = lookup_counted(out, words, c, [f"_ord{i}"])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each category column by its bits; NULL and unseen categories become all zeros."""
        if not self.columns:
            return df
        out = self._with_ordinals(df)
        kept = []
        for n in df.columns:
            if n not in self.columns:
                kept.append(col(n))
                continue
            ordinal = F.coalesce(F.col(f"_ord{self.columns.index(n)}"), F.lit(0))
            for name, shift in self.bit_columns(n):
                kept.append(F.shiftright(ordinal, shift).bitwiseAND(F.lit(1)).cast("int").alias(name))
        return out.select(*kept)


class CodeEncoder(BinaryEncoder):
    """Category → code 0..n-1 in alphabetical order, in a column of the same name. It stands for one-hot columns of which the
    first is left out: code 0, and with it a missing or unseen category, has none of them. The vocabulary stays on the cluster
    and no row gets wider, so columns may have any number of categories."""

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        out = self._with_ordinals(df)
        return out.select(*[
            F.greatest(F.coalesce(F.col(f"_ord{self.columns.index(n)}") - 1, F.lit(0)), F.lit(0)).cast("int").alias(n)
            if n in self.columns else col(n) for n in df.columns])


def binary_encode(df: DataFrame, target: str | None = None) -> tuple[DataFrame, dict]:
    """Encode all text columns but the target; also report widths before and after and the new names."""
    encoder = BinaryEncoder.fit(df, target)
    out = encoder.transform(df)
    return out, {"columns_before": len(df.columns), "columns_after": len(out.columns),
                 "new_columns": encoder.new_columns}


@dataclass
class OneHotEncoder:
    """Boolean columns ``{column}_{category}``, first category left out."""

    columns: list[str]
    categories: dict[str, list[str]]

    @classmethod
    def fit(cls, tables: DataFrame | Sequence[DataFrame], target: str | None = None,
            columns: Sequence[str] | None = None, max_categories: int | None = None) -> OneHotEncoder:
        """One output column per category: the vocabulary is part of the schema and so on the driver. ``max_categories``
        refuses wider tables if a caller wants that; by default every table is encoded whole."""
        tables = [tables] if isinstance(tables, DataFrame) else list(tables)
        names = list(columns) if columns is not None else category_columns(tables[0], target)
        if not names:
            return cls([], {})
        words = vocabulary(tables, names).where("value is not null")
        rows = (words if max_categories is None else words.limit(max_categories + 1)).collect()
        if max_categories is not None and len(rows) > max_categories:
            raise ValueError(f"more than {max_categories} categories: use BinaryEncoder or one_hot_vector")
        return cls(names, {n: _sorted([r["value"] for r in rows if r["column"] == n]) for n in names})

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.columns)
        kept = [col(n) for n in df.columns if n not in self.columns]
        for n in self.columns:
            kept += [F.coalesce(col(n) == F.lit(v), F.lit(False)).alias(f"{n}_{v}") for v in self.categories[n][1:]]
        return df.select(*kept)


def one_hot_encode(df: DataFrame, target: str | None = None) -> DataFrame:
    return OneHotEncoder.fit(df, target).transform(df)


def one_hot_vector(df: DataFrame, columns: Sequence[str], output: str = "categories",
                   max_categories: int | None = None) -> DataFrame:
    """Sparse one-hot vectors for wide vocabularies: codes by a join on the cluster, vectors from the codes.

    Per column there is one place for each category and a last one for missing cells. ``max_categories`` refuses wider tables if
    a caller wants that.
    """
    if max_categories is not None and vocabulary([df], columns).limit(max_categories + 1).count() > max_categories:
        raise ValueError(f"more than {max_categories} categories: use BinaryEncoder")
    encoder = BinaryEncoder.fit(df, None, columns)
    names = [f"_ord{i}" for i in range(len(columns))]
    coded = encoder._with_ordinals(df)
    index = {n: F.coalesce(F.col(n) - 1, F.lit(encoder.sizes[c])) for n, c in zip(names, columns, strict=True)}
    return sparse_vector(coded.withColumns(index), names, [encoder.sizes[c] + 1 for c in columns], output).drop(*names)


def sparse_vector(df: DataFrame, codes: Sequence[str], sizes: Sequence[int], output: str, drop_last: bool = False,
                  dense: Sequence[str] = ()) -> DataFrame:
    """A sparse vector with a place per category of each code column, after the numbers or vectors of ``dense``."""
    from pyspark.ml.feature import OneHotEncoder as VectorEncoder
    from pyspark.ml.feature import VectorAssembler

    places = [f"_place{i}" for i in range(len(codes))]
    hot = [f"_hot{i}" for i in range(len(codes))]
    out = df.select("*", *[
        F.col(c).cast("double").alias(p, metadata={"ml_attr": {"type": "nominal", "num_vals": int(n)}})
        for c, p, n in zip(codes, places, sizes, strict=True)])
    if codes:
        out = VectorEncoder(inputCols=places, outputCols=hot, dropLast=drop_last).fit(out).transform(out)
    return VectorAssembler(inputCols=[*dense, *hot], outputCol=output).transform(out).drop(*places, *hot)


def split_features_label(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    require_columns(df, [target])
    return df.drop(target), df.select(col(target))
