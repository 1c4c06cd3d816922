"""Column helpers that are safe for any column name and any numeric type."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types treated as numbers in statistics. Timestamps and dates count as seconds since 1970.
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name: dots, spaces, tabs and quotes are all allowed."""
    return F.col(quoted(name))


def field_type(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"no column {name!r}; the table has {df.columns}")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column(s) {missing}; the table has {df.columns}")


def numeric_columns(df: DataFrame, include_time: bool = False) -> list[str]:
    kinds = (T.NumericType, *TIME_TYPES) if include_time else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE with NaN read as NULL."""
    kind = field_type(df, name)
    if isinstance(kind, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {quoted(name)})")
        return micros / F.lit(1e6)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name)) / F.lit(1e6)
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("double") * F.lit(86400.0)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col(name)), col(name).cast("double"))
    return col(name).cast("double")


def from_number(value: Column, kind: T.DataType) -> Column:
    """The inverse of ``as_number`` for a target type; whole-number types round half up."""
    if isinstance(kind, T.TimestampNTZType):
        start = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return F.timestamp_add("MICROSECOND", F.round(value * F.lit(1e6)).cast("long"), start)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.round(value * F.lit(1e6)).cast("long"))
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.round(value / F.lit(86400.0)).cast("int"))
    if isinstance(kind, T.IntegralType):
        return F.round(value).cast(kind)
    return value.cast(kind)


def unpivot_numbers(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form ``ids…, column, value double``."""
    wide = df.select(*[col(i) for i in ids], *[as_number(df, n).alias(n) for n in columns])
    return wide.unpivot([col(i) for i in ids], [col(n) for n in columns], "column", "value")


def unpivot_text(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form ``ids…, column, value string``."""
    wide = df.select(*[col(i) for i in ids], *[col(n).cast("string").alias(n) for n in columns])
    return wide.unpivot([col(i) for i in ids], [col(n) for n in columns], "column", "value")


def entropy_term(n: Column) -> Column:
    """n·ln n with 0·ln 0 = 0."""
    x = n.cast("double")
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def round4(value: Column) -> Column:
    """Four decimals, halves away from zero."""
    return F.round(value, 4)


def percent_text(share: Column) -> Column:
    """A share in [0,1] as a percentage with two decimals, e.g. ``12.50%``."""
    return F.format_string("%.2f%%", share.cast("double") * F.lit(100.0))


def parse_double(text: Column) -> Column:
    """A number read from text; NULL for empty text and for text that is no number."""
    return F.when(F.trim(text) != "", text.try_cast("double"))


def doubles(values: Sequence[float]) -> Column:
    """An array literal of numbers, parsed in one piece."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def bin_index(value: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Equal-width bin number 0..bins-1 over [low, high]; the maximum belongs to the last bin."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    width = (high - low) / F.lit(float(bins))
    raw = F.floor(F.try_divide(value - low, width)).cast("int")
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(width == 0, F.lit(0))
        .otherwise(F.greatest(F.lit(0), F.least(raw, F.lit(bins - 1))))
    )
