"""What kind of column each one is: id, categorical or numerical."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_number, col, unpivot_text
from ..sources.tables import nan_to_null

MAX_CODED_CATEGORIES = 10
SCHEMA = "column string, sdtype string, position int"


def detect_kinds(df: DataFrame) -> dict[str, str]:
    """``{column: 'id' | 'categorical' | 'numerical'}``.

    * id: whole number or text, no NULL, all values different, more than one row;
    * categorical: text, boolean, or a non-negative whole number with at most min(10, round(rows/10)) values;
    * numerical: everything else, timestamps and dates included.

    One aggregate with sketches looks at all columns. Only columns whose sketch leaves the question open are
    then counted exactly, so a wide table is not shuffled once per column.
    """
    df = nan_to_null(df)
    plan = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        plan.append(F.count(c).alias(f"filled{i}"))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(f"column {f.name!r} of type {f.dataType.simpleString()} has no kind; drop it first")
        plan.append(F.hll_sketch_estimate(F.hll_sketch_agg(c.cast("string"), F.lit(12))).alias(f"near{i}"))
        if isinstance(f.dataType, T.NumericType):
            x = as_number(df, f.name)
            plan.append(F.min(x).alias(f"low{i}"))
            plan.append(F.min(F.coalesce(x == F.floor(x), F.lit(True))).alias(f"whole{i}"))
    seen = df.agg(*plan).first().asDict()
    rows = seen["rows"]
    few = min(MAX_CODED_CATEGORIES, int(rows / 10 + 0.5))

    maybe_id, maybe_code = [], []
    for i, f in enumerate(df.schema.fields):
        text = isinstance(f.dataType, T.StringType)
        whole = isinstance(f.dataType, T.NumericType) and seen[f"whole{i}"]
        if rows > 1 and seen[f"filled{i}"] == rows and (text or whole) and seen[f"near{i}"] >= 0.85 * rows:
            maybe_id.append(f.name)
        if whole and seen[f"low{i}"] is not None and seen[f"low{i}"] >= 0 and seen[f"near{i}"] <= 2 * few + 5:
            maybe_code.append(f.name)
    open_columns = sorted(set(maybe_id) | set(maybe_code))
    exact: dict[str, int] = {}
    if open_columns:
        counted = (
            unpivot_text(df, open_columns).where(F.col("value").isNotNull()).distinct()
            .groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        )
        exact = {r["column"]: r["n"] for r in counted.collect()}  # one row per column

    kinds = {}
    for f in df.schema.fields:
        if f.name in maybe_id and exact.get(f.name) == rows:
            kinds[f.name] = "id"
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            kinds[f.name] = "categorical"
        elif f.name in maybe_code and exact.get(f.name, 0) <= few:
            kinds[f.name] = "categorical"
        else:
            kinds[f.name] = "numerical"
    return kinds


def detect_metadata(df: DataFrame) -> DataFrame:
    """``detect_kinds`` as a table ``(column, sdtype, position)``."""
    kinds = detect_kinds(df)
    return df.sparkSession.createDataFrame([(n, k, i) for i, (n, k) in enumerate(kinds.items())], SCHEMA)


def kinds_from(metadata: DataFrame) -> dict[str, str]:
    return {r["column"]: r["sdtype"] for r in metadata.orderBy("position").collect()}
