"""A Gaussian copula: fitted and sampled with column expressions only.

Fit: every column is turned into a normal score z = Φ⁻¹(F(x)); the model is the marginals F and the correlation of
the scores (Patki et al. 2016). Sample: correlated normals per row id → Φ → inverse marginals.

Random numbers are hashes of (row id, seed, column), so a sample does not depend on partitioning and a lost
task recomputes the very same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_number, col, doubles, from_number, unpivot_text
from ..functions.hashing import uniform
from ..functions.joins import lookup
from ..functions.normal import inside_unit, normal_cdf, normal_quantile
from ..functions.ranking import exact_quantiles, prefix_sums
from ..functions.sketches import quantile_sketches
from ..functions.staging import stage
from .metadata import detect_kinds

GRID = 200
GRID_ERROR = 0.2  # rank error of a sketched grid, in grid steps
INLINE_CATEGORIES = 1000  # larger vocabularies stay a table on the cluster
SUPPORTED = "GAUSSIANCOPULA"
NULL_STREAM = 1_000_000
ROWS_PER_TASK = 2_000_000
SMALL_MATRIX = 8  # up to here one aggregate of pairwise correlations, above it MLlib's Gram matrix


def check_type(name: str) -> str:
    if name.upper() != SUPPORTED:
        raise ValueError(f"synthesizer {name!r} is not available; use 'GaussianCopula'")
    return SUPPORTED


@dataclass
class NumberMarginal:
    """Quantiles at equal steps of probability; ends are the observed minimum and maximum."""

    column: str
    grid: list[float]
    null_share: float

    def knots(self) -> tuple[list[float], list[float], list[float]]:
        """Different grid values with the lowest and highest probability at which each occurs."""
        steps = len(self.grid) - 1
        values: list[float] = []
        low: list[float] = []
        high: list[float] = []
        for i, v in enumerate(self.grid):
            if values and v <= values[-1]:
                high[-1] = i / steps
            else:
                values.append(v)
                low.append(i / steps)
                high.append(i / steps)
        return values, low, high

    def distribution(self, x: Column, knot: Column) -> Column:
        """F(x); ``knot`` is the index of the last knot that is not above x. Ties get their middle probability."""
        values, low, high = self.knots()
        last = len(values) - 1
        if last == 0:
            return F.lit(0.5)
        middle = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
        nxt = F.least(knot + 1, F.lit(last))
        here, there = F.get(doubles(values), knot), F.get(doubles(values), nxt)
        start, end = F.get(doubles(high), knot), F.get(doubles(low), nxt)
        part = F.coalesce(F.try_divide(x - here, there - here), F.lit(0.0))
        return F.when(x <= here, F.get(doubles(middle), knot)).otherwise(start + part * (end - start))

    def inverse(self, u: Column) -> Column:
        """The quantile function: an array lookup and one interpolation."""
        steps = len(self.grid) - 1
        place = u * F.lit(float(steps))
        i = F.greatest(F.lit(0), F.least(F.floor(place).cast("int"), F.lit(steps - 1)))
        a, b = F.get(doubles(self.grid), i), F.get(doubles(self.grid), i + 1)
        return a + (place - i) * (b - a)


@dataclass
class Copula:
    """A fitted model. ``categories`` is a table ``(column, value, low, high)`` of probability intervals."""

    schema: T.StructType
    kinds: dict[str, str]
    numbers: dict[str, NumberMarginal]
    category_sizes: dict[str, int]
    categories: DataFrame | None
    modelled: list[str]
    correlation: np.ndarray
    rows: int

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]


def repair_correlation(matrix: np.ndarray) -> np.ndarray:
    """The nearest-in-spirit valid correlation matrix: negative eigenvalues lifted, unit diagonal restored."""
    if matrix.size == 0:
        return matrix
    clean = np.nan_to_num((matrix + matrix.T) / 2, nan=0.0)
    np.fill_diagonal(clean, 1.0)
    values, vectors = np.linalg.eigh(clean)
    lifted = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(lifted))
    return lifted / np.outer(scale, scale)


def number_marginals(df: DataFrame, columns: Sequence[str], grid: int = GRID,
                     exact: bool = False) -> dict[str, NumberMarginal]:
    """Quantile grids of all columns: one scan with sketches whose ranks are off by a fifth of a grid step at most, or exact ranks."""
    if not columns:
        return {}
    probabilities = [i / grid for i in range(grid + 1)]
    found: dict[str, tuple[int, int, list[float]]] = {}  # rows, values, grid
    if exact:
        plan = [F.count(F.lit(1)).alias("rows"), *[F.count(as_number(df, n)).alias(f"c{i}") for i, n in enumerate(columns)]]
        row = df.agg(*plan).first()
        grids: dict[str, list[float]] = {}
        for r in exact_quantiles(df, columns, probabilities).orderBy("column", "probability").collect():
            grids.setdefault(r["column"], []).append(r["quantile"])
        found = {n: (row["rows"], row[f"c{i}"], grids.get(n, [])) for i, n in enumerate(columns)}
    else:
        for r in quantile_sketches(df, columns, probabilities, GRID_ERROR / grid).collect():  # grid + 8 numbers per column
            ends = [r["low"], *r["quantiles"][1:-1], r["high"]] if r["n"] else []
            found[r["column"]] = (r["rows"], r["n"], ends)
    out = {}
    for n in columns:
        rows, filled, values = found.get(n, (0, 0, []))
        out[n] = NumberMarginal(n, [float(v) for v in values] or [0.0, 0.0], 1.0 - (filled / rows if rows else 0.0))
    return out


def category_marginals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n, low, high)``: each category's interval of cumulative probability; NULL is a category."""
    counts = unpivot_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, ["column"], ["value"], ["n"])
    total = F.col("n_total").cast("double")
    return ranked.select(
        "column", "value", "n", (F.col("n_before") / total).alias("low"),
        ((F.col("n_before") + F.col("n")) / total).alias("high"),
    )


CATEGORY_SCHEMA = "column string, value string, n bigint, low double, high double"


def _categories(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """Category intervals and vocabulary sizes; vocabularies found small are put together on the driver."""
    counts = unpivot_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(INLINE_CATEGORIES + 1).collect()
    if len(rows) > INLINE_CATEGORIES:
        table = stage(category_marginals(df, columns), "categories")
        sizes = table.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()
        return table, {r["column"]: r["k"] for r in sizes}
    local, sizes = [], {}
    for c in columns:
        own = sorted((r for r in rows if r["column"] == c),
                     key=lambda r: (r["value"] is not None, (r["value"] or "").encode()))
        total, seen = sum(r["n"] for r in own), 0
        sizes[c] = len(own)
        for r in own:
            local.append((c, r["value"], r["n"], seen / total, (seen + r["n"]) / total))
            seen += r["n"]
    return df.sparkSession.createDataFrame(local, CATEGORY_SCHEMA), sizes


def _category_list(model: Copula, column: str) -> list:
    """At most INLINE_CATEGORIES rows: the caller has compared the size."""
    return model.categories.where(F.col("column") == column).orderBy("low").collect()


def normal_scores(df: DataFrame, model: Copula) -> DataFrame:
    """``z0, z1, …`` for the modelled columns; a missing number scores 0."""
    from pyspark.ml.feature import Bucketizer

    work = df.select(*[
        (as_number(df, n) if n in model.numbers else col(n).cast("string")).alias(f"v{i}")
        for i, n in enumerate(model.modelled)
    ])
    searched = {}
    for i, n in enumerate(model.modelled):
        if n in model.numbers:
            values, _, _ = model.numbers[n].knots()
            if len(values) > 1:
                searched[i] = [-float("inf"), *values, float("inf")]
    if searched:
        work = Bucketizer(
            inputCols=[f"v{i}" for i in searched], outputCols=[f"b{i}" for i in searched],
            splitsArray=list(searched.values()), handleInvalid="keep",
        ).transform(work)
    at, scores = [], []
    for i, n in enumerate(model.modelled):
        if n in model.numbers:
            last = len(model.numbers[n].knots()[0]) - 1
            knot = F.greatest(F.lit(0), F.least(F.col(f"b{i}").cast("int") - 1, F.lit(last)))
            at += [F.col(f"v{i}"), knot.alias(f"k{i}")]
            u = F.coalesce(model.numbers[n].distribution(F.col(f"v{i}"), F.col(f"k{i}")), F.lit(0.5))
        else:
            middles = model.categories.where(F.col("column") == n).select(
                F.col("value").alias(f"v{i}"), ((F.col("low") + F.col("high")) / 2).alias(f"m{i}")
            )
            work = lookup(work, middles, [f"v{i}"], [f"m{i}"])
            at.append(F.col(f"m{i}"))
            u = F.coalesce(F.col(f"m{i}"), F.lit(0.5))
        scores.append(u.alias(f"u{i}"))
    d = range(len(model.modelled))
    held = work.select(*at).select(*scores).select(*[inside_unit(f"u{i}").alias(f"p{i}") for i in d])
    return held.select(*[normal_quantile(f"p{i}").alias(f"z{i}") for i in d])


def score_correlation(scores: DataFrame) -> np.ndarray:
    """The d×d correlation matrix of the scores, in one distributed pass."""
    names = scores.columns
    d = len(names)
    out = np.eye(d)
    if d <= SMALL_MATRIX:
        pairs = [(i, j) for i in range(d) for j in range(i)]
        if pairs:
            row = scores.agg(*[F.corr(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
            for i, j in pairs:
                out[i, j] = out[j, i] = np.nan if row[f"c{i}_{j}"] is None else row[f"c{i}_{j}"]
        return out
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vectors = VectorAssembler(inputCols=names, outputCol="z").transform(scores).select("z")
    return Correlation.corr(vectors, "z").first()[0].toArray()


def fit(df: DataFrame, kinds: Mapping[str, str] | None = None, grid: int = GRID, exact: bool = False) -> Copula:
    """Fit on all rows of ``df``. Id columns are not modelled: a sample numbers them anew."""
    kinds = dict(kinds) if kinds is not None else detect_kinds(df)
    numbers = [n for n in df.columns if kinds.get(n) == "numerical"]
    words = [n for n in df.columns if kinds.get(n) == "categorical"]
    marginals = number_marginals(df, numbers, grid, exact)
    categories, sizes = None, {}
    rows = df.count()
    if words:
        categories, sizes = _categories(df, words)
    varied = [n for n in df.columns if (n in marginals and len(marginals[n].knots()[0]) > 1)
              or (n in words and sizes.get(n, 0) > 1)]
    model = Copula(df.schema, kinds, marginals, sizes, categories, varied, np.zeros((0, 0)), rows)
    if rows > 1 and varied:
        model.correlation = repair_correlation(score_correlation(normal_scores(df, model)))
    else:
        model.correlation = np.eye(len(varied))
    return model


def _stream(column: str) -> int:
    return int.from_bytes(hashlib.sha256(column.encode()).digest()[:4], "big")


def sample(spark: SparkSession, model: Copula, rows: int, seed: int = 42,
           partitions: int | None = None) -> DataFrame:
    """``rows`` new rows with the columns, types, bounds, categories and NULL shares of the fitted table."""
    if rows < 0:
        raise ValueError("rows must not be negative")
    default = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    base = spark.range(0, rows, 1, partitions or default)
    d = len(model.modelled)
    row_id = F.col("id")
    lower = np.linalg.cholesky(model.correlation) if d else np.zeros((0, 0))
    base = base.select(row_id, *[
        uniform(row_id, seed, _stream(n)).alias(f"r{i}") for i, n in enumerate(model.modelled)
    ])
    base = base.select("id", *[inside_unit(f"r{i}").alias(f"p{i}") for i in range(d)])
    base = base.select("id", *[normal_quantile(f"p{i}").alias(f"e{i}") for i in range(d)])
    mixed = []
    for i in range(d):
        terms = [f"{float(lower[i, j])!r}D * e{j}" for j in range(i + 1) if abs(lower[i, j]) > 1e-12]
        mixed.append(F.expr(" + ".join(terms)).alias(f"z{i}"))
    out = base.select("id", *mixed)
    out = out.select("id", *[
        F.least(F.greatest(normal_cdf(f"z{i}"), F.lit(0.0)), F.lit(1.0 - 1e-12)).alias(f"u{i}") for i in range(d)
    ])

    place = {n: i for i, n in enumerate(model.modelled)}
    for n in model.columns:
        if model.kinds.get(n) != "categorical":
            continue
        if model.category_sizes.get(n, 0) > INLINE_CATEGORIES:
            out = _wide_category(out, model, n, f"u{place[n]}")

    columns = []
    for f in model.schema.fields:
        n, kind = f.name, model.kinds.get(f.name)
        if kind == "id":
            value = F.col("id").cast("string").cast(f.dataType)
        elif kind == "categorical":
            value = _category(model, n, place, f.dataType)
        elif n in model.numbers:
            marginal = model.numbers[n]
            raw = marginal.inverse(F.col(f"u{place[n]}")) if n in place else F.lit(marginal.grid[0])
            if marginal.null_share >= 1.0:
                raw = F.lit(None).cast("double")
            elif marginal.null_share > 0.0:
                keep = uniform(F.col("id"), seed, NULL_STREAM + _stream(n)) >= F.lit(marginal.null_share)
                raw = F.when(keep, raw)
            value = from_number(raw, f.dataType)
        else:
            continue
        columns.append(value.alias(n))
    return out.select(*columns)


def _category(model: Copula, column: str, place: Mapping[str, int], kind: T.DataType) -> Column:
    if model.category_sizes.get(column, 0) > INLINE_CATEGORIES:
        return col(f"c_{column}").cast(kind)
    found = _category_list(model, column)
    if not found:
        return F.lit(None).cast(kind)
    if column not in place:
        return F.lit(found[0]["value"]).cast(kind)
    u = F.col(f"u{place[column]}")

    def tree(a: int, b: int) -> Column:  # balanced comparisons: log2(k) tests per row
        if b - a == 1:
            return F.lit(found[a]["value"]).cast("string")
        m = (a + b) // 2
        return F.when(u < F.lit(float(found[m]["low"])), tree(a, m)).otherwise(tree(m, b))

    return tree(0, len(found)).cast(kind)


def _wide_category(out: DataFrame, model: Copula, column: str, u: str) -> DataFrame:
    """Find the interval of ``u`` by an equi-join on cells of equal width plus an exact test, without any size limit."""
    cells = model.category_sizes[column]
    intervals = model.categories.where(F.col("column") == column).select(
        F.col("value").alias(f"c_{column}"), F.col("low").alias("_low"), F.col("high").alias("_high"),
        F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))))
        .alias("_cell"),
    )
    marked = out.withColumn("_at", F.least(F.floor(F.col(u) * cells), F.lit(cells - 1)))
    hit = (marked["_at"] == intervals["_cell"]) & (marked[u] >= intervals["_low"]) & (marked[u] < intervals["_high"])
    return marked.join(intervals, hit, "left").drop("_at", "_cell", "_low", "_high")
