"""How close a synthetic table S is to the real table R.

All columns of a kind are scored by one job over the long form ``(column, value)``; R and S go through the same
aggregation with one counter each, so no join of two frequency tables is needed and a value that fills a third of
the rows is combined before it is shuffled.

Result rows are ``(property, column, other, metric, score)``; ``other`` is the second column of a pair. Scores lie in
[0, 1] and 1 is best.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_number, bin_index, col, field_type, unpivot_numbers, unpivot_text
from ..functions.ranking import prefix_sums

PAIR_BINS = 10
WIDE_PAIRS = 28
SCHEMA = "property string, column string, other string, metric string, score double"


def columns_of(kinds: Mapping[str, str], kind: str, *tables: DataFrame) -> list[str]:
    return [n for n, k in kinds.items() if k == kind and all(n in t.columns for t in tables)]


def _both(real: DataFrame, synthetic: DataFrame, pick) -> DataFrame:
    r = pick(real).withColumns({"_r": F.lit(1), "_s": F.lit(0)})
    return r.unionByName(pick(synthetic).withColumns({"_r": F.lit(0), "_s": F.lit(1)}))


def _counters() -> list[Column]:
    return [F.sum("_r").alias("real_n"), F.sum("_s").alias("synth_n")]


def _rows(df: DataFrame, prop: str, metric: str, column: Column | str = "column",
          other: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(prop).alias("property"), (F.col(column) if isinstance(column, str) else column).alias("column"),
        (other if other is not None else F.lit(None).cast("string")).alias("other"),
        F.lit(metric).alias("metric"), F.col("score").cast("double").alias("score"),
    )


def _nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], SCHEMA)


def text_counts(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, real_n, synth_n)``; NULL is a value of its own."""
    return _both(real, synthetic, lambda t: unpivot_text(t, columns)).groupBy("column", "value").agg(*_counters())


def number_counts(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same for numbers, without NULL."""
    long = _both(real, synthetic, lambda t: unpivot_numbers(t, columns)).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(*_counters())


def key_uniqueness(synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of different, non-null values in id columns of S."""
    if not columns:
        return _nothing(synthetic)
    counts = unpivot_text(synthetic, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    score = counts.groupBy("column").agg(
        F.coalesce(F.try_divide(F.count("value"), F.sum("n")), F.lit(0.0)).alias("score")
    )
    return _rows(score, "Data Validity", "KeyUniqueness")


def boundary_adherence(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of S numbers inside [min R, max R]; NULL is skipped."""
    if not columns:
        return _nothing(real)
    plan = []
    for i, n in enumerate(columns):
        x = as_number(real, n)
        plan += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    edge = real.agg(*plan).first()  # two numbers per column
    scores = []
    for i, n in enumerate(columns):
        x = as_number(synthetic, n)
        inside = x.between(F.lit(edge[f"l{i}"]).cast("double"), F.lit(edge[f"h{i}"]).cast("double"))
        scores.append(F.avg(F.when(x.isNotNull(), F.coalesce(inside, F.lit(False)).cast("double"))).alias(f"b{i}"))
    wide = synthetic.agg(*scores)
    parts = [F.struct(F.lit(n).alias("column"), F.col(f"b{i}").alias("score")) for i, n in enumerate(columns)]
    return _rows(wide.select(F.inline(F.array(*parts))), "Data Validity", "BoundaryAdherence")


def category_adherence(real: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                       counts: DataFrame | None = None) -> DataFrame:
    """Share of S values that occur in R."""
    if not columns:
        return _nothing(real)
    counts = counts if counts is not None else text_counts(real, synthetic, columns)
    known = F.sum(F.when(F.col("real_n") > 0, F.col("synth_n")).otherwise(0))
    score = counts.groupBy("column").agg(F.try_divide(known, F.sum("synth_n")).alias("score"))
    return _rows(score, "Data Validity", "CategoryAdherence")


def structure_score(real: DataFrame, synthetic: DataFrame) -> float:
    """Shared (name, type) pairs over all of them; from the schemas, no data is read."""
    r = {(f.name, f.dataType.simpleString()) for f in real.schema.fields}
    s = {(f.name, f.dataType.simpleString()) for f in synthetic.schema.fields}
    return len(r & s) / len(r | s) if r | s else 1.0


def diagnostic_details(real: DataFrame, synthetic: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """One row per column for validity, one row for the table structure."""
    ids = columns_of(kinds, "id", synthetic)
    numbers = columns_of(kinds, "numerical", real, synthetic)
    words = columns_of(kinds, "categorical", real, synthetic)
    structure = real.sparkSession.createDataFrame(
        [("Data Structure", None, None, "TableStructure", structure_score(real, synthetic))], SCHEMA
    )
    return (
        key_uniqueness(synthetic, ids)
        .unionByName(boundary_adherence(real, synthetic, numbers))
        .unionByName(category_adherence(real, synthetic, words))
        .unionByName(structure)
    )


def overall(details: DataFrame) -> DataFrame:
    """``(property, score)``: the mean of every property and, as ``Overall``, the mean of those means."""
    per = details.groupBy("property").agg(F.avg("score").alias("score"))
    return per.unionByName(per.agg(F.lit("Overall").alias("property"), F.avg("score").alias("score")))


def diagnostic(real: DataFrame, synthetic: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    return overall(diagnostic_details(real, synthetic, kinds))


def ks_complement(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 - the largest distance between the two distribution functions, exact, for all numeric columns at once."""
    if not columns:
        return _nothing(real)
    ranked = prefix_sums(number_counts(real, synthetic, columns), ["column"], ["value"], ["real_n", "synth_n"])
    f_real = F.try_divide(F.col("real_n_before") + F.col("real_n"), F.col("real_n_total"))
    f_synth = F.try_divide(F.col("synth_n_before") + F.col("synth_n"), F.col("synth_n_total"))
    score = ranked.groupBy("column").agg((F.lit(1.0) - F.max(F.abs(f_real - f_synth))).alias("score"))
    return _rows(score, "Column Shapes", "KSComplement")


def tv_complement(real: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                  counts: DataFrame | None = None) -> DataFrame:
    """1 - half the summed distance of category shares; NULL is a category."""
    if not columns:
        return _nothing(real)
    counts = counts if counts is not None else text_counts(real, synthetic, columns)
    r, s = _sizes(real, synthetic)
    gap = F.abs(F.try_divide(F.col("real_n"), r) - F.try_divide(F.col("synth_n"), s))
    score = counts.withColumn("_gap", gap).groupBy("column").agg((F.lit(1.0) - F.sum("_gap") / 2).alias("score"))
    return _rows(score, "Column Shapes", "TVComplement")


def _sizes(real: DataFrame, synthetic: DataFrame) -> tuple[Column, Column]:
    """Row counts as scalar subqueries: they run with the query and read no column."""
    return real.agg(F.count(F.lit(1))).scalar(), synthetic.agg(F.count(F.lit(1))).scalar()


def _correlation_score(real: Column, synthetic: Column) -> Column:
    gap = F.abs(F.nullif(real, F.lit(float("nan"))) - F.nullif(synthetic, F.lit(float("nan"))))
    return F.lit(1.0) - gap / 2


def _correlations_wide(real: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                       pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Few pairs: one aggregate per table, no row is exploded."""

    def corrs(t: DataFrame, tag: str) -> DataFrame:
        x = t.select(*[as_number(t, n).alias(f"x{i}") for i, n in enumerate(columns)])
        wide = x.agg(*[F.corr(f"x{a}", f"x{b}").alias(f"c{a}_{b}") for a, b in pairs])
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{a}_{b}").alias("c")) for a, b in pairs
        ]))).withColumn("tag", F.lit(tag))

    per = corrs(real, "r").unionByName(corrs(synthetic, "s")).groupBy("a", "b").agg(
        F.max(F.when(F.col("tag") == "r", F.col("c"))).alias("cr"),
        F.max(F.when(F.col("tag") == "s", F.col("c"))).alias("cs"),
    )
    return per.select("a", "b", _correlation_score(F.col("cr"), F.col("cs")).alias("score"))


def correlation_similarity(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 - |corr R - corr S|/2 for all pairs of numeric columns.

    A few columns are one aggregate, more are Gram matrices; neither multiplies rows. A constant column has no correlation: its
    pairs get NULL.
    """
    pairs = list(itertools.combinations(range(len(columns)), 2))
    if not pairs:
        return _nothing(real)
    names = F.array(*[F.lit(n) for n in columns])
    if len(pairs) <= WIDE_PAIRS:
        return _rows(_correlations_wide(real, synthetic, columns, pairs), "Column Pair Trends",
                     "CorrelationSimilarity", F.get(names, F.col("a")), F.get(names, F.col("b")))
    moments = gram(real.select(*[as_number(real, n).alias(f"x{i}") for i, n in enumerate(columns)]), "r").unionByName(
        gram(synthetic.select(*[as_number(synthetic, n).alias(f"x{i}") for i, n in enumerate(columns)]), "s"))
    per = moments.groupBy("a", "b").agg(
        F.max(F.when(F.col("tag") == "r", F.col("c"))).alias("cr"), F.max(F.when(F.col("tag") == "s", F.col("c"))).alias("cs"))
    scored = per.select("a", "b", _correlation_score(F.col("cr"), F.col("cs")).alias("score"))
    return _rows(scored, "Column Pair Trends", "CorrelationSimilarity", F.get(names, F.col("a")),
                 F.get(names, F.col("b")))


PARTS = ("n", "sa", "sb", "qa", "qb", "p")
NOISE = 1e-13  # a variance below this share of the square sum is rounding: the column is constant


def gram(wide: DataFrame, tag: str) -> DataFrame:
    """``(tag, a, b, c)``: correlations of all pairs of columns over the rows that have both, from block Gram matrices.

    A batch of rows is a matrix X (gaps as 0) and a mask M. MᵀM, XᵀM, (X·X)ᵀM and XᵀX hold all that the pairs need; each task adds
    them up and sends one row per pair, so no row is multiplied. Columns are shifted by their means first, against cancellation.
    """
    names = wide.columns
    d = len(names)
    means = wide.agg(*[F.avg(n).alias(n) for n in names]).first()  # one number per column
    shift = np.array([means[n] or 0.0 for n in names])
    upper = np.triu_indices(d, 1)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - shift
            mask = ~np.isnan(x)
            m, x = mask.astype(np.float64), np.where(mask, x, 0.0)
            total += np.stack((m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x))
        n, s, q, p = total
        cells = (n[upper], s[upper], s.T[upper], q[upper], q.T[upper], p[upper])
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *[pa.array(c) for c in cells]],
            ["a", "b", *PARTS])

    sums = wide.mapInArrow(job, "a int, b int, " + ", ".join(f"{c} double" for c in PARTS)).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in PARTS])

    def variance(square: str, plain: str) -> Column:
        v = F.col(square) - F.col(plain) * F.try_divide(F.col(plain), F.col("n"))
        return F.when(v > F.lit(NOISE) * F.col(square), v)

    both = F.col("p") - F.col("sa") * F.try_divide(F.col("sb"), F.col("n"))
    return sums.select(F.lit(tag).alias("tag"), "a", "b",
                       F.try_divide(both, F.sqrt(variance("qa", "sa")) * F.sqrt(variance("qb", "sb"))).alias("c"))


PAIR_COUNTS = "a int, b int, u string, v string, real_n long, synth_n long"
PAIR_ROWS = 50_000  # rows whose pairs are counted in one step
PAIR_ENTRIES = 2_000_000  # counts that a task holds before it sends them on


class PairCounter:
    """Joint counts of column pairs inside a task, by codes of its own that stand for the values met so far."""

    def __init__(self, pairs: Sequence[tuple[int, int]], width: int) -> None:
        self.pairs, self.width = pairs, width
        self.clear()

    def clear(self) -> None:
        self.codes: list[dict[str | None, int]] = [{} for _ in range(self.width)]
        self.counts: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.pairs)
        self.entries = 0

    def _coded(self, i: int, column: pa.Array) -> np.ndarray:
        found = column.dictionary_encode(null_encoding="encode")
        codes = self.codes[i]
        of = np.array([codes.setdefault(v, len(codes)) for v in found.dictionary.to_pylist()], np.int64)
        return of[found.indices.to_numpy(zero_copy_only=False)] if len(column) else np.empty(0, np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        real = batch.column(0).to_numpy().astype(np.int64)
        coded = [self._coded(i, c) for i, c in enumerate(batch.columns[1:])]
        for j, (a, b) in enumerate(self.pairs):
            keys, place = np.unique((coded[a] << 32) | coded[b], return_inverse=True)
            n = np.bincount(place, minlength=len(keys))
            r = np.bincount(place, weights=real, minlength=len(keys)).astype(np.int64)
            new = (keys, np.stack((r, n - r)))
            before = self.counts[j]
            if before is not None:
                keys, place = np.unique(np.concatenate((before[0], keys)), return_inverse=True)
                both = np.concatenate((before[1], new[1]), axis=1)
                new = (keys, np.stack([np.bincount(place, weights=w, minlength=len(keys)).astype(np.int64) for w in both]))
                self.entries -= len(before[0])
            self.counts[j] = new
            self.entries += len(new[0])

    def batches(self) -> Iterator[pa.RecordBatch]:
        values = [pa.array(list(c), pa.string()) for c in self.codes]
        for (a, b), found in zip(self.pairs, self.counts, strict=True):
            if found is None:
                continue
            keys, (r, s) = found
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), a, np.int32)), pa.array(np.full(len(keys), b, np.int32)),
                 values[a].take(pa.array(keys >> 32)), values[b].take(pa.array(keys & 0xFFFFFFFF)), pa.array(r), pa.array(s)],
                ["a", "b", "u", "v", "real_n", "synth_n"])


def pair_counts(table: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """``(a, b, u, v, real_n, synth_n)`` for pairs of the text columns after ``_r`` (1: real). Rows are counted inside the tasks, each
    as it is; what is shuffled is one row per task and pair of values that occurs."""
    width = len(table.columns) - 1

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PairCounter(pairs, width)
        for batch in batches:
            for at in range(0, batch.num_rows, PAIR_ROWS):
                counter.add(batch.slice(at, PAIR_ROWS))
                if counter.entries > PAIR_ENTRIES:
                    yield from counter.batches()
                    counter.clear()
        yield from counter.batches()

    return table.mapInArrow(job, PAIR_COUNTS).groupBy("a", "b", "u", "v").agg(
        F.sum("real_n").alias("real_n"), F.sum("synth_n").alias("synth_n"))


def contingency_similarity(real: DataFrame, synthetic: DataFrame, categorical: Sequence[str],
                           numerical: Sequence[str] = (), bins: int = PAIR_BINS) -> DataFrame:
    """1 - half the summed distance of joint shares, for all pairs with at least one categorical column.

    Numbers are cut into equal-width bins over R's range; values of S outside fall into the end bins.
    """
    names = [*categorical, *numerical]
    c = len(categorical)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if a < c or b < c]
    if not pairs:
        return _nothing(real)
    edges = {}
    if numerical:
        plan = []
        for i, n in enumerate(numerical):
            x = as_number(real, n)
            plan += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        row = real.agg(*plan).first()  # two numbers per column
        edges = {n: (row[f"l{i}"], row[f"h{i}"]) for i, n in enumerate(numerical)}

    def cell(t: DataFrame, n: str) -> Column:
        if n in categorical:
            return col(n).cast("string")
        low, high = edges[n]
        if low is None:
            return F.lit(None).cast("string")
        return bin_index(as_number(t, n), low, high, bins).cast("string")

    def pick(t: DataFrame, real_rows: int) -> DataFrame:
        return t.select(F.lit(real_rows).alias("_r"), *[cell(t, n).alias(f"x{i}") for i, n in enumerate(names)])

    counts = pair_counts(pick(real, 1).unionByName(pick(synthetic, 0)), pairs)
    r, s = _sizes(real, synthetic)
    gap = F.abs(F.try_divide(F.col("real_n"), r) - F.try_divide(F.col("synth_n"), s))
    score = counts.withColumn("_gap", gap).groupBy("a", "b").agg((F.lit(1.0) - F.sum("_gap") / 2).alias("score"))
    labels = F.array(*[F.lit(n) for n in names])
    return _rows(score, "Column Pair Trends", "ContingencySimilarity", F.get(labels, F.col("a")),
                 F.get(labels, F.col("b")))


def column_shapes(real: DataFrame, synthetic: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """One row per column: KS complement for numbers, TV complement for categories."""
    return ks_complement(real, synthetic, columns_of(kinds, "numerical", real, synthetic)).unionByName(
        tv_complement(real, synthetic, columns_of(kinds, "categorical", real, synthetic))
    )


def pair_trends(real: DataFrame, synthetic: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """One row per column pair."""
    numbers = columns_of(kinds, "numerical", real, synthetic)
    words = columns_of(kinds, "categorical", real, synthetic)
    return correlation_similarity(real, synthetic, numbers).unionByName(
        contingency_similarity(real, synthetic, words, numbers)
    )


def quality_details(real: DataFrame, synthetic: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    return column_shapes(real, synthetic, kinds).unionByName(pair_trends(real, synthetic, kinds))


def quality(real: DataFrame, synthetic: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """``(property, score)``: Column Shapes, Column Pair Trends and Overall."""
    return overall(quality_details(real, synthetic, kinds))


def target_plot_data(real: DataFrame, synthetic: DataFrame, target: str, kind: str, bins: int = 20) -> DataFrame:
    """What a chart of the target needs: ``(bucket, real_n, synth_n, real_share, synth_share)``.

    Categories are their own buckets; numbers are counted in equal-width bins over R's range.
    """
    if kind == "categorical" or isinstance(field_type(real, target), (T.StringType, T.BooleanType)):
        counts = text_counts(real, synthetic, [target]).select(F.col("value").alias("bucket"), "real_n", "synth_n")
    else:
        x = as_number(real, target)
        low, high = real.agg(F.min(x), F.max(x)).first()
        if low is None:
            low = high = 0.0
        counts = _both(
            real, synthetic, lambda t: t.select(bin_index(as_number(t, target), low, high, bins).alias("b"))
        ).groupBy(F.col("b").cast("string").alias("bucket")).agg(*_counters())
    r, s = _sizes(real, synthetic)
    return counts.withColumns({
        "real_share": F.try_divide(F.col("real_n"), r), "synth_share": F.try_divide(F.col("synth_n"), s),
    })


# The functions that run in tasks travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
