"""Exact k nearest neighbours between two tables.

Of training rows with equal vectors only the k with the smallest ids can be neighbours, so the others are left out first (in
cross-validation k of each fold). A training table that is counted and then found small, ids and labels included, is broadcast: one
pass over the query rows, no shuffle. Beyond that size, training rows are shuffled once, into the leaves of a two-level tree of
pivots: about √n leaf pivots, and about the square root of those above them, each leaf below its nearest one. A row goes to the
nearest upper pivot and to the nearest leaf below it, so placing a row takes some 2·n^¼ distances. A query descends to the leaves
that can hold one of its k neighbours; the triangle inequality decides that from a small summary of each node:

* the k training rows nearest to each leaf pivot bound the query's k-th distance from above, better with each leaf seen;
* the distance of the query to a pivot, the radii of its node and the planes halfway to other pivots bound every distance in the
  node from below. Upper nodes are visited by that bound, until it exceeds the bound from above.

A leaf of any size is cut into chunks of bounded size, chunks of neighbouring leaves are packed into units of bounded bytes, and
a query row goes once to each unit that holds a leaf it needs. The query rows sent to a unit are cut too, so no task sees an
unbounded group. Each (unit, cut) returns at most k rows per query, a second shuffle by query keeps the k best.

Where rows are compared (``Index``), training rows lie in boxes and query rows are taken in compact groups; a group visits
boxes by their distance until none can hold a nearer row. Wide vectors are sifted by a matrix product whose rounding is bounded, and
what passes is measured by differences. Nothing is approximated: the bounds only skip what cannot matter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from threading import Lock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_number, col
from ..functions.staging import plan_bytes, stage

PIVOT_BYTES = 64 * 1024 * 1024  # leaf pivots on the driver and in each worker
SLOTS = 64
CHUNK_ROWS = 20_000
SMALL_BYTES = 64 * 1024 * 1024  # training vectors up to this size are broadcast
UNIT_BYTES = 16 * 1024 * 1024  # training vectors, or query vectors, that a task compares with each other at a time
SPREAD_BYTES = 16 * 1024 * 1024
ROUTE_ROWS = 2_000  # query rows that are routed in one step
BLOCK_NUMBERS = 4_000_000  # numbers in one distance block inside a task
SLACK = 1e-9
WIDE = 16  # from this number of coordinates on, rows are sifted by matrix products
NARROW_ROWS, WIDE_ROWS = (256, 64), (2048, 1024)  # training rows of a box, query rows of a group
_building = Lock()  # the driver holds one index at a time


def vector_column(df: DataFrame, features: Sequence[str] | str) -> Column:
    """One array<double> column from numeric columns, or from an array column."""
    if isinstance(features, str):
        return col(features).cast("array<double>")
    return F.array(*[
        (col(n).cast("int").cast("double") if isinstance(df.schema[n].dataType, T.BooleanType) else as_number(df, n))
        for n in features
    ])


def _widened(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def squared_distances(a: np.ndarray, b: np.ndarray, codes: int = 0) -> np.ndarray:
    """All squared distances by differences, block by block: no digits are lost to cancellation.

    The last ``codes`` columns are category codes that stand for one-hot columns without the first: two different categories are
    2 apart, or 1 if one of them is code 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, BLOCK_NUMBERS // max(1, len(b) * a.shape[1]))
    numbers = a.shape[1] - codes
    for i in range(0, len(a), step):
        gap = a[i:i + step, None, :numbers] - b[None, :, :numbers]
        out[i:i + step] = np.einsum("ijk,ijk->ij", gap, gap)
        for j in range(numbers, a.shape[1]):
            u, v = a[i:i + step, None, j], b[None, :, j]
            out[i:i + step] += np.where(u == v, 0.0, 1.0 + ((u != 0) & (v != 0)))
    return out


def _distances(a: np.ndarray, b: np.ndarray, codes: int = 0) -> np.ndarray:
    return np.sqrt(squared_distances(a, b, codes))


def _pivots(train: DataFrame, rows: int, count: int) -> np.ndarray:
    """About ``count`` different training vectors: rows whose id hashes below a threshold, so nothing is sorted or compared."""
    space = 1 << 40
    picked = train.where(F.pmod(F.xxhash64(F.lit("pivot"), "tid"), F.lit(space)) < F.lit(min(space, space * count // max(1, rows))))
    found = picked.select("x").collect()  # count rows, give or take its square root
    if not found:
        found = train.select("x").limit(1).collect()
    return np.unique(np.array([r["x"] for r in found], dtype=np.float64), axis=0) if found else np.zeros((0, 0))


class PivotTree:
    """Upper pivots, and below each the leaves that are nearest to it."""

    def __init__(self, points: np.ndarray, codes: int = 0) -> None:
        self.points, self.codes = points, codes
        step = max(1, round(len(points) ** 0.5))
        self.upper = points[::step]
        above = self.gaps(points, self.upper).argmin(axis=1)
        above[::step] = np.arange(len(self.upper))
        self.above = above
        self.leaves = [np.flatnonzero(above == t) for t in range(len(self.upper))]

    def gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _distances(a, b, self.codes)

    def planes(self, gaps: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Lower bounds from the planes halfway between each row's nearest point and the others; points' rows lie nearest to them."""
        home = gaps.argmin(axis=1)
        between = self.gaps(points, points)[home]
        mine = gaps[np.arange(len(gaps)), home][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.maximum(np.where(between > 0, (gaps**2 - mine**2) / (2 * between), 0.0), 0.0)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its leaf, the distance to the leaf pivot and the distance to the upper one."""
        gaps = self.gaps(x, self.upper)
        top = gaps.argmin(axis=1)
        leaf, gap = np.empty(len(x), np.int64), np.empty(len(x))
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            own = self.gaps(x[rows], self.points[self.leaves[t]])
            best = own.argmin(axis=1)
            leaf[rows], gap[rows] = self.leaves[t][best], own[np.arange(len(rows)), best]
        return leaf, gap, gaps[np.arange(len(x)), top]


def _with_cells(df: DataFrame, tree: PivotTree) -> DataFrame:
    """Add the leaf, the distance to its pivot and the distance to the pivot above."""
    shared = df.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, gap, upper = shared.value.place(_vectors(batch.column("x")))
                yield _widened(batch, cell=pa.array(cell.astype("int32")), gap=pa.array(gap), upper=pa.array(upper))

    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("gap", T.DoubleType()), T.StructField("upper", T.DoubleType())])
    return df.mapInArrow(assign, schema)


@dataclass
class Summary:
    """Per leaf: rows, smallest and largest gap, the k smallest gaps. Per upper pivot: smallest and largest distance of its rows.
    ``near`` has the gaps outside of each of ``folds``, then those of all rows."""

    tree: PivotTree
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: np.ndarray
    upper_low: np.ndarray
    upper_high: np.ndarray
    folds: np.ndarray

    def route(self, x: np.ndarray, k: int, own_folds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf) pairs that have to be searched, and the number of pivots each query was compared with."""
        tree = self.tree
        side = np.full(len(x), len(self.folds))
        if own_folds is not None:
            for i, f in enumerate(self.folds):
                side[own_folds == f] = i
        gaps = tree.gaps(x, tree.upper)
        below = np.maximum(np.maximum(gaps - self.upper_high, self.upper_low - gaps), tree.planes(gaps, tree.upper))
        below[:, self.upper_high < 0] = np.inf  # nobody there
        order = np.argsort(below, axis=1, kind="stable")
        best = np.full((len(x), k), np.inf)
        looked = np.full(len(x), len(tree.upper), np.int64)
        queries, leaves, bounds = [], [], []
        alive = np.arange(len(x))
        for r in range(len(tree.upper)):
            top = order[alive, r]
            go = below[alive, top] <= self._reach(best[alive, k - 1])
            alive, top = alive[go], top[go]  # later nodes are no nearer
            if not len(alive):
                break
            for t in np.unique(top):
                rows, own = alive[top == t], tree.leaves[t]
                own = own[self.rows[own] > 0]
                if not len(own):
                    continue
                g = tree.gaps(x[rows], tree.points[own])
                looked[rows] += len(own)
                near = self.near[side[rows][:, None], own[None, :]]
                seen = np.concatenate((best[rows], (g[:, :, None] + near).reshape(len(rows), -1)), axis=1)
                best[rows] = np.sort(np.partition(seen, k - 1, axis=1)[:, :k], axis=1)
                # Rows of a leaf are nearest to it among the leaves below the same pivot, empty ones included.
                least = np.maximum(np.maximum(g - self.high[own], self.low[own] - g), tree.planes(g, tree.points[own]))
                queries.append(np.repeat(rows, len(own)))
                leaves.append(np.tile(own, len(rows)))
                bounds.append(least.ravel())
        if not queries:
            return np.empty(0, np.int64), np.empty(0, np.int64), looked
        query, leaf, bound = np.concatenate(queries), np.concatenate(leaves), np.concatenate(bounds)
        keep = bound <= self._reach(best[query, k - 1])
        return query[keep], leaf[keep], looked

    @staticmethod
    def _reach(above: np.ndarray) -> np.ndarray:
        return above * (1 + SLACK) + SLACK + 2e-9


def _summary(placed: DataFrame, tree: PivotTree, k: int) -> Summary:
    """At most pivots × (k + 5) numbers reach the driver; with folds, k numbers for each pivot and fold."""
    count = len(tree.points)
    rows, low, high = np.zeros(count, np.int64), np.full(count, np.inf), np.full(count, -1.0)
    upper_low, upper_high = np.full(len(tree.upper), np.inf), np.full(len(tree.upper), -1.0)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"),
                                        F.min("upper").alias("ulow"), F.max("upper").alias("uhigh")).collect():
        rows[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
        t = tree.above[r["cell"]]
        upper_low[t], upper_high[t] = min(upper_low[t], r["ulow"]), max(upper_high[t], r["uhigh"])
    found = _smallest(placed, k)
    folds = np.unique([f for _, f in found if f is not None])
    near = np.full((len(folds) + 1, count, k), np.inf)
    for (cell, fold), gaps in found.items():
        for i in range(len(near)):
            if i == len(folds) or folds[i] != fold:
                near[i, cell] = np.sort(np.concatenate((near[i, cell], gaps)))[:k]
    return Summary(tree, rows, low, high, near, upper_low, upper_high, folds)


def nearest(train: DataFrame, test: DataFrame, features: Sequence[str] | str, train_id: str, test_id: str,
            k: int = 5, payload: str | None = None, pivots: int | None = None, chunk_rows: int = CHUNK_ROWS,
            small_bytes: int = SMALL_BYTES, codes: int = 0) -> DataFrame:
    """``(test_id, train_id, distance, rank[, payload])``: Euclidean, ties by the smaller training id. The last ``codes`` coordinates are
    category codes in place of one-hot columns (``squared_distances``).

    Rows with a missing coordinate have no distance and are left out on both sides. Ids must be unique. ``pivots``: about how many
    leaves the tree has, by default the square root of the training rows.
    """
    label = [col(payload).alias("payload")] if payload else []
    base = train.select(col(train_id).alias("tid"), vector_column(train, features).alias("x"), *label)
    asked = test.select(col(test_id).alias("qid"), vector_column(test, features).alias("x"))
    base = base.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    asked = asked.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))

    id_type, kind = base.schema["tid"].dataType, asked.schema["qid"].dataType
    out_fields = [T.StructField("qid", kind), T.StructField("tid", id_type), T.StructField("distance", T.DoubleType())]
    if payload:
        out_fields.append(T.StructField("payload", base.schema["payload"].dataType))
    base, few = _first_copies(base, k, small_bytes)
    if few:
        found = _by_broadcast(base, asked, T.StructType(out_fields), k, codes)
        return _named(found, test_id, train_id, payload)

    candidates = _by_tree(base, asked, T.StructType(out_fields), k, pivots, chunk_rows, codes)
    return _named(_ranked(candidates, k), test_id, train_id, payload)


def _by_tree(base: DataFrame, asked: DataFrame, schema: T.StructType, k: int, pivots: int | None = None,
             chunk_rows: int = CHUNK_ROWS, codes: int = 0) -> DataFrame:
    """For each query row the k best rows of each unit that can hold one of its neighbours. With a column ``fold`` on both sides, rows
    of its own fold are none. Other columns of ``schema`` come from the query rows."""
    spark = base.sparkSession
    built = _build(base, pivots, k, codes)
    if built is None:
        return spark.createDataFrame([], schema)
    placed, summary = built
    atoms, units = _units(summary, chunk_rows)
    sent = stage(_routed(asked, summary, k, units), "routed")
    sent = sent.withColumn("unit", F.explode("cells")).drop("cells", "looked")
    rows = max(chunk_rows, _unit_rows(summary))
    cuts = [(r["unit"], max(1, -(-r["n"] // rows))) for r in sent.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()]
    cuts = F.broadcast(spark.createDataFrame(cuts, "unit int, cuts int"))  # a row per unit
    atoms = F.broadcast(spark.createDataFrame(atoms, "cell int, atoms array<int>"))  # at most a row per pivot
    queries = sent.join(cuts, "unit").select(
        "unit", F.pmod(F.xxhash64("qid"), F.col("cuts")).cast("int").alias("cut"), *asked.columns)
    training = placed.join(atoms, "cell").withColumn(
        "unit", F.get("atoms", F.pmod(F.xxhash64("tid"), F.size("atoms")).cast("int"))).join(cuts, "unit").select(
        "unit", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), *base.columns)
    carried = [n for n in schema.names if n not in ("qid", "tid", "distance", "payload")]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            index = Index.of(right, codes)
            # All at once: groups taken from many query rows are compact, so they visit few boxes.
            found = [index.answer(b, k, carried) for b in left.combine_chunks().to_batches()]
        if found:
            return pa.Table.from_batches(found).select(schema.names)
        kinds = {"tid": right.schema.field("tid").type, "distance": pa.float64()}
        kinds |= {"payload": right.schema.field("payload").type} if "payload" in schema.names else {}
        return pa.Table.from_arrays([pa.array([], kinds[n] if n in kinds else left.schema.field(n).type) for n in schema.names],
                                    names=schema.names)

    return queries.groupBy("unit", "cut").cogroup(training.groupBy("unit", "cut")).applyInArrow(search, schema)


def _first_copies(base: DataFrame, k: int, limit: int, by: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """Of rows with equal vectors (and equal ``by``) the k with the smallest ids, and whether these are few enough to be broadcast.
    Spark cuts copies to k in each task before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.xxhash64("x"), "x", *by).orderBy(F.asc_nulls_last("tid"))
    kept = base.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= k).drop("_copy")
    others = [n for n in ("tid", "payload") if n in base.columns]
    if fits_in_memory(base, "x", limit, others):
        return kept, True
    kept = stage(kept, "copies")
    return kept, fits_in_memory(kept, "x", limit, others)


def _unit_rows(summary: Summary) -> int:
    return max(1, UNIT_BYTES // (8 * (summary.tree.points.shape[1] + 3)))


def _units(summary: Summary, chunk_rows: int) -> tuple[list[tuple[int, list[int]]], tuple[np.ndarray, np.ndarray]]:
    """For each leaf with rows the units of its chunks, and the first and last one of every leaf. Leaves below the same
    upper pivot lie side by side."""
    first, last = np.zeros(len(summary.rows), np.int64), np.full(len(summary.rows), -1)
    atoms, unit, held, room = [], 0, 0, max(chunk_rows, _unit_rows(summary))
    for leaf in [int(c) for t in summary.tree.leaves for c in t if summary.rows[c]]:
        parts = max(1, -(-int(summary.rows[leaf]) // chunk_rows))
        size, mine = int(summary.rows[leaf]) / parts, []
        for _ in range(parts):
            if held and held + size > room:
                unit, held = unit + 1, 0
            held += size
            mine.append(unit)
        first[leaf], last[leaf] = mine[0], mine[-1]
        atoms.append((leaf, mine))
    return atoms, (first, last)


def _build(base: DataFrame, pivots: int | None, k: int, codes: int = 0) -> tuple[DataFrame, Summary] | None:
    """Training rows with their leaves, written, and the summary of the tree; None for an empty table."""
    rows, width = base.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not rows:
        return None
    wanted = pivots or max(1, round(rows ** 0.5))
    tree = PivotTree(_pivots(base, rows, min(wanted, max(1, PIVOT_BYTES // (8 * max(1, width))))), codes)
    placed = stage(_with_cells(base, tree), "cells")
    return placed, _summary(placed, tree, k)


def _routed(asked: DataFrame, summary: Summary, k: int, units: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``qid, x, cells, looked`` and other columns: each query row once, with the units that have to be searched; ``looked`` counts
    pivots."""
    shared = asked.sparkSession.sparkContext.broadcast((summary, units))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, (first, last) = shared.value
        wide = int(last.max()) + 1
        for batch in batches:
            for at in range(0, batch.num_rows, ROUTE_ROWS):
                some = batch.slice(at, ROUTE_ROWS)
                folds = np.asarray(some.column("fold")) if "fold" in some.schema.names else None
                row, leaf, looked = found.route(_vectors(some.column("x")), k, folds)
                many = last[leaf] - first[leaf] + 1
                start = np.repeat(np.cumsum(many) - many, many)
                cell = np.repeat(first[leaf], many) + np.arange(many.sum()) - start
                row, cell = np.divmod(np.unique(np.repeat(row, many) * wide + cell), wide)
                ends = np.searchsorted(row, np.arange(some.num_rows + 1)).astype("int32")
                yield _widened(some, cells=pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype("int32"))),
                               looked=pa.array(looked))

    return asked.mapInArrow(route, T.StructType([
        *asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("looked", T.LongType())]))


def search_effort(train: DataFrame, test: DataFrame, features: Sequence[str] | str, train_id: str, test_id: str,
                  k: int = 5, pivots: int | None = None) -> DataFrame:
    """``(test_id, distances)``: how many distances the tree search computes for each query, pivots and candidates together."""
    base = train.select(col(train_id).alias("tid"), vector_column(train, features).alias("x"))
    asked = test.select(col(test_id).alias("qid"), vector_column(test, features).alias("x"))
    built = _build(base, pivots, k)
    if built is None:
        return asked.select(F.col("qid").alias(test_id), F.lit(0).cast("long").alias("distances"))
    _, summary = built
    sizes = train.sparkSession.createDataFrame([(c, n) for c, n in enumerate(summary.rows.tolist())], "cell int, n long")
    leaves = np.arange(len(summary.rows))
    return _routed(asked, summary, k, (leaves, leaves)).withColumn("cell", F.explode("cells")).join(
        F.broadcast(sizes), "cell").groupBy(F.col("qid").alias(test_id)).agg(
        (F.max("looked") + F.sum("n")).alias("distances"))


def _smallest(placed: DataFrame, k: int) -> dict[tuple, list[float]]:
    """The k smallest gaps of each cell and fold (None without folds): first k per slot, which Spark cuts before the shuffle, then k
    of those."""
    from pyspark.sql import Window

    keys = ["cell", *(["fold"] if "fold" in placed.columns else [])]
    first = Window.partitionBy(*keys, "slot").orderBy("gap")
    second = Window.partitionBy(*keys).orderBy("gap")
    rows = (
        placed.select(*keys, "gap", F.pmod(F.xxhash64("tid"), F.lit(SLOTS)).alias("slot"))
        .withColumn("i", F.row_number().over(first)).where(F.col("i") <= k)
        .withColumn("i", F.row_number().over(second)).where(F.col("i") <= k)
        .select("cell", F.col("fold") if "fold" in keys else F.lit(None).alias("fold"), "gap").collect()  # pivots × k numbers
    )
    out: dict[tuple, list[float]] = {}
    for r in sorted(rows, key=lambda r: r["gap"]):
        out.setdefault((r["cell"], r["fold"]), []).append(r["gap"])
    return out


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64, copy=False)


def _halves(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and where its parts begin: halves across the longest side, until a part has at most ``most`` rows."""
    order, starts, open_ = np.arange(len(x)), [], [(0, len(x))]
    while open_:
        a, b = open_.pop()
        if b - a <= most:
            starts.append(a)
            continue
        mid = (b - a) // 2
        if x.shape[1]:
            part = x[order[a:b]]
            side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order[a:b] = order[a:b][np.argpartition(part[:, side], mid)]
        open_ += [(a + mid, b), (a, a + mid)]
    return order, np.array(starts)


class Index:
    """Training rows in boxes. ``place`` is a row's place in id order, so that equal distances keep the smaller id first."""

    def __init__(self, points: np.ndarray, folds: np.ndarray | None, codes: int) -> None:
        self.codes, self.numbers = codes, points.shape[1] - codes
        self.wide = self.numbers >= WIDE
        self.place, starts = _halves(points[:, :self.numbers], (WIDE_ROWS if self.wide else NARROW_ROWS)[0])
        self.points, self.folds = points[self.place], None if folds is None else folds[self.place]
        self.ends = np.append(starts, len(points))
        plain = self.points[:, :self.numbers]
        self.low, self.high = np.minimum.reduceat(plain, starts), np.maximum.reduceat(plain, starts)

    def prepare(self) -> Index:
        """What follows from the points and is larger than they are: made once where rows are searched, it does not travel."""
        if self.wide and "sift32" not in vars(self):
            plain = self.points[:, :self.numbers]
            self.middle = plain.mean(axis=0)
            self.sift = np.empty((len(plain), self.numbers + 1))  # times (-2 q, 1): the squared distance to q less that of q
            moved = np.subtract(plain, self.middle, out=self.sift[:, :-1])
            norms = (moved * moved).sum(axis=1)
            self.longest = float(norms.max())
            self.sift[:, -1] = norms
            self.sift32 = self.sift.astype(np.float32)
        return self

    @classmethod
    def of(cls, rows: pa.Table, codes: int) -> Index:
        """One column at a time is put in id order, so the driver holds the table and little more."""
        order = pc.sort_indices(rows["tid"])
        folds = np.asarray(rows["fold"].take(order)) if "fold" in rows.column_names else None
        index = cls(_vectors(rows["x"])[order.to_numpy()], folds, codes)
        index.tid = rows["tid"].take(order).combine_chunks()
        index.payload = rows["payload"].take(order).combine_chunks() if "payload" in rows.column_names else None
        return index

    def answer(self, asked: pa.RecordBatch, k: int, carried: Sequence[str] = ()) -> pa.RecordBatch:
        """``qid, tid, distance[, payload], rank`` and ``carried`` columns for query rows ``qid, x[, fold]``."""
        names = asked.schema.names
        folds = np.asarray(asked.column(names.index("fold"))) if "fold" in names else None
        gaps, places = self.search(_vectors(asked.column(names.index("x"))), folds, k)
        row, rank = np.nonzero(np.isfinite(gaps))
        found = pa.array(places[row, rank])
        out = {"qid": asked.column(names.index("qid")).take(pa.array(row)), "tid": self.tid.take(found),
               "distance": pa.array(gaps[row, rank])}
        if self.payload is not None:
            out["payload"] = self.payload.take(found)
        out |= {n: asked.column(names.index(n)).take(pa.array(row)) for n in carried}
        out["rank"] = pa.array((rank + 1).astype("int32"))
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    def search(self, x: np.ndarray, folds: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and places of the k nearest rows of other folds, infinite where there are fewer."""
        gaps, places = np.full((len(x), k), np.inf), np.full((len(x), k), len(self.points))
        if len(x) and len(self.points):
            self.prepare()
            order, starts = _halves(x[:, :self.numbers], (WIDE_ROWS if self.wide else NARROW_ROWS)[1])
            for rows in np.split(order, starts[1:]):
                gaps[rows], places[rows] = self._group(x[rows], None if folds is None else folds[rows], k)
        return gaps, places

    def _group(self, x: np.ndarray, folds: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        gaps, places = np.full((len(x), k), np.inf), np.full((len(x), k), len(self.points))
        plain = x[:, :self.numbers]
        apart = np.maximum(np.maximum(self.low - plain.max(axis=0), plain.min(axis=0) - self.high), 0.0)
        bounds = np.sqrt((apart * apart).sum(axis=1)) * (1 - SLACK)
        for box in np.argsort(bounds, kind="stable"):
            if bounds[box] > gaps[:, -1].max():
                break
            a, b = self.ends[box], self.ends[box + 1]
            if self.wide:
                row, at = self._sifted(plain, a, b, gaps[:, -1], folds, k)
                gap = self._pairs(x, row, at)
            else:
                all_ = _distances(x, self.points[a:b], self.codes)
                if folds is not None:
                    all_[folds[:, None] == self.folds[None, a:b]] = np.inf
                limit = gaps[:, -1]
                if np.isinf(limit).any() and b - a > k:
                    limit = np.minimum(limit, np.partition(all_, k - 1, axis=1)[:, k - 1])
                row, at = np.nonzero((all_ <= limit[:, None]) & np.isfinite(all_))
                gap, at = all_[row, at], at + a
            if len(row):
                _merge(gaps, places, row, self.place[at], gap)
        return gaps, places

    def _sifted(self, plain: np.ndarray, a: int, b: int, limit: np.ndarray, folds: np.ndarray | None,
                k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query row and a row of the box that may be no further apart than the limit."""
        moved = plain - self.middle
        norms = (moved * moved).sum(axis=1)
        reach = limit * limit * (1 + SLACK)
        scale = 8 * (self.numbers + 8) * (float(norms.max()) + self.longest)  # of the rounding errors
        fine = scale * 2.0**-24 <= 1e-3 * reach.min() and np.isfinite(reach).all() and scale < 1e30
        error = scale * (2.0**-24 if fine else 2.0**-53)
        left = np.hstack((-2 * moved, np.ones((len(moved), 1))))
        product = left.astype(np.float32) @ self.sift32[a:b].T if fine else left @ self.sift[a:b].T
        if np.isinf(reach).any():
            seen = product + norms[:, None]
            if folds is not None:
                seen[folds[:, None] == self.folds[None, a:b]] = np.inf
            if b - a > k:
                reach = np.minimum(reach, np.partition(seen, k - 1, axis=1)[:, k - 1] + error + 2.0 * self.codes)
        near = product <= (reach - norms + error).astype(product.dtype)[:, None]
        row, at = np.divmod(np.flatnonzero(near), b - a)
        at += a
        if folds is not None:
            other = folds[row] != self.folds[at]
            row, at = row[other], at[other]
        return row, at

    def _pairs(self, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The distances of given pairs, by differences as in ``squared_distances``."""
        out = np.empty(len(row))
        step = max(1, BLOCK_NUMBERS // x.shape[1])
        for i in range(0, len(row), step):
            u, v = x[row[i:i + step]], self.points[at[i:i + step]]
            gap = u[:, :self.numbers] - v[:, :self.numbers]
            out[i:i + step] = np.einsum("ij,ij->i", gap, gap)
            for j in range(self.numbers, x.shape[1]):
                out[i:i + step] += np.where(u[:, j] == v[:, j], 0.0, 1.0 + ((u[:, j] != 0) & (v[:, j] != 0)))
        return np.sqrt(out)


def _merge(gaps: np.ndarray, places: np.ndarray, row: np.ndarray, place: np.ndarray, gap: np.ndarray) -> None:
    """Put found rows among the k best of their query rows, by distance, then place."""
    k, touched = gaps.shape[1], np.unique(row)
    r = np.concatenate((np.repeat(touched, k), row))
    p, g = np.concatenate((places[touched].ravel(), place)), np.concatenate((gaps[touched].ravel(), gap))
    order = np.lexsort((p, g, r))
    r = r[order]
    keep = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
    gaps[touched], places[touched] = g[keep].reshape(-1, k), p[keep].reshape(-1, k)


def _by_broadcast(base: DataFrame, asked: DataFrame, schema: T.StructType, k: int, codes: int = 0) -> DataFrame:
    """Search a training table whose size has been checked: it is broadcast, query rows stay where they are."""
    with _building:
        shared = base.sparkSession.sparkContext.broadcast(vars(Index.of(base.toArrow(), codes)))
    fields = [*schema.fields, T.StructField("rank", T.IntegerType())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.__new__(Index)  # plain arrays travel, so workers need no copy of this package
        vars(index).update(shared.value)
        shared.value.update(vars(index.prepare()))  # a worker's next task finds it made
        for batch in batches:
            if batch.num_rows:
                yield index.answer(batch, k).select([f.name for f in fields])

    spark = base.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if plan_bytes(asked) < cores * SPREAD_BYTES:
        asked = asked.repartition(cores)  # few bytes but much work per row: let every core take part
    return asked.mapInArrow(search, T.StructType(fields))


def _named(found: DataFrame, test_id: str, train_id: str, payload: str | None) -> DataFrame:
    return found.select(
        F.col("qid").alias(test_id), F.col("tid").alias(train_id if train_id != test_id else f"neighbour_{train_id}"),
        "distance", "rank", *([F.col("payload").alias(payload)] if payload else []),
    )


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates per query; Spark cuts each side to k per query before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy("distance", F.asc_nulls_last("tid"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fits_in_memory(train: DataFrame, vector: str = "x", limit: int = SMALL_BYTES, others: Sequence[str] = ()) -> bool:
    """Counts the bytes of vectors and of the columns that travel with them; True when they may be broadcast."""
    text = [F.sum(F.octet_length(F.col(n).cast("string"))) for n in others]
    more = F.lit(0)
    for t in text:
        more = more + F.coalesce(t, F.lit(0))
    rows, width, extra = train.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0)), more).first()
    return rows > 0 and rows * (width + 3) * 8 + extra <= limit


def knn_cross_validate(prepared: DataFrame, k: int = 5, codes: int = 0) -> DataFrame:
    """``(key, prediction)`` for a table ``key, label, x, fold``: every row asks the rows of the other folds.

    All folds share one broadcast and one pass, or one tree where the table is too large for that: both give the same answer.
    Rows with equal keys ask each for itself, and their neighbours vote together.
    """
    base = prepared.select(F.col("key").alias("tid"), "x", F.col("label").alias("payload"), "fold")
    base, few = _first_copies(base, k, SMALL_BYTES, ["fold"])
    kind, label = prepared.schema["key"].dataType, T.StructField("payload", base.schema["payload"].dataType)
    found = [T.StructField("tid", kind), T.StructField("distance", T.DoubleType()), label]
    if few:
        asked = prepared.select(F.col("key").alias("qid"), "x", "fold")
        near = _by_broadcast(base, asked, T.StructType([T.StructField("qid", kind), *found]), k, codes)
        return vote(_named(near, "key", "neighbour", "label"), "key", "label")
    asked = prepared.select(F.monotonically_increasing_id().alias("qid"), "key", "x", "fold")
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("key", kind), *found])
    near = _ranked(_by_tree(base, asked, schema, k, codes=codes), k)
    return vote(near.withColumnRenamed("payload", "label"), "key", "label")


def vote(neighbours: DataFrame, test_id: str, label: str) -> DataFrame:
    """``(test_id, prediction)``: the most frequent label among the neighbours, the smallest one on a tie."""
    counts = neighbours.groupBy(col(test_id), col(label)).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(col(test_id)).agg(
        F.min(F.struct((-F.col("n")).alias("n"), col(label).alias("label"))).alias("best")
    ).select(col(test_id), F.col("best.label").alias("prediction"))


def knn_predict(train: DataFrame, test: DataFrame, features: Sequence[str] | str, train_id: str, test_id: str,
                label: str, k: int = 5, **options) -> DataFrame:
    """Majority vote of the k nearest training rows."""
    return vote(nearest(train, test, features, train_id, test_id, k, label, **options), test_id, label)


# The functions that run in tasks travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
