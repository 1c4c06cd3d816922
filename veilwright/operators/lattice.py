"""Search for the generalisation levels that lose the least.

A node is one level per quasi-identifier. Its cost is additive over rows and attributes: a kept row pays the weight
of its labels, a suppressed row pays the weight of the top label everywhere.

* objective ``loss``: weight = (leaves-1)/(domain-1)
* objective ``entropy``: weight = log2 freq(label) - log2 freq(value)

All nodes are scored on the frequency table, never on base rows: a batch of nodes is one job, in which every cell, rolled up as
far as the batch allows, is exploded to the nodes and grouped by (node, class).

The search goes best-first and never lists the nodes. A node's bound is its cost without suppression plus what the rows cost
that a few attributes alone already force out; subsets of attributes are examined size after size, and what a smaller part
rules out by the suppression limit or by cost is never asked of a larger one. Both bounds hold for all coarser nodes too, so the
search ends when the least bound on the frontier exceeds the best cost found.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.joins import lookup
from ..functions.staging import stage
from .anonymity import MARGIN, EntropyLDiversity, KAnonymity, PrivacyModel, class_table, frequency_table, sensitive_of
from .hierarchy import Hierarchy, label_column, validate_all
from .loss import ground_values, label_weights

OBJECTIVES = ("loss", "entropy")
ONE_JOB_CELLS = 20_000_000
LEAST_BATCH, LARGEST_BATCH = 8, 256
CLOSE = 1e-9  # costs closer than this count as equal


@dataclass
class Lattice:
    """Weighted cells: one path (labels with weights, level 0 upwards) per quasi-identifier, plus bounds per level."""

    hierarchies: list[Hierarchy]
    cells: DataFrame  # _p0.., sensitive.., _n, _s
    sensitive: list[str]
    rows: int
    cell_count: int
    top: float  # what one suppressed row pays before its own s is taken off
    bounds: list[list[float]]  # [attribute][level]: cost of generalisation alone
    scale: float  # divides costs: the cost of suppressing everything

    @property
    def heights(self) -> list[int]:
        return [h.height for h in self.hierarchies]

    def nodes(self) -> list[tuple[int, ...]]:
        every = itertools.product(*[range(h + 1) for h in self.heights])
        return sorted(every, key=lambda v: (sum(v), v))

    def bound(self, node: Sequence[int]) -> float:
        return sum(self.bounds[i][level] for i, level in enumerate(node)) / self.scale


def build_lattice(frequency: DataFrame, hierarchies: Sequence[Hierarchy], objective: str = "loss",
                  sensitive: Sequence[str] = ()) -> Lattice:
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective!r}: one of {OBJECTIVES}")
    values = stage(ground_values(frequency, hierarchies), "values")
    weights = label_weights(values, hierarchies)
    if objective == "loss":
        weight = F.coalesce(F.try_divide(F.col("leaves") - 1.0, F.col("domain") - 1.0), F.lit(0.0))
    else:
        weight = F.when(F.col("rows") > 0, F.log2(F.col("rows").cast("double"))).otherwise(F.lit(0.0))
    weights = weights.withColumn("_w", weight)
    steps = values.where("_n > 0").select(
        "attribute", F.get("labels", F.lit(0)).alias("value"), "_n", F.posexplode("labels").alias("level", "label")
    )
    weighted = lookup(steps, weights, ["attribute", "level", "label"], ["_w"])
    paths = stage(
        weighted.groupBy("attribute", "value", "_n").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("level", "label", "_w"))),  # one entry per level
                lambda e: F.struct(e["label"].alias("label"), e["_w"].alias("_w")),
            ).alias("path")
        ),
        "paths",
    )
    cells = frequency
    for i, h in enumerate(hierarchies):
        own = paths.where(F.col("attribute") == h.attribute).select(
            F.col("value").alias(f"_v{i}"), F.col("path").alias(f"_p{i}")
        )
        cells = lookup(cells.withColumn(f"_v{i}", F.get(col(label_column(h.attribute)), F.lit(0))), own,
                       [f"_v{i}"], [f"_p{i}"])
    own_cost = F.lit(0.0)
    if objective == "entropy":
        for i in range(len(hierarchies)):
            own_cost = own_cost + F.get(col(f"_p{i}"), F.lit(0))["_w"]
    cells = cells.select(*[f"_p{i}" for i in range(len(hierarchies))], *[col(s) for s in sensitive], "_n",
                         (F.col("_n") * own_cost).alias("_s"))
    # Bounded driver state from here on: one number per (attribute, level), and totals.
    per_level = paths.select("attribute", "_n", F.posexplode("path").alias("level", "step")).groupBy(
        "attribute", "level"
    ).agg(F.sum(F.col("_n") * F.col("step._w")).alias("cost"))
    cost = {(r["attribute"], r["level"]): r["cost"] for r in per_level.collect()}
    totals = frequency.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("cells")).first()
    rows = totals["rows"] or 0
    own_total = sum(cost.get((h.attribute, 0), 0.0) for h in hierarchies) if objective == "entropy" else 0.0
    bounds = []
    for h in hierarchies:
        base = cost.get((h.attribute, 0), 0.0) if objective == "entropy" else 0.0
        bounds.append([cost.get((h.attribute, level), 0.0) - base for level in range(h.height + 1)])
    q = len(hierarchies)
    top = float(q) if objective == "loss" else q * math.log2(rows) if rows else 0.0
    scale = (rows * top - own_total) or 1.0
    return Lattice(list(hierarchies), cells, list(sensitive), rows, totals["cells"], top, bounds, scale)


def _summary(classes: DataFrame, lattice: Lattice) -> DataFrame:
    """``(node, cost, suppressed, classes)`` from the class tables of many nodes."""
    kept_cost = F.col("size") * F.col("_w") - F.col("_s")
    lost_cost = F.col("size") * F.lit(lattice.top) - F.col("_s")
    return classes.groupBy(F.col("_node").alias("node")).agg(
        (F.sum(F.when(F.col("kept"), kept_cost).otherwise(lost_cost)) / F.lit(lattice.scale)).alias("cost"),
        F.sum(F.when(F.col("kept"), 0).otherwise(F.col("size"))).alias("suppressed"),
        F.sum(F.when(F.col("kept"), 1).otherwise(0)).alias("classes"),
    )


def _heads(lattice: Lattice, at: Column | None = None) -> list[Column]:
    steps = []
    for i in range(len(lattice.hierarchies)):
        index = F.lit(0) if at is None else F.get(at, F.lit(i))
        steps.append(F.get(col(f"_p{i}"), index))
    return steps


def _class_cells(cells: DataFrame, lattice: Lattice, at: Column | None) -> DataFrame:
    heads = _heads(lattice, at)
    weight = heads[0]["_w"]
    for h in heads[1:]:
        weight = weight + h["_w"]
    return cells.select(
        "_node", *[h["label"].alias(f"_c{i}") for i, h in enumerate(heads)],
        *[col(s) for s in lattice.sensitive], "_n", "_s", weight.alias("_w"),
    )


def score_nodes(lattice: Lattice, models: Sequence[PrivacyModel],
                nodes: Sequence[tuple[int, ...]] | None = None) -> DataFrame:
    """Score nodes in one job: ``(node array<int>, cost, suppressed, classes, bound)``."""
    nodes = list(nodes) if nodes is not None else lattice.nodes()
    wanted = F.array(*[F.array(*[F.lit(int(x)) for x in n]) for n in nodes])
    cells = lattice.cells.select("*", F.explode(wanted).alias("_node"))
    keyed = _class_cells(cells, lattice, F.col("_node"))
    keys = ["_node", *[f"_c{i}" for i in range(len(lattice.hierarchies))]]
    return _summary(class_table(keyed, keys, models, sums=["_s"], same=["_w"]), lattice)


def _monotone(models: Sequence[PrivacyModel]) -> bool:
    """Whether a row that is kept at a node is kept at every coarser one: an entropy may fall when classes merge."""
    return not any(isinstance(m, EntropyLDiversity) for m in models)


def _projections(lattice: Lattice, models: Sequence[PrivacyModel], asked: dict[tuple[int, ...], list[tuple[int, ...]]]
                 ) -> dict[tuple[tuple[int, ...], tuple[int, ...]], tuple[int, float]]:
    """(attributes, levels) → rows suppressed and what that adds to the cost, when only these attributes count.

    Subsets of one size are one job: cells are counted by the subset's ground values first, which partial counts keep small, then
    each count visits the levels asked for. One row per subset and node comes back.
    """
    subsets = list(asked)
    size = len(subsets[0])
    views = F.array(*[
        F.struct(F.lit(j).alias("_id"), F.array(*[col(f"_p{i}") for i in s]).alias("_paths")) for j, s in enumerate(subsets)])
    seen = lattice.cells.select(F.explode(views).alias("_view"), *[col(x) for x in lattice.sensitive], "_n").select(
        "_view._id", "_view._paths", *[col(x) for x in lattice.sensitive], "_n")
    counts = seen.groupBy("_id", "_paths", *[col(x) for x in lattice.sensitive]).agg(F.sum("_n").alias("_n"))
    spark = lattice.cells.sparkSession
    wanted = spark.createDataFrame([(j, [list(u) for u in asked[s]]) for j, s in enumerate(subsets)],
                                   "_id int, _nodes array<array<int>>")  # at most a row per subset
    steps = F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                        lambda i: F.get(F.get(F.col("_paths"), i), F.get(F.col("_node"), i)))
    keyed = counts.join(F.broadcast(wanted), "_id").select("*", F.explode("_nodes").alias("_node")).select(
        "*", steps.alias("_steps")).select(
        "_id", "_node", F.transform("_steps", lambda x: x["label"]).alias("_labels"), *[col(x) for x in lattice.sensitive], "_n",
        F.aggregate("_steps", F.lit(0.0), lambda total, x: total + x["_w"]).alias("_w"))
    classes = class_table(keyed, ["_id", "_node", "_labels"], models, same=["_w"])
    top = lattice.top * size / len(lattice.hierarchies)
    lost = classes.where(~F.col("kept")).groupBy("_id", "_node").agg(
        F.sum("size").alias("rows"), F.sum(F.col("size") * (F.lit(top) - F.col("_w"))).alias("more"))
    found = {(subsets[r["_id"]], tuple(r["_node"])): (r["rows"], r["more"]) for r in lost.collect()}
    return {(s, u): found.get((s, u), (0, 0.0)) for s, us in asked.items() for u in us}


@dataclass
class Bounds:
    """A lower bound of the cost of a node and of all coarser ones.

    Rows that a few attributes alone make too rare are suppressed whatever the other attributes say, so the cost over a
    subset of attributes, its suppressed rows included, bounds the whole; levels of a subset that suppress more than the limit
    cannot be part of an answer. ``more[s][u]``: what the best levels of subset s at or above u cost beyond generalisation to u.
    Subsets of ``pairs`` share no attribute, so theirs add up.
    """

    lattice: Lattice
    more: dict[tuple[int, ...], dict[tuple[int, ...], float]] = field(default_factory=dict)
    pairs: list[tuple[int, ...]] = field(default_factory=list)

    def of(self, node: Sequence[int]) -> float:
        extra = {s: table[tuple(node[i] for i in s)] for s, table in self.more.items()}
        best = max(max(extra.values(), default=0.0), sum(extra[s] for s in self.pairs))
        return self.lattice.bound(node) + best


def _least_above(values: dict[tuple[int, ...], float]) -> dict[tuple[int, ...], float]:
    """For each level vector the least value at or above it; vectors without a value are impossible."""
    out: dict[tuple[int, ...], float] = {}
    size = len(next(iter(values)))
    for u in sorted(values, reverse=True):  # a coarser vector comes first
        above = [out[v] for i in range(size) if (v := tuple(x + (j == i) for j, x in enumerate(u))) in out]
        out[u] = min([values[u], *above])
    return out


def subset_bounds(lattice: Lattice, models: Sequence[PrivacyModel], limit: float, best: float, largest: int) -> Bounds:
    """Bounds from all subsets of up to ``largest`` attributes, size after size: a subset's levels are examined only when all
    its smaller parts can still be within the limit and cheaper than ``best``."""
    q = len(lattice.hierarchies)
    bounds = Bounds(lattice)
    exact = _monotone(models)
    if not exact and limit > 0:
        return bounds  # rows that a part suppresses may be kept by the whole
    possible: dict[tuple[int, ...], set[tuple[int, ...]]] = {}
    for size in range(1, min(largest, q - 1) + 1):
        asked: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for s in itertools.combinations(range(q), size):
            parts = [(tuple(x for j, x in enumerate(s) if j != i), i) for i in range(size)] if size > 1 else []
            nodes = [u for u in itertools.product(*[range(lattice.heights[i] + 1) for i in s])
                     if all(tuple(x for j, x in enumerate(u) if j != i) in possible[part] for part, i in parts)]
            possible[s] = set()
            if nodes:
                asked[s] = nodes
        if not asked:
            break
        found = _projections(lattice, models, asked)
        for s in itertools.combinations(range(q), size):
            every = itertools.product(*[range(lattice.heights[i] + 1) for i in s])
            plain = {u: sum(lattice.bounds[i][x] for i, x in zip(s, u, strict=True)) / lattice.scale for u in every}
            values = dict.fromkeys(plain, math.inf)
            for u in asked.get(s, []):
                lost, more = found[s, u]
                if lost <= limit * lattice.rows + MARGIN:
                    cost = plain[u] + (more / lattice.scale if exact else 0.0)
                    if cost <= best + CLOSE:
                        values[u] = cost
                        possible[s].add(u)
            least = _least_above(values)
            bounds.more[s] = {u: max(0.0, least[u] - plain[u]) for u in plain}
    taken: set[int] = set()
    for s, table in sorted(bounds.more.items(), key=lambda e: (-e[1][tuple([0] * len(e[0]))], e[0])):
        if taken.isdisjoint(s):
            bounds.pairs.append(s)
            taken.update(s)
    return bounds


def _score_batch(lattice: Lattice, models: Sequence[PrivacyModel], nodes: list[tuple[int, ...]]) -> list[dict]:
    """Score nodes in one job, from cells rolled up to the finest levels that any of them needs."""
    q = len(lattice.hierarchies)
    meet = [min(n[i] for n in nodes) for i in range(q)]
    if any(meet):
        paths = [F.slice(col(f"_p{i}"), meet[i] + 1, lattice.heights[i] + 1 - meet[i]).alias(f"_p{i}") for i in range(q)]
        sensitive = [col(x) for x in lattice.sensitive]
        rolled = lattice.cells.select(*paths, *sensitive, "_n", "_s").groupBy(*[f"_p{i}" for i in range(q)], *sensitive).agg(
            F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        lattice = replace(lattice, cells=rolled)
    moved = [tuple(x - m for x, m in zip(n, meet, strict=True)) for n in nodes]
    rows = [r.asDict() for r in score_nodes(lattice, models, moved).collect()]  # one row per node of the batch
    return [r | {"node": [x + m for x, m in zip(r["node"], meet, strict=True)]} for r in rows]


def _best_first(lattice: Lattice, models: Sequence[PrivacyModel], limit: float, batch: int, largest: int) -> list[dict]:
    """Score nodes in the order of their bounds until no bound is below the best cost.

    The frontier is a heap on the driver. A node's children raise its last raised attribute or a later one, so each node has one
    way to it and no list of nodes is kept. Bounds never fall on that way.
    """
    q = len(lattice.hierarchies)
    lattice = replace(lattice, cells=stage(lattice.cells, "cells"))

    def fits(r: dict) -> bool:
        return r["suppressed"] <= limit * lattice.rows + MARGIN

    scored = {tuple(r["node"]): r for r in _score_batch(lattice, models, _chain(lattice))}
    best = min([r["cost"] for r in scored.values() if fits(r)], default=math.inf)
    nodes = math.prod(h + 1 for h in lattice.heights)
    bounds = Bounds(lattice) if nodes <= batch else subset_bounds(lattice, models, limit, best, largest)
    start = tuple([0] * q)
    frontier = [(bounds.of(start), start)]
    while frontier and frontier[0][0] <= best + CLOSE:
        asked: list[tuple[int, ...]] = []
        while frontier and len(asked) < batch and frontier[0][0] <= best + CLOSE:
            _, node = heapq.heappop(frontier)
            if node not in scored:
                asked.append(node)
            last = max((i for i in range(q) if node[i] > 0), default=0)
            for axis in range(last, q):
                if node[axis] < lattice.heights[axis]:
                    child = tuple(x + (i == axis) for i, x in enumerate(node))
                    bound = bounds.of(child)
                    if bound <= best + CLOSE:
                        heapq.heappush(frontier, (bound, child))
        for r in _score_batch(lattice, models, asked) if asked else []:
            scored[tuple(r["node"])] = r
            if fits(r):
                best = min(best, r["cost"])
    return list(scored.values())


def _chain(lattice: Lattice) -> list[tuple[int, ...]]:
    """Nodes from bottom to top, one step at a time, the cheapest generalisation first: they give a first cost to beat."""
    node, chain = [0] * len(lattice.hierarchies), []
    while True:
        chain.append(tuple(node))
        steps = [i for i, h in enumerate(lattice.heights) if node[i] < h]
        if not steps:
            return chain
        cheapest = min(steps, key=lambda i: (lattice.bounds[i][node[i] + 1] - lattice.bounds[i][node[i]], i))
        node[cheapest] += 1


@dataclass
class Optimum:
    """``scored``: the nodes that were examined, a dictionary each; no other node within the limit costs as little."""

    node: dict[str, int]
    cost: float
    suppressed: int
    scored: list[dict]

    def levels(self, spark) -> DataFrame:
        """The chosen level of every quasi-identifier: ``(attribute, level)``."""
        return spark.createDataFrame([(a, v) for a, v in self.node.items()], "attribute string, level int")


def find_optimum(df: DataFrame | None, hierarchies: Sequence[Hierarchy],
                 models: Sequence[PrivacyModel] = (KAnonymity(2),), suppression_limit: float = 1.0,
                 objective: str = "loss", frequency: DataFrame | None = None,
                 one_job_cells: int = ONE_JOB_CELLS, subsets: int = 2) -> Optimum:
    """The node with the lowest cost within the suppression limit; ties go to the lowest total level, then levels.

    ``one_job_cells``: cells times nodes of one job. ``subsets``: bounds come from all subsets of up to so many attributes.
    """
    sensitive = sensitive_of(models)
    validate_all(hierarchies)
    if frequency is None:
        frequency = frequency_table(df, hierarchies, sensitive)
    lattice = build_lattice(frequency, hierarchies, objective, sensitive)
    batch = max(LEAST_BATCH, min(LARGEST_BATCH, one_job_cells // max(1, lattice.cell_count)))
    scored = _best_first(lattice, models, suppression_limit, batch, subsets)
    fit = [r for r in scored if r["suppressed"] <= suppression_limit * lattice.rows + MARGIN]
    if not fit:
        raise ValueError("no node satisfies the privacy models within the suppression limit")
    best = min(r["cost"] for r in fit)
    win = min((r for r in fit if r["cost"] <= best + CLOSE), key=lambda r: (sum(r["node"]), list(r["node"])))
    names = [h.attribute for h in hierarchies]
    return Optimum(dict(zip(names, [int(x) for x in win["node"]], strict=True)), win["cost"], win["suppressed"],
                   scored)
