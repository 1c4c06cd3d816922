"""Attribute roles, privacy models, generalisation at a node and suppression."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, entropy_term, percent_text, require_columns
from ..functions.joins import lookup, lookup_weighted
from ..functions.staging import broadcast_limit, plan_bytes, stage
from .hierarchy import TOP, Hierarchy, attach_all, label_column, validate_all

MARGIN = 1e-9  # so that a class whose entropy is exactly ln(l) passes in spite of rounding


@dataclass(frozen=True)
class Roles:
    """What each column is. Every column must have exactly one role."""

    quasi: tuple[str, ...]
    sensitive: tuple[str, ...] = ()
    insensitive: tuple[str, ...] = ()

    def check(self, df: DataFrame) -> Roles:
        named = [*self.quasi, *self.sensitive, *self.insensitive]
        if len(set(named)) != len(named):
            raise ValueError("a column has two roles")
        require_columns(df, named)
        open_columns = [c for c in df.columns if c not in named]
        if open_columns:
            raise ValueError(f"no role declared for {open_columns}")
        if not self.quasi:
            raise ValueError("at least one quasi-identifier is needed")
        return self


@dataclass(frozen=True)
class KAnonymity:
    """Every class has at least k rows."""

    k: int = 2

    def holds(self) -> Column:
        return F.col("size") >= F.lit(self.k)


@dataclass(frozen=True)
class DistinctLDiversity:
    """Every class shows at least l different values of the sensitive attribute; NULL is not counted as one."""

    attribute: str
    l: int = 2  # noqa: E741

    def holds(self) -> Column:
        return col(f"distinct_{self.attribute}") >= F.lit(self.l)


@dataclass(frozen=True)
class EntropyLDiversity:
    """The entropy of the sensitive attribute in every class is at least ln(l); NULL is one more value."""

    attribute: str
    l: float = 2.0  # noqa: E741

    def holds(self) -> Column:
        return col(f"entropy_{self.attribute}") >= F.lit(math.log(self.l) - MARGIN)


PrivacyModel = KAnonymity | DistinctLDiversity | EntropyLDiversity


def sensitive_of(models: Sequence[PrivacyModel]) -> list[str]:
    return sorted({m.attribute for m in models if not isinstance(m, KAnonymity)})


def _diversity(attribute: str) -> list[Column]:
    n = F.col("_n")
    total = F.sum(n).cast("double")
    return [
        F.count(col(attribute)).alias(f"distinct_{attribute}"),
        (F.ln(total) - F.sum(entropy_term(n)) / total).alias(f"entropy_{attribute}"),
    ]


def class_table(cells: DataFrame, keys: Sequence[str], models: Sequence[PrivacyModel],
                sums: Sequence[str] = (), same: Sequence[str] = ()) -> DataFrame:
    """Equivalence classes ``keys…, size, …, kept`` from weighted cells (column ``_n``).

    ``sums`` are added up, ``same`` are columns that the keys determine. With a sensitive attribute the cells are
    first combined per (class, value), so a class of any size is spread over many partial counts.
    """
    group = [col(k) for k in keys]
    carried = [F.sum(col(s)).alias(s) for s in sums] + [F.max(col(s)).alias(s) for s in same]
    attributes = sensitive_of(models)
    if len(attributes) == 1:
        a = attributes[0]
        per_value = cells.groupBy(*group, col(a)).agg(F.sum("_n").alias("_n"), *carried)
        table = per_value.groupBy(*group).agg(F.sum("_n").alias("size"), *carried, *_diversity(a))
    else:
        table = cells.groupBy(*group).agg(F.sum("_n").alias("size"), *carried)
        for a in attributes:
            per_value = cells.groupBy(*group, col(a)).agg(F.sum("_n").alias("_n"))
            part = per_value.groupBy(*group).agg(*_diversity(a))
            table = lookup(table, part, keys, [f"distinct_{a}", f"entropy_{a}"])
    kept = F.lit(True)
    for m in models:
        kept = kept & m.holds()
    return table.withColumn("kept", kept)


def generalised(attribute: str) -> str:
    return f"_g_{attribute}"


def check_node(hierarchies: Sequence[Hierarchy], node: Mapping[str, int]) -> dict[str, int]:
    names = [h.attribute for h in hierarchies]
    if sorted(node) != sorted(names):
        raise ValueError(f"the node names {sorted(node)}, the hierarchies {sorted(names)}")
    for h in hierarchies:
        if not 0 <= node[h.attribute] <= h.height:
            raise ValueError(f"level {node[h.attribute]} of {h.attribute!r} is not in 0..{h.height}")
    return {n: int(node[n]) for n in names}


def with_generalised(df: DataFrame, hierarchies: Sequence[Hierarchy], node: Mapping[str, int]) -> DataFrame:
    """Add ``_g_{attribute}``: the label at the node's level. Label arrays that are not yet there are attached."""
    node = check_node(hierarchies, node)
    todo = [h for h in hierarchies if label_column(h.attribute) not in df.columns]
    out = attach_all(df, todo)
    out = out.select(
        *[col(c) for c in out.columns],
        *[h.label(node[h.attribute]).alias(generalised(h.attribute)) for h in hierarchies],
    )
    return out.drop(*[label_column(h.attribute) for h in todo])


def generalise(df: DataFrame, hierarchies: Sequence[Hierarchy], node: Mapping[str, int]) -> DataFrame:
    """Replace every quasi-identifier by its label: a projection, plus one lookup join per lookup hierarchy."""
    validate_all(hierarchies)
    quasi = {h.attribute for h in hierarchies}
    marked = with_generalised(df, hierarchies, node)
    return marked.select(
        *[(col(generalised(c)).alias(c) if c in quasi else col(c)) for c in df.columns]
    )


def frequency_table(df: DataFrame, hierarchies: Sequence[Hierarchy], sensitive: Sequence[str] = ()) -> DataFrame:
    """The distinct quasi-identifier combinations with their counts ``_n`` and label arrays, written once.

    This is the only shuffle of the full table: the search, the classes and all loss metrics run on the result.
    """
    validate_all(hierarchies)
    quasi = [h.attribute for h in hierarchies]
    counts = df.groupBy(*[col(c) for c in [*quasi, *sensitive]]).agg(F.count(F.lit(1)).alias("_n"))
    return stage(attach_all(counts, hierarchies), "frequency")


@dataclass
class Anonymised:
    """A table at one node: its frequency table, its classes, and the rule which rows are suppressed."""

    source: DataFrame
    hierarchies: list[Hierarchy]
    node: dict[str, int]
    models: list[PrivacyModel]
    frequency: DataFrame
    classes: DataFrame = field(repr=False)

    @property
    def quasi(self) -> list[str]:
        return [h.attribute for h in self.hierarchies]

    @property
    def keys(self) -> list[str]:
        return [generalised(a) for a in self.quasi]

    def marked(self, df: DataFrame) -> DataFrame:
        """Add ``_g_…`` labels and ``_kept`` to a table with the quasi-identifiers (the source or the counts)."""
        labelled = with_generalised(df, self.hierarchies, self.node)
        classes = self.classes.select(*[col(k) for k in self.keys], F.col("kept").alias("_kept"), "size")
        bad = stage(classes.where(~F.col("_kept")).drop("size"), "violating")
        if plan_bytes(bad) <= broadcast_limit(df.sparkSession):
            joined = lookup(labelled, bad, self.keys, ["_kept"])
        else:
            joined = lookup_weighted(labelled, classes, self.keys, ["_kept"], "size")
        return joined.withColumn("_kept", F.coalesce(F.col("_kept"), F.lit(True)))

    def table(self, flag: str | None = None, drop_suppressed: bool = False) -> DataFrame:
        """The anonymised rows. A suppressed row has ``*`` in every quasi-identifier."""
        quasi = set(self.quasi)
        marked = self.marked(self.source)
        if drop_suppressed:
            marked = marked.where(F.col("_kept"))
        columns = [
            F.when(F.col("_kept"), col(generalised(c))).otherwise(F.lit(TOP)).alias(c) if c in quasi else col(c)
            for c in self.source.columns
        ]
        if flag:
            columns.append((~F.col("_kept")).alias(flag))
        return marked.select(*columns)

    def suppression(self) -> DataFrame:
        """One row: rows, suppressed rows, their share and the share as text."""
        lost = F.sum(F.when(~F.col("kept"), F.col("size")).otherwise(0))
        out = self.classes.agg(
            F.coalesce(F.sum("size"), F.lit(0)).alias("total_rows"), F.coalesce(lost, F.lit(0)).alias("suppressed")
        )
        share = F.coalesce(F.try_divide(F.col("suppressed"), F.col("total_rows")), F.lit(0.0))
        return out.withColumn("suppressed_share", share).withColumn("suppressed_text", percent_text(share))

    def class_statistics(self) -> DataFrame:
        """Number of kept classes and their average size."""
        return self.classes.where(F.col("kept")).agg(
            F.count(F.lit(1)).alias("classes"), F.avg("size").alias("average_class_size")
        )

    def check_limit(self, limit: float) -> Anonymised:
        share = self.suppression().first()["suppressed_share"]
        if share > limit + MARGIN:
            raise ValueError(f"{share:.4f} of the rows would be suppressed, the limit is {limit}")
        return self


def anonymise_at(df: DataFrame, hierarchies: Sequence[Hierarchy], node: Mapping[str, int],
                 models: Sequence[PrivacyModel] = (KAnonymity(2),), suppression_limit: float = 1.0,
                 frequency: DataFrame | None = None) -> Anonymised:
    """Generalise at a node, suppress the classes that break a privacy model, check the suppression limit."""
    node = check_node(hierarchies, node)
    if frequency is None:
        frequency = frequency_table(df, hierarchies, sensitive_of(models))
    cells = with_generalised(frequency, hierarchies, node)
    keys = [generalised(h.attribute) for h in hierarchies]
    classes = stage(class_table(cells, keys, models), "classes")
    out = Anonymised(df, list(hierarchies), node, list(models), frequency, classes)
    return out.check_limit(suppression_limit) if suppression_limit < 1.0 else out
