"""The whole anonymisation job: roles, search, generalisation, suppression, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.anonymity import (Anonymised, KAnonymity, PrivacyModel, Roles, anonymise_at, frequency_table,
                                   sensitive_of)
from ..operators.hierarchy import Hierarchy
from ..operators.lattice import Optimum, find_optimum
from ..operators.loss import attribute_report, loss_report
from ..sources.tables import write_anonymised


@dataclass
class AnonymisationResult:
    anonymised: Anonymised
    optimum: Optimum | None

    @property
    def node(self) -> dict[str, int]:
        return self.anonymised.node

    def table(self, **options) -> DataFrame:
        return self.anonymised.table(**options)

    def metrics(self) -> DataFrame:
        return loss_report(self.anonymised)

    def attribute_metrics(self) -> DataFrame:
        return attribute_report(self.anonymised)


def anonymise(df: DataFrame, roles: Roles, hierarchies: Sequence[Hierarchy],
              models: Sequence[PrivacyModel] = (KAnonymity(2),), suppression_limit: float = 1.0,
              objective: str = "loss", node: Mapping[str, int] | None = None,
              output: str | None = None) -> AnonymisationResult:
    """Find the least lossy node (or take the given one), apply it and optionally write the table as ``;`` text."""
    roles.check(df)
    if sorted(roles.quasi) != sorted(h.attribute for h in hierarchies):
        raise ValueError("every quasi-identifier needs exactly one hierarchy")
    undeclared = [a for a in sensitive_of(models) if a not in roles.sensitive]
    if undeclared:
        raise ValueError(f"privacy models need {undeclared} to be sensitive")
    frequency = frequency_table(df, hierarchies, sensitive_of(models))
    optimum = None
    if node is None:
        optimum = find_optimum(None, hierarchies, models, suppression_limit, objective, frequency)
        node = optimum.node
    result = AnonymisationResult(
        anonymise_at(df, hierarchies, node, models, suppression_limit, frequency), optimum
    )
    if output is not None:
        write_anonymised(result.table(), output)
    return result
