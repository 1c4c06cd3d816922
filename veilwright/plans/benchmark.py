"""From a file to the comparison of original and synthetic data, in two orders of steps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.staging import scratch_path
from ..operators import fidelity
from ..operators.classifiers import KNN
from ..operators.metadata import detect_kinds
from ..operators.missing import drop_missing, missing_report
from ..operators.summary import compare_models
from ..sources.reports import write_cleaning_report, write_evaluation, write_model_scores
from ..sources.tables import load_table
from .preprocess import preprocess
from .synthesise import synthesise
from .utility import run_utility, simple_split, target_shares


@dataclass
class BenchmarkResult:
    name: str
    report: DataFrame | None
    diagnostic: DataFrame | None
    quality: DataFrame | None
    results: DataFrame
    comparison: DataFrame
    shares: DataFrame | None = None

    def steps(self) -> DataFrame:
        """Everything as ``(step, metric, value)``, so that one action runs the whole benchmark."""
        parts = [_long(self.results, "results", ["Dataset", "Model"]), _long(self.comparison, "comparison", ["Model"])]
        if self.report is not None:
            parts.append(_long(self.report.drop("dataset"), "report", []))
        for step, table in (("diagnostic", self.diagnostic), ("quality", self.quality)):
            if table is not None:
                parts.append(_long(table, step, ["property"]))
        if self.shares is not None:
            target = next(c for c in self.shares.columns if c not in ("variant", "n", "share"))
            parts.append(_long(self.shares, "shares", ["variant", target]))
        return reduce(DataFrame.unionByName, parts)


def _long(table: DataFrame, step: str, names: Sequence[str]) -> DataFrame:
    """The number columns of a small table as rows; a metric is named after the row's names and the column."""
    numbers = [c for c in table.columns if c not in names]
    metric = [F.coalesce(col(n).cast("string"), F.lit("")) for n in names]
    pairs = [F.struct(F.concat_ws(" / ", *metric, F.lit(c)).alias("metric"), col(c).cast("double").alias("value")) for c in numbers]
    return table.select(F.lit(step).alias("step"), F.inline(F.array(*pairs)))


def run_benchmark(spark: SparkSession, path: str, sep: str, target: str, key: str | None = None,
                  strategy: str | None = "drop", enable_synthetic: bool = True, synthesizer: str = "GaussianCopula",
                  rows: str = "same_as_original", custom_rows: int | None = None, test_size: float = 0.2,
                  models: Sequence[str] = (KNN,), seed: int = 42, fit_on: str = "train",
                  model_folder: str | None = None, output_folder: str | None = None,
                  options: Mapping[str, dict] | None = None) -> BenchmarkResult:
    """Clean → split → synthesise → evaluate → encode with one vocabulary → train → compare.

    Synthesis works on the cleaned table before encoding, on training rows only unless ``fit_on='all'``.
    """
    ready = preprocess(spark, path, sep, target, strategy)
    train, test, key = simple_split(ready.cleaned, key, test_size, seed)
    kinds = detect_kinds(ready.cleaned)
    synthetic = diagnostic = quality = None
    if enable_synthetic:
        source = train if fit_on == "train" else ready.cleaned
        folder = output_folder or scratch_path(spark, "synthetic")
        model_kinds = {**kinds, key: "id"}
        made = synthesise(source, ready.name, synthesizer, rows, custom_rows, seed, model_folder, folder, model_kinds)
        synthetic = made.table
        diagnostic = fidelity.diagnostic(source, synthetic, kinds)
        quality = fidelity.quality(source, synthetic, kinds)
    results = run_utility(train, test, target, key, synthetic, models=models, seed=seed, kinds=kinds, options=options)
    if output_folder is not None:
        write_cleaning_report(ready.report, f"{output_folder}/preprocessing_report")
        if enable_synthetic:
            write_evaluation(diagnostic, quality, f"{output_folder}/synthetic_data_evaluation")
        write_model_scores(results, f"{output_folder}/model_performance")
    return BenchmarkResult(ready.name, ready.report, diagnostic, quality, results, compare_models(results))


def run_one_hot_benchmark(spark: SparkSession, path: str, sep: str, target: str, key: str | None = None,
                          test_size: float = 0.2, models: Sequence[str] = (KNN,), seed: int = 42,
                          options: Mapping[str, dict] | None = None) -> BenchmarkResult:
    """Drop missing → synthesise ⌊n·(1-test_size)⌋ rows from the raw table → one-hot both → split → train → compare.

    One-hot columns are kept as codes, so categories may be many (``operators.encoding.CodeEncoder``)."""
    raw, name = load_table(spark, path, sep)
    original = drop_missing(raw)
    train, test, key = simple_split(original, key, test_size, seed)
    kinds = detect_kinds(original)
    wanted = math.floor(original.count() * (1.0 - test_size))
    made = synthesise(train, name, rows="custom", custom_rows=wanted, seed=seed, kinds={**kinds, key: "id"},
                      output_folder=scratch_path(spark, "synthetic"))
    results = run_utility(train, test, target, key, made.table, models=models, seed=seed, encoding="codes",
                          kinds=kinds, options=options)
    evaluated = {**kinds, key: "id"}
    return BenchmarkResult(name, missing_report(raw, original, name),
                           fidelity.diagnostic(train, made.table, evaluated), fidelity.quality(train, made.table, evaluated),
                           results, compare_models(results), target_shares(train, made.table, target))
