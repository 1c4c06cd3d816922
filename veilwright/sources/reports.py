"""Small result tables as files: model scores, the cleaning report, the evaluation of a synthetic table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_model_scores(results: DataFrame, path: str) -> str:
    """Tab-separated with a header, one file: one row per (variant, model)."""
    results.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return path


def read_model_scores(spark: SparkSession, path: str) -> DataFrame:
    schema = "Dataset string, Model string, Accuracy double, Precision double, Recall double, F1 double"
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def write_cleaning_report(report: DataFrame, path: str) -> str:
    """The one-row report of ``operators.missing.missing_report`` as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_evaluation(diagnostic: DataFrame, quality: DataFrame, folder: str) -> str:
    """Diagnostic and quality rows, one row per property, as JSON files below ``folder``."""
    diagnostic.coalesce(1).write.mode("overwrite").json(f"{folder}/diagnostic")
    quality.coalesce(1).write.mode("overwrite").json(f"{folder}/quality")
    return folder
