"""Registered queries: a name, a Spark job over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sketches import quantile_sketches, rank_gaps
from ..functions.staging import stage

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"two queries named {name}")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles to a fixed number of digits, for comparison across engines."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def draw(key: str, seed: int) -> str:
    """The SQL of ``functions.hashing.key_hash``."""
    return f"(('0x' || substr(md5('{seed}:' || {key}::varchar), 1, 8))::bigint)"


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in which every seventh price and every fifth priority is missing."""
    o = table(spark, sf_dir, "orders")
    return o.withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")),
    })


GAPS = """gaps AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority
  FROM orders)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none, so quality and toxic are NULL there."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = """labelled AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def sketch_check(df: DataFrame, columns, probabilities, error: float) -> DataFrame:
    """Per column: values, answers of the sketch, and whether every answer's rank is within the sketch's bound and that bound
    within ``error`` of the values."""
    answers = stage(quantile_sketches(df, columns, probabilities, error), "sketches")
    gaps = rank_gaps(df, columns, answers, probabilities)
    sound = gaps.groupBy(F.col("column").alias("c")).agg(
        F.count(F.lit(1)).alias("answers"), F.min(F.col("gap") <= F.col("rank_error")).alias("all"))
    return answers.join(sound, F.col("column") == F.col("c")).select(
        "column", "n", "answers", (F.col("all") & (F.col("rank_error") <= F.ceil(F.col("n") * F.lit(error)))).alias("within"))


def sketch_sql(source: str, columns, answers: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, CAST({answers} AS BIGINT) AS answers, true AS within FROM {source}""" for c in columns)
