"""From raw documents to packed training sequences, in five stages.

Each stage gets the documents its predecessor kept, with all their columns, and is written as Parquet before the next one
reads it. The last stage returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwright.functions.staging import broadcast_limit, plan_bytes, scratch_path, stage
from veilwright.llm import decontamination, jaccard_join, packing, quality, toxicity
from veilwright.llm.common import table
from veilwright.llm.queries import WORD_BPE

#: What counts as a near copy in a corpus; the defaults of jaccard_join are those of the op1 query.
NEAR = jaccard_join.JaccardJoin(words=5, percent=80)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


FILTER_WORDS = 1 << 19  # of 64 bits: the filter of dropped names is broadcast, so its size is fixed


def _word(*name: str) -> Column:
    return F.pmod(F.xxhash64(*name), F.lit(FILTER_WORDS))


def _bits(*name: str) -> Column:
    """Four bits of a name in its word of the filter."""
    places = [F.pmod(F.xxhash64(F.lit(i), *name), F.lit(64)).cast("int") for i in range(4)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), i) for i in places])


def _without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` that no row of ``gone`` (doc_id, text_key) names.

    Documents stay where they are: few names are broadcast, of many a filter of fixed size. Rows that pass it are kept. Of
    the others the names alone are compared, and those that the filter held by chance are kept as well."""
    names = stage(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct(), "gone")
    marked = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", key)
    same = F.col("__id").eqNullSafe(F.col("__gone_id")) & F.col("__key").eqNullSafe(F.col("__gone_key"))
    if plan_bytes(names) <= broadcast_limit(docs.sparkSession):
        return marked.join(names, same, "left_anti").select(*docs.columns)
    held = stage(names.select(_word("__gone_id", "__gone_key").alias("__word"), _bits("__gone_id", "__gone_key").alias("__b"))
                 .groupBy("__word").agg(F.bit_or("__b").alias("__bits")), "filter")  # at most FILTER_WORDS rows
    place, bits = _word("__id", "__key"), _bits("__id", "__key")
    tested = marked.join(F.broadcast(held), place == F.col("__word"), "left").withColumn(
        "__hit", F.coalesce(F.col("__bits").bitwiseAND(bits) == bits, F.lit(False)))
    hits = tested.where("__hit")
    chance = stage(hits.select("__id", "__key").join(names, same, "left_anti").distinct().select(
        F.col("__id").alias("__gone_id"), F.col("__key").alias("__gone_key")), "chance")
    return tested.where("not __hit").select(*docs.columns).unionByName(
        hits.join(chance, same, "left_semi").select(*docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return _without(docs, quality.judge(docs).where("not kept"), quality.key())


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the classifier learns from the labelled ones among ``docs``."""
    return _without(docs, toxicity.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1"), _text_key())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id. Rows without an id are in no group."""
    found = stage(jaccard_join.jaccard_join(docs, NEAR), "found")
    rest = _without(docs, found.where("doc_id <> component_id"), _text_key())
    if not found.where("doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        return rest
    # Rows repeated under one id: the first by its other columns stays.
    first = Window.partitionBy("doc_id", "__key").orderBy(*[F.col(c) for c in docs.columns])
    named = rest.where("doc_id is not null").withColumn("__key", _text_key()).withColumn("__n", F.row_number().over(first))
    return named.where("__n = 1").drop("__key", "__n").unionByName(rest.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), _text_key())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a packed sequence."""
    return packing.pack(docs, packing.Packing(WORD_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL has no string kernel machine and no tokenizer; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
