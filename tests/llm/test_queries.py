"""The registered queries against SQL, and the pipeline against its operators' own verdicts."""

import corpus_pipeline
import pytest
from conftest import SF
from llm.conftest import ODD, frame
from oracle import compare, connect

from veilwright.llm import decontamination, jaccard_join, quality, toxicity
from veilwright.llm.common import table
from veilwright.llm.queries import JOBS, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert compare(JOBS[name](spark, SF), connect(SF), SQL[name]) == ""


def test_stages_keep_columns_and_rows(spark):
    docs = table(spark, SF, "documents")
    for (_, step), gone in zip(corpus_pipeline.STAGES[:4], (
            lambda d: quality.judge(d).where("not kept"),
            lambda d: toxicity.classify(d, table(spark, SF, "labels")).where("predicted = 1"),
            lambda d: jaccard_join.jaccard_join(d, corpus_pipeline.NEAR).where("doc_id <> component_id"),
            lambda d: decontamination.scan(d, table(spark, SF, "benchmark")).where("contaminated")), strict=True):
        kept = step(spark, docs, SF)
        assert kept.columns == docs.columns
        out = {r.doc_id for r in gone(docs).select("doc_id").collect()}
        assert {r.doc_id for r in kept.select("doc_id").collect()} == {
            r.doc_id for r in docs.select("doc_id").collect()} - out
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_odd_rows(spark, odd, none):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, SF).count() == 0
        step(spark, odd, SF).count()
    rest = [r for r in corpus_pipeline.near_duplicates(spark, odd, SF).collect()]
    assert sorted(r.doc_id for r in rest if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 10, 11, 11, 12, 13]
    assert sum(r.doc_id is None for r in rest) == 2 and len(frame(spark, ODD).columns) == len(rest[0])


def test_names():
    assert len([n for n in JOBS if n.startswith("op")]) == 13 and "pipeline" in JOBS
