"""The pipeline's stages against the operators' own decisions, and the registered queries' SQL."""

import glob
import os

import duckdb
import pytest
from llm.conftest import SMALL

import __spark_entry__ as entry
import corpus_pipeline
from caseloom.llm import mixing, pii, queries, simhash, toxicity
from tools.check_queries import compare


def test_stages(spark, documents):
    docs, own = documents, documents.columns
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == own
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = {r.doc_id for r in toxicity.classify(documents, labels).where("predicted = 0").collect()}
    assert set(ids[0]) == clean
    left = documents.where(documents.doc_id.isin(list(clean)))
    assert set(ids[1]) == {r.component_id for r in simhash.near_duplicates(left).collect()}
    assert sorted(ids[1]) == sorted(ids[2]) == sorted(ids[3])
    assert not any(pii.find(r.text) and pii.find(r.text) == pii.find(before) for r, before in zip(
        docs.orderBy("doc_id").collect(), [r.text for r in documents.where(documents.doc_id.isin(ids[3])).orderBy("doc_id").collect()]))
    order = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    assert ids[3] == order
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == set(order)


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_odd_table(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    base = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        base.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    assert compare(queries.queries()[name](spark, SMALL), base.sql(queries.oracle_sql()[name])).startswith("ok")


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {k.split("_")[0] for k in entry.queries() if k.startswith("op") or k == "pipeline"}
