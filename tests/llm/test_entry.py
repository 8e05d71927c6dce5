import __spark_entry__ as entry
import corpus_pipeline
import pytest

from veilscope.llm import registry

DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    found = entry.queries()
    assert set(registry.QUERIES) <= set(found) and "pipeline" in found
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR).collect()
    assert out and {r["doc_id"] for r in out} < {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_take_empty_tables(spark, name, stage):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = stage(spark, docs.limit(0), DIR)
    assert out.columns == docs.columns and out.count() == 0
