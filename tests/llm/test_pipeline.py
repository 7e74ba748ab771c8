"""The registered queries and the pipeline on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coffer.llm import decontaminate, pii, simhash
from coffer.llm.queries import QUERIES


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "personal_data", "tokens"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    source = {"op3_embeddings": "embeddings", "op9_html": "pages"}.get(name, "documents")
    if name == "op13_search":
        assert out.groupBy("item_id").count().where("count > 10").count() == 0
    elif name == "op11_packing":
        assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").select(
            "doc_id").distinct().count()
    elif name != "op8_passages":
        assert out.count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
    else:
        assert out.where("other_id >= doc_id").count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, sf_dir)
        assert out.columns == columns, name
        rows = spark.createDataFrame(out.collect(), out.schema)
        assert rows.count() <= left.count()
        left = rows
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contamination(left, bench).where("n_hit > 0").count() == 0
    texts = [r["text"] for r in left.collect()]
    before = {e[:2] for r in docs.collect() for e in pii.find_entities(r["text"])}
    assert not before & {e[:2] for t in texts for e in pii.find_entities(t)}
    final = corpus_pipeline.run(spark, sf_dir)
    rows = final.collect()
    assert sorted(r["text"] for r in rows) == sorted(texts)
    assert all(len(np.frombuffer(r["token_ids"], "<u4")) == r["n_tokens"] for r in rows)
    assert set(columns) < set(final.columns)
    classes = simhash.simhash_classes(docs).groupBy("component_id").count().where(F.col("count") > 1)
    assert classes.count() > 0
