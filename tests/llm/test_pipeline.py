"""The stages over the smallest tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitpanel.llm import bpe, simhash
from pitpanel.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    rules, apart = seen["quality_rules"], seen["simhash_dedup"]
    assert 0 < apart.count() < rules.count() < spark.read.parquet(
        f"{SF}/documents.parquet").count()
    again = simhash.near_components(apart).select("component").distinct().count()
    assert again == apart.count()
    clean = seen["personal_data"]
    assert clean.count() == apart.count()
    assert clean.filter(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    mixed = seen["source_mix"].collect()
    with open(vocabulary_path(), encoding="utf-8") as file:
        codec = bpe.Codec(file.read())
    last = docs.collect()
    assert sorted(codec.decode(r.ids) for r in last) == sorted(r.text for r in mixed)
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens for r in last)


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0
