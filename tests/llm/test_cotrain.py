"""Held-out accuracy, and labels that allow no fit."""

import os

import pytest
from pyspark.sql import functions as F

from pitpanel.llm import cotrain

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    hidden = F.pmod(F.xxhash64(F.lit("test"), "doc_id"), F.lit(3)) == 0
    scored = cotrain.score(docs, labels.filter(~hidden))
    assert scored.count() == docs.count()
    held = scored.join(labels.filter(hidden), scored["key"] == labels["doc_id"]).collect()
    good = [r for r in held if r.quality == 1]
    bad = [r for r in held if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert all(0 <= r.score <= 1 for r in held)


def test_messy_rows(messy, nothing, spark):
    labels = spark.createDataFrame(
        [(0, 1), (0, 1), (1, 1), (2, 0), (None, 0), (3, None), (999, 1)],
        "doc_id long, quality int")
    scored = cotrain.score(messy, labels)
    assert scored.count() == messy.count()
    assert scored.filter("score IS NULL OR isnan(score)").count() == 0
    none = labels.limit(0)
    flat = cotrain.score(messy, none)
    assert flat.filter("score IS NULL AND kept").count() == messy.count()
    ones = cotrain.score(messy, labels.filter("quality = 1")).select("score").distinct().collect()
    assert [r.score for r in ones] == [1.0]
    assert cotrain.score(nothing, labels).count() == 0
