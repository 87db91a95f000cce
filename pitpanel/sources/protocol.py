"""The declared evaluation protocol: features, parameters, folds, counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from pitpanel.contracts import ContractError


def parse_protocol(text: str, revision: int | None = None) -> dict:
    """The protocol document; a different revision is refused."""
    protocol = json.loads(text)
    if revision is not None and protocol.get("revision") != revision:
        raise ContractError(
            f"protocol revision is {protocol.get('revision')}, expected {revision}")
    return protocol


def read_protocol(spark: SparkSession, path: str, revision: int | None = None) -> dict:
    """Read through Spark, so any file system the cluster sees will do."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return parse_protocol(rows[0][0], revision)


def declared_folds(spark: SparkSession, protocol: dict) -> DataFrame:
    """One row per declared fold with its row counts."""
    folds = protocol["evaluation_protocol"]["folds"]
    rows = [(int(f["fold"]), int(f["n_predict_rows"]), int(f["n_predict_rows_labelled"]))
            for f in folds]
    return spark.createDataFrame(
        rows, "fold int, n_predict_rows long, n_predict_rows_labelled long")
