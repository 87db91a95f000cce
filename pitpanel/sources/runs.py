"""Committed runs: a table and its provenance, written once per run name.

A run is an attempt folder with data and provenance, and a marker that names the attempt.
The marker is written last, so a run that failed half way is no run: readers follow the
marker, and another attempt may commit. A name that has a marker is taken for good.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.contracts import ContractError
from pitpanel.operators.gates import enforce, fingerprint, fingerprint_change
from pitpanel.sources.tables import PROVENANCE_KEYS, missing_provenance, write_table

MARKER = "committed"


class RunTaken(ContractError):
    """The run name has been committed before."""


def _marker(spark: SparkSession, root: str, name: str) -> str | None:
    try:
        rows = spark.read.schema("attempt string").parquet(f"{root}/{name}/{MARKER}").take(1)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows[0].attempt if rows else None


def refuse_taken(spark: SparkSession, root: str, name: str) -> None:
    """Raise when the run has been committed: there is one output per name."""
    if _marker(spark, root, name) is not None:
        raise RunTaken(f"run {name!r} under {root} has been committed; it is never replaced")


def digest_text(df: DataFrame) -> str:
    """A table's order-free digest as one word."""
    row = fingerprint(df).first()
    return f"{row['n_rows']}-{row['hash_sum']}"


def as_rows(spark: SparkSession, provenance: dict[str, str]) -> DataFrame:
    """(key, value) rows of a provenance."""
    return spark.createDataFrame(
        [(k, str(v)) for k, v in provenance.items()],
        T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


def commit_run(df: DataFrame, provenance: dict[str, str], root: str, name: str, *,
               required: Sequence[str] = PROVENANCE_KEYS,
               inputs: dict[str, tuple[DataFrame, str]] | None = None) -> str:
    """Write data and provenance, verify both, then mark them; returns the attempt.

    ``inputs`` maps a name to an input table and the digest it had when the run
    began; the run isn't marked if one has changed since.
    """
    spark = df.sparkSession
    refuse_taken(spark, root, name)
    header = as_rows(spark, provenance)
    enforce(missing_provenance(header, required), f"provenance of run {name}")
    attempt = f"{root}/{name}/attempt-{uuid.uuid4().hex}"
    write_table(df, f"{attempt}/data")
    write_table(header.coalesce(1), f"{attempt}/provenance")
    written = spark.read.schema(df.schema).parquet(f"{attempt}/data")
    enforce(fingerprint_change(fingerprint(df), fingerprint(written)), f"data of run {name}")
    for label, (table, before) in (inputs or {}).items():
        now = digest_text(table)
        if now != before:
            raise ContractError(f"{label} changed during run {name!r}: {before}, now {now}")
    marker = spark.createDataFrame([(attempt,)], "attempt string").coalesce(1)
    try:
        write_table(marker, f"{root}/{name}/{MARKER}")
    except AnalysisException as error:
        raise RunTaken(f"run {name!r} under {root} was committed meanwhile") from error
    return attempt


def load_run(spark: SparkSession, root: str, name: str,
             required: Sequence[str] = PROVENANCE_KEYS) -> tuple[DataFrame, dict[str, str]]:
    """(data, provenance) of a committed run; a lacking key is refused."""
    attempt = _marker(spark, root, name)
    if attempt is None:
        raise ContractError(f"no committed run {name!r} under {root}")
    header = spark.read.schema("key string, value string").parquet(f"{attempt}/provenance")
    enforce(missing_provenance(header, required), f"provenance of run {name}")
    return spark.read.parquet(f"{attempt}/data"), {r.key: r.value for r in header.collect()}


def check_unmoved(provenance: dict[str, str], current: dict[str, str]) -> None:
    """Refuse when what the run was made from is no longer what it was."""
    moved = {k: (provenance.get(k), str(v)) for k, v in current.items()
             if provenance.get(k) != str(v)}
    if moved:
        raise ContractError("changed since the run was made: " + "; ".join(
            f"{k} was {a!r}, is {b!r}" for k, (a, b) in sorted(moved.items())))
