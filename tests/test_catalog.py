"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, normal

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.001"

# One query per family; tools/check_queries.py runs all of them.
SAMPLE = (
    "first_known_per_column", "asof_nearest_with_tolerance", "labelled_panel",
    "leakage_safe_features", "best_threshold", "membership_gate_flag", "restatement_anomalies",
    "candidate_by_overlap", "nested_fact_ingest", "decile_calibration_with_ties",
    "forward_score",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(SAMPLE) <= set(oracles)


def test_flagship_query(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.n_leaks == 0 and 0 <= r.beat_rate <= 1 for r in rows if r.n_labelled)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    left, right = normal(got), normal(want)
    assert len(left) == len(right) and left.equals(right)
