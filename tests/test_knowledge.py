import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import asof, knowledge, restatements

D = dt.date
FACTS = "ticker string, period_end date, filed_date date, eps_diluted double, accn string, fp string"


def facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def test_first_filing_wins_and_is_counted(spark):
    df = facts(spark, [("X", D(2020, 3, 31), D(2021, 4, 22), 1.0, "b", "Q1"),
                       ("X", D(2020, 3, 31), D(2020, 4, 20), 4.0, "a", None),
                       ("X", D(2020, 3, 31), None, 9.0, "c", "Q9")])
    row = knowledge.first_known(df).collect()[0]
    assert (row.eps_diluted, row.filed_date, row.n_filings_seen) == (4.0, D(2020, 4, 20), 3)
    assert row.fp is None
    by_column = knowledge.first_known(df, mode="column").collect()[0]
    assert by_column.fp == "Q1" and by_column.eps_diluted == 4.0


def test_duration_and_lag_bounds(spark, day):
    spans = spark.createDataFrame(
        [(day(0), day(n)) for n in (59, 60, 110, 111)] + [(None, day(90))],
        "start date, end date")
    kept = knowledge.quarterly_facts(spans).select(F.datediff("end", "start")).collect()
    assert sorted(r[0] for r in kept) == [60, 110]
    lags = spark.createDataFrame([(120,), (121,), (None,)], "filing_lag_days int")
    kept, rejected = knowledge.split_by_lag(lags)
    assert sorted([r[0] for r in kept.collect()], key=str) == [120, None]
    assert [r.reason for r in rejected.collect()] == ["filing_lag_days > 120"]


def test_label_and_growth_edges(spark):
    rows = [(2.0, 2.0, False), (3.0, 2.0, False), (3.0, None, False), (3.0, 2.0, True),
            (None, 2.0, False), (2.0, -1.0, False), (2.0, 0.0, False)]
    df = spark.createDataFrame(
        rows, "eps_diluted double, eps_year_ago_adjusted double, split_ambiguous boolean")
    out = knowledge.with_label(df).withColumn(
        "g", knowledge.growth("eps_diluted", "eps_year_ago_adjusted")).collect()
    assert [r.label_yoy for r in out] == [0, 1, None, None, None, 1, 1]
    assert [r.g for r in out][5:] == [3.0, None]


@pytest.mark.parametrize("target,right,tolerance,expected", [
    (10, [(8, "a"), (12, "b")], 5, "a"),
    (10, [(8, "a")], 2, "a"),
    (10, [(8, "a")], 1, None),
    (10, [(8, "a"), (8, "b")], 5, "b"),
])
def test_asof_rules(spark, day, target, right, tolerance, expected):
    left = spark.createDataFrame([("k", day(target))], "k string, at date")
    candidates = spark.createDataFrame([("k", day(d), v) for d, v in right],
                                       "k string, seen date, v string")
    for unique in (True, False):
        out = asof.asof_match(left, candidates, by=["k"], left_on="at", right_on="seen",
                              payload=["v"], tolerance_days=tolerance, left_unique=unique)
        assert [r.v for r in out.collect()] == [expected]


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
def test_asof_equals_pandas_with_a_hot_key(spark, direction):
    rng = random.Random(7)
    base = pd.Timestamp("2020-01-01")
    keys = ["hot"] * 200 + [f"k{i % 20}" for i in range(300)]
    left = pd.DataFrame({"k": keys, "id": range(500)})
    left["at"] = [base + pd.Timedelta(days=rng.randrange(400)) for _ in keys]
    right = pd.DataFrame({"k": [rng.choice(keys) for _ in range(300)]})
    right["seen"] = [base + pd.Timedelta(days=rng.randrange(400)) for _ in range(300)]
    right["v"] = range(300)
    right = right.sort_values(["seen", "v"])
    want = pd.merge_asof(left.sort_values("at"), right, left_on="at", right_on="seen", by="k",
                         direction=direction, tolerance=pd.Timedelta(days=9))
    got = asof.asof_match(
        spark.createDataFrame(left.assign(at=left["at"].dt.date)),
        spark.createDataFrame(right.assign(seen=right["seen"].dt.date)), by=["k"], left_on="at",
        right_on="seen", payload=["v"], tolerance_days=9, direction=direction).toPandas()
    want_by_id = {r.id: None if pd.isna(r.seen) else r.seen.date() for r in want.itertuples()}
    assert len(got) == 500
    assert {r.id: r.seen for r in got.itertuples()} == want_by_id


def test_window_trim_follows_the_match(spark):
    df = facts(spark, [("X", D(2019, 3, 31), D(2019, 4, 20), 1.0, "a", "Q1"),
                       ("X", D(2020, 3, 31), D(2020, 4, 20), 2.0, "b", "Q1")])
    inside, before, _ = knowledge.split_by_window(asof.year_ago_match(df), "2020-01-01")
    assert [r.eps_year_ago for r in inside.collect()] == [1.0]
    assert before.count() == 1


def unit_events(spark, rows):
    df = facts(spark, [(t, p, f, v, str(i), "Q") for i, (t, p, f, v) in enumerate(rows)])
    return [tuple(r) for r in restatements.detect_unit_changes(df).collect()]


def test_unit_change_detection(spark):
    p, q, d = D(2020, 3, 31), D(2020, 6, 30), D
    assert unit_events(spark, [("X", p, d(2020, 4, 20), 8.0), ("X", p, d(2021, 4, 20), 2.0)]) \
        == [("X", 4, d(2020, 4, 20), d(2021, 4, 20), True)]
    assert unit_events(spark, [("X", p, d(2020, 4, 20), 8.0), ("X", p, d(2021, 4, 20), 3.0)]) == []
    crossed = unit_events(spark, [
        ("X", p, d(2020, 4, 20), 8.0), ("X", p, d(2020, 6, 1), 4.0),
        ("X", q, d(2020, 7, 20), 6.0), ("X", q, d(2021, 7, 20), 3.0)])
    assert crossed == [("X", 2, d(2020, 7, 20), d(2020, 6, 1), False)]


@pytest.mark.parametrize("then,now,factors,expected", [
    (1, 20, [4], (4, False)), (1, 5, [4], (1, False)), (15, 20, [4], (1, False)),
    (1, 8, [4], (1, True)), (1, 20, [2, 3], (6, False)),
])
def test_unit_change_adjustment(spark, day, then, now, factors, expected):
    panel = spark.createDataFrame(
        [("X", day(0), day(now), day(-365), day(then), 12.0)],
        "ticker string, period_end date, filed_date date, period_end_year_ago date, "
        "filed_date_year_ago date, eps_year_ago double")
    events = spark.createDataFrame(
        [("X", f, day(5), day(10), True) for f in factors],
        "ticker string, factor long, window_start date, window_end date, established boolean")
    row = restatements.adjust_year_ago(panel, events).collect()[0]
    assert (row.split_factor_applied, row.split_ambiguous) == expected
    assert row.eps_year_ago_adjusted == 12.0 / expected[0]
    unestablished = events.withColumn("established", F.lit(False))
    assert restatements.adjust_year_ago(panel, unestablished).collect()[0].split_ambiguous


def test_nan_is_missing_on_either_side(spark):
    nan = float("nan")
    rows = spark.createDataFrame(
        [(0, nan, 2.0), (1, 3.0, nan), (2, 3.0, 2.0), (3, None, 2.0)],
        "id int, eps_diluted double, eps_year_ago_adjusted double")
    got = knowledge.with_label(rows, ambiguous=None).withColumn(
        "growth", knowledge.growth("eps_diluted", "eps_year_ago_adjusted")).orderBy("id").collect()
    assert [r.label_yoy for r in got] == [None, None, 1, None]
    assert [r.growth for r in got] == [None, None, 0.5, None]
