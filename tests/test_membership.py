import datetime as dt
import random

import pytest

from pitpanel.functions.dates import weekdays_between
from pitpanel.operators import asof, membership, profile, spans
from pyspark.sql import functions as F

D = dt.date
HORIZON = D(2026, 12, 31)


def day(n):
    return D(2020, 1, 1) + dt.timedelta(days=n)


def state_machine(events, window_start):
    """Plain model of the membership rules for one entity."""
    events = sorted(set(events))
    stints, opened = [], None
    if events and events[0][1] == "remove":
        opened = min(window_start, events[0][0])
    for at, kind in events:
        if kind == "add" and opened is None:
            opened = at
        elif kind == "remove" and opened is not None:
            stints.append((opened, at))
            opened = None
    if opened is not None:
        stints.append((opened, HORIZON))
    return stints


def build(spark, log, window_start, current=None):
    events = spark.createDataFrame(log, "ticker string, date date, kind string")
    rows = membership.membership_intervals(events, str(window_start), str(HORIZON),
                                           current=current).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.start):
        out.setdefault(r.ticker, []).append((r.start, r.end))
    return out


@pytest.mark.parametrize("events,window,expected", [
    ([(1, "add"), (5, "remove"), (9, "add")], 3, [(day(1), day(5)), (day(9), HORIZON)]),
    ([(5, "remove")], 3, [(day(3), day(5))]),
    ([(5, "remove")], 7, [(day(5), day(5))]),
    ([(1, "add"), (2, "add"), (5, "remove"), (6, "remove")], 3, [(day(1), day(5))]),
])
def test_intervals(spark, events, window, expected):
    log = [("X", day(d), kind) for d, kind in events]
    assert build(spark, log, day(window)) == {"X": expected}


def test_intervals_equal_the_state_machine(spark):
    rng = random.Random(3)
    log = [(f"t{rng.randrange(120)}", day(rng.randrange(30)), rng.choice(["add", "remove"]))
           for _ in range(900)]
    # One entity holds a third of the log.
    log += [("hot", day(rng.randrange(300)), rng.choice(["add", "remove"])) for _ in range(450)]
    want = {}
    for ticker in {row[0] for row in log}:
        want[ticker] = state_machine([row[1:] for row in log if row[0] == ticker], day(10))
    assert build(spark, log, day(10)) == want


def test_current_members_without_events(spark):
    current = spark.createDataFrame([("A", day(0)), ("B", day(20)), ("C", None)],
                                    "ticker string, date_added date")
    got = build(spark, [("Z", day(1), "add")], day(10), current)
    assert got["A"] == [(day(10), HORIZON)] and got["B"] == [(day(20), HORIZON)]
    assert got["C"] == [(day(10), HORIZON)]


def test_gate_bounds_and_overlaps(spark):
    intervals = spark.createDataFrame(
        [("X", day(5), day(10)), ("X", day(6), day(7)), ("X", day(20), None), ("Y", None, day(3))],
        "ticker string, start date, end date")
    cases = [("X", 4, False), ("X", 5, True), ("X", 8, True), ("X", 10, True), ("X", 11, False),
             ("X", 25, True), ("Y", 0, True), ("Y", 4, False), ("Z", 5, False)]
    rows = spark.createDataFrame([(t, day(d), want) for t, d, want in cases] + [("X", None, False)],
                                 "ticker string, prediction_date date, want boolean")
    flagged = asof.covered_at(rows, intervals).collect()
    assert len(flagged) == 10
    assert all(r.in_index_at_prediction == r.want for r in flagged)


def test_span_conflicts(spark):
    rows = [("ok", None, day(30)), ("ok", day(31), None), ("bad", None, day(31)),
            ("bad", day(31), None), ("inv", day(5), day(4))]
    df = spark.createDataFrame(rows, "ticker string, valid_from date, valid_to date")
    assert sorted((r.ticker, r.problem) for r in spans.span_conflicts(df).collect()) == [
        ("bad", "overlap"), ("inv", "inverted")]


def test_clusters_and_sessions(spark):
    lags = spark.createDataFrame([(v,) for v in (30, 35, 41, 390, 400, 30)], "lag int")
    got = sorted(tuple(r) for r in profile.cluster_values(lags, "lag", 20)
                 .select("low", "high", "n", "kind").collect())
    assert got == [(30, 41, 4, "original"), (390, 400, 2, "restated/comparative")]
    # Runs that cross slices of the value range, and slices of single values.
    rng = random.Random(12)
    values = [rng.choice([rng.randint(-400, 400), rng.randint(0, 9) * 5000 + rng.randint(0, 60),
                          0]) for _ in range(500)]
    wide = spark.createDataFrame([(v,) for v in values], "lag int")
    clusters, before = [], None
    for v in sorted(values):
        if before is None or v - before > 20:
            clusters.append([v, v, 0])
        clusters[-1][1], clusters[-1][2], before = v, clusters[-1][2] + 1, v
    got = profile.cluster_values(wide, "lag", 20).orderBy("cluster").collect()
    assert [[r.low, r.high, r.n] for r in got] == clusters
    assert [r.cluster for r in got] == list(range(len(clusters)))
    assert profile.cluster_values(wide.limit(0), "lag", 20).count() == 0
    friday = D(2024, 1, 5)
    days = spark.createDataFrame([(friday,), (D(2024, 1, 8),), (D(2024, 1, 18),), (friday,)],
                                 "day date")
    assert [(r.gap_start, r.business_days) for r in profile.session_gaps(days, "day").collect()] \
        == [(D(2024, 1, 8), 8)]


def test_weekday_count(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        start = day(rng.randrange(2000))
        end = start + dt.timedelta(days=rng.randrange(60))
        want = sum((start + dt.timedelta(days=i)).weekday() < 5 for i in range((end - start).days))
        rows.append((start, end, want))
    df = spark.createDataFrame(rows, "a date, b date, want int")
    assert df.where(weekdays_between(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_thin_entities_use_the_upper_median(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30), ("d", 40)],
                                   "ticker string, n_periods int")
    got = profile.thin_entities(counts).collect()
    assert [(r.ticker, r.median_count) for r in got] == [("a", 30)]


def test_recent_step_truncates(spark):
    rows = [("X", day(n), day(n + 30)) for n in (0, 91, 183)] + [("Y", day(0), day(30))]
    df = spark.createDataFrame(rows, "ticker string, period_end date, prediction_date date")
    assert {r.ticker: r.quarter_gap_days for r in profile.recent_step(df).collect()} \
        == {"X": 91, "Y": 91}


def test_log_years_report_missing(spark):
    log = spark.createDataFrame([(D(2011, 5, 1),), (D(2013, 5, 1),)], "date date")
    rows = membership.log_years(log, "2011-01-01", "2013-12-31").orderBy("year").collect()
    assert [(r.year, r.n_changes, r.missing) for r in rows] == [
        (2011, 1, False), (2012, 0, True), (2013, 1, False)]


def test_lag_clusters_equal_their_sql_on_odd_quantities(spark, tmp_path):
    """Half and inexact lags are rounded, rows without one belong to the last cluster."""
    duckdb = pytest.importorskip("duckdb")
    from pitpanel.catalog.membership import catalog

    rows = [(1, 1, 17.29), (1, 1, 18.26), (1, 2, None), (1, 1, 0.575), (2, None, 3.0),
            (2, 2, None), (3, 1, 0.005), (3, 1, 0.015), (3, 1, 0.985), (3, 1, 0.995),
            (None, 1, 5.0), (None, 1, None)]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.oracles["lag_clusters"]).fetchall()
    got = catalog.queries["lag_clusters"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
