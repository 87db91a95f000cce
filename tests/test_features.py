import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitpanel.contracts import ContractError, GateError, forbid_columns, require_columns
from pitpanel.operators import features, gates


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def panel(spark, labels, ticker="X", values=None):
    rows = [(ticker, day(91 * i), day(91 * i + 30), float((values or [1] * len(labels))[i]), 1.0,
             label) for i, label in enumerate(labels)]
    return spark.createDataFrame(
        rows, "ticker string, period_end date, prediction_date date, eps_diluted double, "
              "eps_year_ago_adjusted double, label_yoy int")


@pytest.mark.parametrize("labels,last", [
    ([1, 1, 0, 1, 1, 0], 2), ([1] * 9 + [0], 8), ([None, 1, 0], 1), ([0, 1], 0), ([1], 0),
])
def test_streak(spark, labels, last):
    out = features.with_streak(panel(spark, labels)).orderBy("period_end").collect()
    assert out[-1].growth_streak == last


def test_streak_equals_the_walk_back(spark):
    import random
    rng = random.Random(5)
    labels = [rng.choice([1, 1, 1, 0, None]) for _ in range(120)]
    out = features.with_streak(panel(spark, labels)).orderBy("period_end").collect()
    for i, row in enumerate(out):
        want = 0
        for j in range(i - 1, max(-1, i - 9), -1):
            if labels[j] != 1:
                break
            want += 1
        assert row.growth_streak == want


def test_lags_follow_decisions_not_periods(spark):
    rows = [("X", day(0), day(200), 1.0, 1.0, 1), ("X", day(91), day(120), 2.0, 1.0, 0),
            ("X", day(182), day(210), 3.0, 1.0, 1)]
    df = spark.createDataFrame(
        rows, "ticker string, period_end date, prediction_date date, eps_diluted double, "
              "eps_year_ago_adjusted double, label_yoy int")
    built = {r.period_end: r for r in features.build_features(df).collect()}
    assert built[day(0)].label_lag_1 == 0 and built[day(91)].label_lag_1 is None
    assert built[day(182)].label_lag_1 == 1
    assert gates.lag_leaks(features.build_features(df)).count() == 0


def test_leakage_gate_and_fire_test(spark):
    built = features.build_features(panel(spark, [1, 0, 1, None, 1, 1], values=range(6)))
    report = gates.fire_test(built)
    got = {r.injection: (r.injected, r.caught) for r in report.collect()}
    assert got == {"clean": (0, 0), "lag decided on the same day": (1, 1),
                   "lag decided later": (1, 1), "lag value without source row": (1, 1)}
    assert gates.fire_test_failures(report).count() == 0
    # A gate that checks nothing is found out.
    blind = gates.fire_test(built, lambda df: df.limit(0))
    assert gates.fire_test_failures(blind).count() == 3


def test_gates_raise_and_pass(spark):
    df = panel(spark, [1, 0, 1])
    gates.enforce(gates.duplicate_keys(df, ["ticker", "period_end"]), "keys")
    with pytest.raises(GateError, match="keys"):
        gates.enforce(gates.duplicate_keys(df.union(df), ["ticker", "period_end"]), "keys")
    assert gates.not_after(df, "period_end", "prediction_date").count() == 3
    assert gates.wrong_offset(df, "prediction_date", "period_end", 30).count() == 0
    assert gates.outside_window(df, str(day(1)), str(day(100))).count() == 2
    assert gates.beyond_boundary(df, str(day(500))).count() == 0
    assert gates.beyond_boundary(df, str(day(100))).count() == 1
    broken = df.withColumn("eps_diluted", F.lit(float("inf")))
    assert gates.infinite_values(broken, ["eps_diluted"]).count() == 3


def test_altered_rows(spark):
    df = panel(spark, [1, 0, None])
    keys, columns = ["ticker", "period_end"], ["eps_diluted", "label_yoy"]
    assert gates.altered_rows(df, df, keys, columns).count() == 0
    edited = df.withColumn("label_yoy", F.coalesce("label_yoy", F.lit(1)))
    shorter = edited.where(F.col("period_end") != F.lit(day(0)))
    problems = sorted(r.problem for r in gates.altered_rows(shorter, df, keys, columns).collect())
    assert problems == ["altered", "missing"]


def test_contracts_and_feature_lists(spark):
    df = panel(spark, [1])
    with pytest.raises(ContractError):
        require_columns(df, ["nothing"])
    with pytest.raises(ContractError):
        forbid_columns(df, ["label_yoy"])
    assert gates.unclean_features(features.MODEL_FEATURES, features.TARGET_IDENTITIES,
                                  "label_yoy") == []
    assert len(gates.unclean_features(["label_yoy", "eps_growth_yoy", "a", "a"],
                                      features.TARGET_IDENTITIES, "label_yoy")) == 3


def test_fingerprint_ignores_order(spark):
    df = panel(spark, [1, 0, 1, 0])
    same = gates.fingerprint_change(gates.fingerprint(df),
                                    gates.fingerprint(df.repartition(3).orderBy("label_yoy")))
    assert same.count() == 0
    edited = df.withColumn("eps_diluted", F.col("eps_diluted") + 1)
    assert gates.fingerprint_change(gates.fingerprint(df), gates.fingerprint(edited)).count() == 1
