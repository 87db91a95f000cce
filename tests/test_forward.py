import datetime as dt

import pytest

from pitpanel.contracts import GateError
from pitpanel.operators import forward, gates
from tests.test_features import day


def resolve(spark, quarters, scored_at):
    predictions = spark.createDataFrame(
        [(t, day(100), 0.7, 1) for t in ("S", "N", "L", "M", "O")],
        "ticker string, expected_period_end date, predicted_probability double, "
        "predicted_label int")
    rows = spark.createDataFrame(
        quarters, "ticker string, period_end date, filed_date date, prediction_date date, "
                  "eps_diluted double, label_yoy int")
    return forward.resolve_outcomes(predictions, rows, str(day(50)), str(scored_at))


QUARTERS = [
    ("S", day(10), day(20), day(21), 1.0, 0),      # before the cut: not an outcome
    ("S", day(100), day(130), day(131), 2.0, 1), ("S", day(190), day(230), day(231), 3.0, 0),
    ("N", day(100), day(130), day(131), 2.0, None), ("N", day(190), day(200), day(201), 2.0, 1),
    ("L", day(100), day(220), day(221), 2.0, 1),
]


def test_statuses_do_not_borrow_rows(spark):
    early = {r.ticker: r for r in resolve(spark, QUARTERS, day(150)).collect()}
    assert {t: r.status for t, r in early.items()} == {
        "S": "scored", "N": "excluded_no_label", "L": "excluded_late_filing",
        "M": "outstanding", "O": "outstanding"}
    assert early["S"].actual_label == 1 and early["N"].actual_label is None
    late = {r.ticker: r.status for r in resolve(spark, QUARTERS, day(221)).collect()}
    assert late["M"] == "excluded_no_filing" and late["L"] == "excluded_late_filing"
    with pytest.raises(GateError):
        gates.enforce(gates.outstanding_rows(resolve(spark, QUARTERS, day(150))), "waiting")


def test_scores_and_reasons(spark):
    resolved = resolve(spark, QUARTERS, day(400))
    row = forward.score_resolved(resolved, 0.6).collect()[0]
    assert (row.n_predicted, row.n_scored, row.n_excluded_no_filing, row.n_outstanding) \
        == (5, 1, 2, 0)
    assert row.passes_log_loss and not row.passes_accuracy
    reasons = {r.ticker: (r.correct, r.excluded_reason)
               for r in forward.explain_resolution(resolved).collect()}
    assert reasons["S"] == (True, "") and reasons["L"][1].startswith("filed after")
    nothing = forward.score_resolved(resolve(spark, QUARTERS[:1], day(400)), 0.6).collect()[0]
    assert nothing.n_scored == 0 and nothing.log_loss is None


def test_recording_must_precede_filings(spark):
    resolved = resolve(spark, QUARTERS, day(400))
    filed = day(130)
    same_day = gates.recorded_too_late(resolved, f"{filed} 00:10:00")
    assert sorted(r.ticker for r in same_day.collect()) == ["N", "S"]
    before = gates.recorded_too_late(resolved, f"{filed - dt.timedelta(days=1)} 23:59:00")
    assert before.count() == 0


def test_pending_rows_and_reasons(spark):
    rows = [("A", day(91 * i), day(91 * i + 30)) for i in range(5)]
    rows += [("T", day(91 * i), day(91 * i + 30)) for i in range(3)]
    rows += [("Q", day(91 * i - 900), day(91 * i - 870)) for i in range(5)]
    history = spark.createDataFrame(rows, "ticker string, period_end date, prediction_date date")
    members = spark.createDataFrame([("A",), ("T",), ("Q",), ("Z",)], "ticker string")
    pending, skipped = forward.pending_rows(history, members, str(day(430)))
    row = pending.collect()[0]
    assert (row.ticker, row.period_end, row.prediction_date) == ("A", day(455), day(431))
    assert {r.ticker: r.reason for r in skipped.collect()} == {
        "T": "fewer than 4 rows", "Q": "silent more than 220 days", "Z": "no history"}
    coverage = forward.pending_coverage(pending, skipped)
    assert gates.below_floor(coverage, "n_pending", "n_eligible", 0.5).count() == 1
    assert gates.below_floor(coverage, "n_pending", "n_eligible", 0.3).count() == 0


def test_training_summary_of_a_committed_run_needs_no_features(spark, monkeypatch):
    from pitpanel.catalog import forward as queries

    seen = []
    rows = queries.plan.training_rows
    monkeypatch.setattr(queries.plan, "training_rows",
                        lambda df, cut: seen.append(df.columns) or rows(df, cut))
    _, provenance = queries._committed(spark, "/root/testdata/sf0.001")
    assert int(provenance["training_rows_labelled"]) > 0
    assert any("growth_streak" not in columns for columns in seen)
