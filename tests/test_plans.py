"""End-to-end compositions on small made-up companies."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitpanel.contracts import ContractError, GateError
from pitpanel.functions.names import normalise_name
from pitpanel.operators.membership import membership_intervals, membership_metadata
from pitpanel.operators.features import MODEL_FEATURES
from pitpanel.plans import census, forward, panel
from pitpanel.sources import runs

D = dt.date
FACTS = ("ticker string, cik string, period_end date, filed_date date, eps_diluted double, "
         "accn string, filing_lag_days int")


def quarter_ends(first, last):
    return [D(y, m, d) for y in range(first, last + 1)
            for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]


@pytest.fixture(scope="module")
def facts(spark):
    """Forty companies, nine years; one restates four-for-one in 2018."""
    rng = random.Random(21)
    rows = []
    for i in range(40):
        ticker, level = f"T{i:02d}", 10.0 + i
        for end in quarter_ends(2012, 2020):
            level *= 1 + rng.gauss(0.01, 0.08)
            shown = level / 4 if (i == 0 and end >= D(2018, 6, 30)) else level
            filed = end + dt.timedelta(days=30 + rng.randrange(20))
            rows.append((ticker, f"{i:010d}", end, filed, round(shown, 4), f"{end}-a",
                         (filed - end).days))
            if i == 0 and D(2017, 6, 30) <= end < D(2018, 6, 30):
                later = filed + dt.timedelta(days=365)
                rows.append((ticker, f"{i:010d}", end, later, round(level / 4, 4), f"{end}-b",
                             (later - end).days))
    return spark.createDataFrame(rows, FACTS).cache()


@pytest.fixture(scope="module")
def intervals(spark):
    log = [(f"T{i:02d}", D(2012, 1, 1), "add") for i in range(40)]
    log += [("T01", D(2016, 7, 1), "remove"), ("T02", D(2015, 1, 1), "remove"),
            ("T02", D(2017, 1, 1), "add")]
    events = spark.createDataFrame(log, "ticker string, date date, kind string")
    stints = membership_intervals(events, "2012-01-01", "2026-12-31")
    return stints, membership_metadata(stints, events)


def test_panel_is_gated_adjusted_and_verified(facts, intervals):
    stints, metadata = intervals
    built = panel.build_panel(facts, "2013-01-01", "2019-12-31", intervals=stints,
                              metadata=metadata)
    panel.verify_panel(built.panel, "2013-01-01", "2019-12-31")
    rows = built.panel.collect()
    assert {r.ticker for r in rows if r.is_removed_name} == {"T01", "T02"}
    assert max(r.period_end for r in rows if r.ticker == "T01") < D(2016, 7, 1)
    event = built.events.collect()[0]
    assert (event.ticker, event.factor, event.established) == ("T00", 4, True)
    adjusted = [r for r in rows if r.split_factor_applied == 4]
    assert adjusted and all(r.ticker == "T00" and r.period_end >= D(2018, 6, 30)
                            for r in adjusted)
    reasons = {r.reason for r in built.rejected.select("reason").distinct().collect()}
    assert "not_in_index_at_prediction_date" in reasons and "after_study_window" in reasons
    with pytest.raises(GateError):
        panel.verify_panel(built.panel, "2014-01-01", "2019-12-31")


def test_forward_run_and_scoring(spark, facts, intervals):
    stints, _ = intervals
    cut = "2020-06-10"
    known = facts.where(F.col("filed_date") < F.lit(cut).cast("date"))
    history = panel.build_panel(known, "2013-01-01", "2019-12-31", intervals=stints).panel
    predictions = forward.run_forward(known, history, stints, cut, "2013-01-01").cache()
    rows = predictions.collect()
    assert len(rows) == 39 and all(0 < r.predicted_probability < 1 for r in rows)
    assert {r.expected_period_end for r in rows} <= {
        D(2020, 6, 30), D(2020, 6, 29), D(2020, 7, 1)}
    # Seeing a later filing makes the outcome resolvable, and the run refuses.
    with pytest.raises(GateError, match="resolvable"):
        forward.run_forward(facts, history, stints, cut, "2013-01-01")
    resolved, scores = forward.score_forward(
        predictions, facts, history, cut, scored_at="2021-06-01",
        recorded_at="2020-06-11 09:00:00", study_start="2013-01-01", training_rate=0.55)
    row = scores.collect()[0]
    assert row.n_predicted == 39 and row.n_scored == 39 and row.n_outstanding == 0
    assert resolved.where("correct").count() == round(row.accuracy * 39)


PROTOCOL = {"revision": 3, "model": {
    "variant_name": "logistic_rank", "decision_threshold": 0.5,
    "estimator": {"params": {"C": 1.0}}}}
CODE = {"code_sha": "abc", "working_tree_clean": "yes"}


def test_forward_output_is_committed_once_and_scored(spark, facts, intervals, tmp_path,
                                                     monkeypatch):
    stints, _ = intervals
    cut, root = "2020-06-10", str(tmp_path / "runs")
    known = facts.where(F.col("filed_date") < F.lit(cut).cast("date"))
    history = panel.build_panel(known, "2013-01-01", "2019-12-31", intervals=stints).panel.cache()

    def write():
        return forward.write_forward(known, history, stints, cut, "2013-01-01", root,
                                     PROTOCOL, CODE)

    # An input that moves while the run goes on leaves nothing that counts.
    digests = iter(["1-1", "2-2"])
    with monkeypatch.context() as patch:
        patch.setattr(runs, "digest_text", lambda df: next(digests))
        with pytest.raises(ContractError, match="changed"):
            write()
    with pytest.raises(ContractError, match="no committed run"):
        runs.load_run(spark, root, cut)
    write()
    with pytest.raises(runs.RunTaken):
        write()
    data, provenance = runs.load_run(spark, root, cut)
    assert data.columns == [
        "cut_date", "ticker", "cik", "expected_period_end", "last_known_period_end",
        "last_known_prediction_date", "quarter_gap_days_used", "predicted_probability",
        "predicted_label", *MODEL_FEATURES]
    rows = data.collect()
    assert len(rows) == 39 and all(r.cik == f"{int(r.ticker[1:]):010d}" for r in rows)
    assert all(r.last_known_period_end == D(2020, 3, 31) and r.quarters_available >= 8
               for r in rows)
    assert provenance["decision_threshold"] == "0.5" and provenance["config"] == "revision 3"
    assert 0 < float(provenance["training_positive_rate"]) < 1
    again = {"scored_at": "2021-06-01", "recorded_at": "2020-06-11 09:00:00",
             "study_start": "2013-01-01"}
    scored = forward.score_committed(spark, root, cut, facts, history, PROTOCOL, **again)
    row = scored.scores.first()
    assert row.n_scored == 39 and scored.calibration.agg(F.sum("n")).first()[0] == 39
    kept, _ = runs.load_run(spark, f"{root}/{cut}/scored-2021-06-01", "resolved", ["cut_date"])
    assert kept.count() == 39
    with pytest.raises(ContractError, match="config was"):
        forward.score_committed(spark, root, cut, facts, history, {**PROTOCOL, "revision": 4},
                                **again)
    with pytest.raises(ContractError, match="panel_sha256 was"):
        forward.score_committed(spark, root, cut, facts, history.limit(9), PROTOCOL, **again)


def test_runs_refuse_what_cannot_be_scored(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("A", 1)], "ticker string, actual_label int")
    with pytest.raises(GateError, match="provenance"):
        runs.commit_run(df, {"cut_date": "x"}, root, "x")
    header = {"cut_date": "2020-01-01"}
    runs.commit_run(df, header, root, "x", required=["cut_date"])
    with pytest.raises(GateError, match="provenance"):
        runs.load_run(spark, root, "x")
    data, _ = runs.load_run(spark, root, "x", ["cut_date"])
    with pytest.raises(ContractError):
        forward.forbid_outcomes(data)


def test_census_recovery_and_spans(spark, facts):
    log = [(f"T{i:02d}", D(2013, 1, 1), "add") for i in range(6)]
    log += [("T03", D(2019, 1, 1), "remove"), ("T04", D(2019, 1, 1), "remove")]
    events = spark.createDataFrame(log, "ticker string, date date, kind string")
    current = spark.createDataFrame([(f"T{i:02d}", D(2013, 1, 1)) for i in (0, 1, 2, 5)],
                                    "ticker string, date_added date")
    ids = "ticker string, cik string"
    current_map = spark.createDataFrame(
        [("T00", "0000000000", "Zero"), ("T01", "0000000099", "One"), ("T02", "0000000077", "Two"),
         ("T05", "0000000005", "Five")], ids + ", title string")
    overrides = spark.createDataFrame([("T01", "0000000001")], ids)
    late = facts.where((F.col("cik") == "0000000006") & (F.col("period_end") > "2017-01-01")) \
        .withColumn("cik", F.lit("0000000077"))
    every = facts.unionByName(late)
    table = census.run_census(events, current, overrides, current_map, every.drop("ticker"),
                              "2012-01-01", "2020-12-31")
    flags = {r.ticker: r.flag for r in table.collect()}
    assert flags == {"T00": "OK", "T01": "OK", "T02": "SUSPECTED_REMAP", "T03": "NO_CIK",
                     "T04": "NO_CIK", "T05": "OK"}
    names = spark.createDataFrame(
        [("T02", "Two Corp"), ("T03", "Three Steel Inc"), ("T04", "Fourth Energi Co")],
        "ticker string, company_name string").withColumn("norm", normalise_name("company_name"))
    registry = spark.createDataFrame(
        [("TWO", "0000000077", 0), ("TWO", "0000000002", 1), ("THREE STEEL", "0000000003", 2),
         ("THREE STEEL", "0000000933", 3), ("FOURTH ENERGY", "0000000004", 4)],
        "norm string, cik string, position int")
    found = census.run_recovery(table, names, registry, every.drop("ticker"), "position")
    recovered = {r.ticker: r for r in found.recovered.collect()}
    assert recovered["T03"].match_kind == "exact_ambiguous"
    assert recovered["T03"].recovered_cik == "0000000003"
    assert recovered["T04"].match_kind == "fuzzy" and recovered["T04"].recovered_cik is None
    decision = found.decisions.collect()[0]
    assert (decision.ticker, decision.chosen_cik, decision.rule) \
        == ("T03", "0000000003", "b_single_overlap")
    remap = found.remaps.collect()[0]
    assert (remap.ticker, remap.new_cik, remap.adopt) == ("T02", "0000000002", True)

    wanted = spark.createDataFrame([("T02",), ("T03",), ("T09",), ("NONE",)], "ticker string")
    spans = spark.createDataFrame(
        [("T02", "0000000002", None, D(2016, 12, 31)), ("T02", "0000000077", D(2017, 1, 1), None)],
        ids + ", valid_from date, valid_to date")
    sources = {"overrides": overrides, "current_map": current_map,
               "recovered": spark.createDataFrame([("T03", "0000000003")], ids)}
    spanned = census.spanned_facts(wanted, every.drop("ticker"), id_spans=spans, **sources)
    counts = {(r.ticker, r.route): r.n for r in spanned.groupBy("ticker", "route").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {("T02", "CIK_SPANS"): 36, ("T03", "recovered_ciks"): 36}
    from pitpanel.operators.entities import resolve_ids

    resolved = resolve_ids(wanted, spans=spans, **sources)
    missing = {r.ticker: r.reason for r in census.unresolved(wanted, spanned, resolved).collect()}
    assert missing == {"T09": "no_cik_from_any_source", "NONE": "no_cik_from_any_source"}
