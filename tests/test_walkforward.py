"""Selection and holdout composed end to end on a made-up feature table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitpanel.contracts import ContractError, GateError
from pitpanel.operators.features import MODEL_FEATURES, RANKED_FEATURES
from pitpanel.plans import walkforward

SCHEMA = "ticker string, period_end date, prediction_date date, label_yoy int, " + ", ".join(
    f"{name} double" for name in MODEL_FEATURES)


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(9)
    rows = []
    for i in range(24):
        for q in range(32):
            decided = dt.date(2010, 2, 1) + dt.timedelta(days=91 * q + i % 5)
            x = [rng.gauss(0, 1) for _ in MODEL_FEATURES]
            label = int(x[0] + 0.5 * x[4] + rng.gauss(0.2, 1) > 0) if rng.random() > 0.05 else None
            x[1] = None if rng.random() < 0.1 else x[1]
            rows.append((f"T{i:02d}", decided - dt.timedelta(days=40), decided, label, *x))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_selection_of_five_variants(features):
    run = walkforward.walk_forward(
        features, 2010, 2013, 2015, "2016-01-01",
        tree_options={"max_trees": 6, "patience": 3, "min_leaf": 15, "step": 0.3})
    rows = run.results.collect()
    assert {r.model for r in rows} == set(walkforward.VARIANTS) and len(rows) == 15
    chosen = walkforward.select_variant(run)
    choice = chosen.choice.first()
    means = {r.model: r.mean_log_loss for r in chosen.means.collect()}
    eligible = {walkforward.LOGISTIC, walkforward.TREES}
    assert {choice.best_model, choice.runner_up} == eligible
    assert choice.best_model == min(eligible, key=means.get)
    assert sum(r.wins for r in chosen.wins.collect()) >= 3
    compared = {(r.before, r.after): r.n_folds for r in chosen.corrections.collect()}
    assert compared == {("logistic_raw", "logistic_rank"): 3,
                        ("boosted_outer_es", "boosted_inner_es"): 3}
    n = run.scored.where(F.col("model") == "logistic_rank").count()
    assert chosen.calibration.agg(F.sum("n")).first()[0] == n
    assert chosen.stability.count() == len(MODEL_FEATURES)
    # The signal is found: better than the constant on every fold.
    assert means["logistic_rank"] < means["constant"]
    assert run.iterations.where("best_iteration BETWEEN 1 AND 6").count() == 6


BOUNDS = (("2014-01-01", "2015-01-01"), ("2015-01-01", "2016-01-01"), ("2016-01-01", None))


def protocol(features, spoil=0):
    years = features.where("prediction_date >= '2014-01-01'").groupBy(
        F.least(F.year("prediction_date") - 2013, F.lit(3)).alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.count("label_yoy").alias("m")).collect()
    return {
        "features": {"columns": list(MODEL_FEATURES), "excluded_target_identities": {
            "columns": ["eps_growth_yoy"]}},
        "preprocessing": {"step_1_rank_transform": {"applies_to": list(RANKED_FEATURES)}},
        "model": {"decision_threshold": 0.5, "estimator": {"params": {"C": 1.0}}},
        "evaluation_protocol": {"folds": [
            {"fold": r.fold, "n_predict_rows": r.n + spoil, "n_predict_rows_labelled": r.m}
            for r in years]}}


def test_holdout_is_judged_to_its_end(features):
    run = walkforward.run_holdout(features, protocol(features), BOUNDS)
    verdict = walkforward.judge_holdout(run)
    passed = {r.fold: r for r in verdict.passed.collect()}
    assert set(passed) == {"1", "2", "3", "pooled"}
    assert all(r.passes_both == (r.passes_log_loss and r.passes_accuracy)
               for r in passed.values())
    pooled = verdict.pooled.first()
    labelled = features.where("prediction_date >= '2014-01-01' AND label_yoy IS NOT NULL").count()
    assert pooled.n_labelled == labelled
    assert verdict.calibration.agg(F.sum("n")).first()[0] == labelled
    assert passed["pooled"].passes_log_loss == (pooled.log_loss < pooled.constant_log_loss)
    assert 0 <= verdict.calibration_summary.first().ece < 0.3
    assert verdict.drift.first().spread >= 0


def test_undeclared_counts_and_outcomes_are_refused(spark, features):
    with pytest.raises(GateError, match="declared protocol"):
        walkforward.run_holdout(features, protocol(features, spoil=1), BOUNDS)
    told = spark.createDataFrame([("A", 1)], "ticker string, correct int")
    with pytest.raises(ContractError):
        walkforward.forbid_outcomes(told)


def test_parts_nobody_reads_are_not_computed(features, monkeypatch):
    run = walkforward.walk_forward(features, 2010, 2013, 2015, "2016-01-01", variants=(
        walkforward.CONSTANT, walkforward.LOGISTIC_BIASED, walkforward.LOGISTIC))
    written = []
    real = walkforward.settle
    monkeypatch.setattr(walkforward, "settle", lambda df: written.append(df.columns) or real(df))
    chosen = walkforward.select_variant(run)
    assert chosen.means.count() == 3 and chosen.choice.first().best_model
    # The metrics alone: neither calibration nor lifts are part of a choice.
    assert len(written) == 1
    assert "lift" in chosen.lifts.columns and len(written) == 2
    assert chosen.calibration is chosen.calibration and len(written) == 3


def test_the_registered_selection_compares_all_variants(spark, features, monkeypatch):
    """Trees are part of it; few are grown here, on the made-up table moved to its years."""
    from pitpanel.catalog import evaluation

    moved = features.withColumns({c: F.add_months(c, -12 * 14)
                                  for c in ("period_end", "prediction_date")})
    real = walkforward.walk_forward
    monkeypatch.setattr(evaluation, "part_features", lambda spark, sf_dir: moved)
    monkeypatch.setattr(walkforward, "walk_forward", lambda *args, **options: real(
        *args, **options, tree_options={"max_trees": 4, "min_leaf": 15, "step": 0.3}))
    means = {r.model: r for r in evaluation.selection_means(spark, "").collect()}
    assert set(means) == set(walkforward.VARIANTS)
    assert {r.n_folds for r in means.values()} == {3}
    best = min(walkforward.CORRECTED, key=lambda m: means[m].mean_log_loss)
    assert {r.best_model for r in means.values()} == {best}


def test_the_constant_is_chosen_where_no_model_is_better(spark):
    losses = {"constant": 0.5, "logistic_rank": 0.7, "boosted_inner_es": 0.6,
              "logistic_raw": 0.1, "boosted_outer_es": 0.2}
    rows = [(fold, model, loss + 0.01 * fold * loss, 0.5, 0.2)
            for fold in (1, 2, 3) for model, loss in losses.items()]
    results = spark.createDataFrame(
        rows, "fold int, model string, log_loss double, accuracy double, brier double")
    choice = walkforward.select_variant(walkforward.Evaluation(results, results)).choice.first()
    assert (choice.best_model, choice.runner_up) == ("constant", "boosted_inner_es")


def test_a_written_feature_table_is_not_written_again(features, monkeypatch):
    written = []
    real = walkforward.settle
    monkeypatch.setattr(walkforward, "settle", lambda df: written.append(df.columns) or real(df))
    run = walkforward.run_holdout(features, protocol(features), BOUNDS, settled=True)
    assert run.results.count() == 3 and not written
    verdict = walkforward.judge_holdout(run)
    assert verdict.passed.count() == 4
    # Results, scored rows and the pooled row.
    assert len(written) == 3
