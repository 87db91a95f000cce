import math

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import evaluate, gates
from tests.test_features import day

# Published per-fold log-losses and accuracies of three variants.
YEARS = (2015, 2016, 2017, 2018, 2019, 2020, 2021)
LOG_LOSS = {
    "constant": (0.708135, 0.703389, 0.654762, 0.633254, 0.68694, 0.735144, 0.614227),
    "logistic_rank": (0.667567, 0.616194, 0.60921, 0.616083, 0.642396, 0.687436, 0.558099),
    "boosted_inner_es": (0.644761, 0.631271, 0.605891, 0.625313, 0.637757, 0.700509, 0.547042),
}
ACCURACY = {
    "constant": (0.54047, 0.534899, 0.645455, 0.692357, 0.572418, 0.464868, 0.750508),
    "logistic_rank": (0.615535, 0.662753, 0.668831, 0.65414, 0.63602, 0.59473, 0.721356),
    "boosted_inner_es": (0.633812, 0.636008, 0.672078, 0.656688, 0.629723, 0.57591, 0.740339),
}
# Published holdout calibration, (rows, predicted, actual) per bin.
BINS = ((553, 0.27769549, 0.32549729), (552, 0.39082364, 0.40579710), (552, 0.45472782, 0.43478261),
        (552, 0.51287566, 0.47826087), (552, 0.58208436, 0.56884058), (552, 0.64446537, 0.70471014),
        (552, 0.69005129, 0.72644928), (552, 0.72326800, 0.70833333), (552, 0.75800242, 0.71014493),
        (552, 0.82392476, 0.73550725))


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [(year, model, LOG_LOSS[model][i], ACCURACY[model][i], 0.2)
            for model in LOG_LOSS for i, year in enumerate(YEARS)]
    return spark.createDataFrame(
        rows, "fold int, model string, log_loss double, accuracy double, brier double")


def test_published_means_and_deviations(metrics):
    got = {r.model: r for r in evaluate.mean_of_folds(metrics).collect()}
    assert round(got["constant"].mean_log_loss, 4) == 0.6766
    assert round(got["logistic_rank"].mean_log_loss, 4) == 0.6281
    assert round(got["logistic_rank"].sd_log_loss, 4) == 0.0425
    assert round(got["boosted_inner_es"].mean_log_loss, 4) == 0.6275
    assert round(got["logistic_rank"].mean_accuracy, 3) == 0.650


def test_published_paired_comparison(metrics):
    compared = evaluate.compare_models(metrics, "boosted_inner_es", "logistic_rank")
    row = evaluate.paired_t(compared).collect()[0]
    assert (round(row.mean_difference, 4), round(row.standard_error, 4)) == (0.0006, 0.0052)
    assert (round(row.t_statistic, 2), row.folds_won, row.n_folds) == (0.12, 4, 7)
    choice = evaluate.freeze_choice(metrics, list(LOG_LOSS)).collect()[0]
    assert (choice.best_model, choice.runner_up, choice.is_tie) \
        == ("boosted_inner_es", "logistic_rank", True)
    assert {r.model: r.folds_beating_constant
            for r in evaluate.rank_models(metrics, list(LOG_LOSS)).collect()}["logistic_rank"] == 7


def test_published_calibration_error(spark):
    rows = [(i, n, p, a, a - p) for i, (n, p, a) in enumerate(BINS)]
    table = spark.createDataFrame(
        rows, "decile int, n long, predicted double, actual double, gap double")
    row = evaluate.calibration_summary(table).collect()[0]
    assert (round(row.ece, 4), row.rising_steps, row.steps, round(row.spread, 3)) \
        == (0.0378, 8, 9, 0.410)


def test_metrics_clip_certain_predictions(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (0, 0.25, 0), (1, 1.0, 1)],
                               "y_true int, probability double, prediction int")
    row = evaluate.binary_metrics(df).collect()[0]
    want = (-math.log(2.220446049250313e-16) - math.log(0.75) - math.log1p(-2.22e-16)) / 3
    assert math.isfinite(row.log_loss) and abs(row.log_loss - want) < 1e-9
    assert abs(row.accuracy - 2 / 3) < 1e-12 and abs(row.brier - (1 + 0.0625) / 3) < 1e-12


def years_frame(spark, years):
    rows = [(f"t{i}", day(0).replace(year=y, month=m), 1)
            for y in years for i, m in enumerate((2, 8))]
    return spark.createDataFrame(rows, "ticker string, prediction_date date, label_yoy int")


def test_expanding_folds_and_inner_split(spark):
    frame = years_frame(spark, range(2011, 2016))
    folds = evaluate.expanding_folds(spark, 2011, 2015, 2015)
    assigned = evaluate.with_inner_roles(evaluate.assign_expanding(frame, folds))
    got = {(r.role, r.y): r.n for r in assigned.groupBy(
        "role", F.year("prediction_date").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {**{("train", y): 2 for y in range(2011, 2015)}, ("validate", 2015): 2,
                   **{("inner_train", y): 2 for y in range(2011, 2014)},
                   ("inner_validate", 2014): 2}
    assert gates.fold_order(assigned, "2016-01-01").count() == 0
    assert [r.violation for r in gates.fold_order(assigned, "2015-01-01").collect()] \
        == ["reaches the holdout"]


def test_fold_gate_catches_late_training_rows(spark):
    frame = years_frame(spark, range(2011, 2016))
    folds = evaluate.expanding_folds(spark, 2011, 2015, 2015)
    assigned = evaluate.with_inner_roles(evaluate.assign_expanding(frame, folds))
    moved = assigned.withColumn("role", F.when(
        (F.col("role") == "validate") & (F.month("prediction_date") == 8), "train")
        .otherwise(F.col("role")))
    got = {r.violation for r in gates.fold_order(moved, "2016-01-01").collect()}
    assert {"trains on or after validation", "inner split loses rows"} <= got


def test_protocol_gate(spark):
    frame = years_frame(spark, range(2019, 2024)).withColumn("period_end", F.col("prediction_date"))
    folds = evaluate.boundary_folds(spark, [("2021-01-01", "2022-01-01"), ("2022-01-01", None)])
    assigned = evaluate.assign_boundary(frame, folds)
    declared = spark.createDataFrame([(1, 2, 2), (2, 4, 4)],
                                     "fold int, n_predict_rows long, n_predict_rows_labelled long")
    holdout = frame.where("prediction_date >= '2021-01-01'")
    keys = ["ticker", "prediction_date"]
    assert gates.protocol_breaches(assigned, declared, holdout, keys).count() == 0
    orphaned = assigned.where("NOT (role = 'predict' AND prediction_date >= '2023-01-01')")
    got = {r.violation for r in gates.protocol_breaches(orphaned, declared, holdout, keys)
           .collect()}
    assert got == {"predicted rows differ from declaration",
                   "labelled rows differ from declaration", "holdout row in no fold"}


def test_the_constant_never_beats_itself(spark):
    """Sums of doubles can differ from one computation of the metrics to the next."""
    import random

    noise = F.udf(lambda fold: 0.6 + random.random() * 1e-9, "double").asNondeterministic()
    metrics = spark.range(0, 60).select(
        (F.col("id") % 30).cast("int").alias("fold"),
        F.when(F.col("id") < 30, "constant").otherwise("other").alias("model"),
        noise("id").alias("log_loss"), noise("id").alias("accuracy"))
    ranked = {r.model: r for r in evaluate.rank_models(metrics, ["constant", "other"]).collect()}
    assert ranked["constant"].folds_beating_constant == 0 and len(ranked) == 2
    judged = evaluate.against_constant(metrics).where("model = 'constant'").collect()
    assert len(judged) == 30
    assert all(r.log_loss_delta == 0 and not r.passes_log_loss and not r.passes_accuracy
               for r in judged)
