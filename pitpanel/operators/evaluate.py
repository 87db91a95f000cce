"""Folds, metrics, calibration and paired comparison of scored rows.

A scored table holds one row per (fold, model, observation) with a 0/1 label,
a probability and a 0/1 prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.functions.scores import brier_term, decide, log_loss_term
from pitpanel.operators.ordered import exact_median, quantile_arrays

DECILES = 10
MIN_ENTITY_ROWS = 20


# --- folds -----------------------------------------------------------------


def expanding_folds(spark: SparkSession, first_train: int, first_validate: int,
                    last_validate: int) -> DataFrame:
    """One row per validation year with its training and inner-split years."""
    years = spark.range(first_validate, last_validate + 1).select(
        F.col("id").cast("int").alias("fold"))
    return years.select(
        "fold", F.lit(first_train).alias("train_from"), (F.col("fold") - 1).alias("train_to"),
        F.concat_ws("-", F.lit(first_train), (F.col("fold") - 1)).alias("train_years"),
        (F.col("fold") - 1).alias("inner_validate_year"))


def assign_expanding(df: DataFrame, folds: DataFrame,
                     decision: str = "prediction_date") -> DataFrame:
    """(fold, role) per row: train up to the year before, validate in the year.

    Each row repeats once per fold that uses it, as refitting from nothing
    requires. The fold table has one row per year and is what is broadcast.
    """
    year = F.year(decision)
    role = (F.when(year == F.col("fold"), "validate")
            .when(year.between(F.col("train_from"), F.col("train_to")), "train"))
    return df.join(F.broadcast(folds), year.between(F.col("train_from"), F.col("fold"))) \
        .withColumn("role", role)


def with_inner_roles(assigned: DataFrame, decision: str = "prediction_date",
                     fold: str = "fold") -> DataFrame:
    """Add inner_train / inner_validate rows: the last training year stops early."""
    last_year = assigned.where(F.col("role") == "train").groupBy(fold).agg(
        F.max(F.year(decision)).alias("_inner_year"))
    train = assigned.where(F.col("role") == "train").join(F.broadcast(last_year), fold)
    inner = train.withColumn(
        "role", F.when(F.year(decision) < F.col("_inner_year"), "inner_train")
        .otherwise("inner_validate")).drop("_inner_year")
    return assigned.unionByName(inner)


def boundary_folds(spark: SparkSession, boundaries: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Folds ``[opens, closes)``; a fold without a close takes everything later."""
    rows = [(i, start, end) for i, (start, end) in enumerate(boundaries, start=1)]
    return spark.createDataFrame(rows, "fold int, opens string, closes string").select(
        "fold", F.col("opens").cast("date").alias("opens"),
        F.col("closes").cast("date").alias("closes"))


def assign_boundary(df: DataFrame, folds: DataFrame, decision: str = "prediction_date",
                    label: str = "label_yoy") -> DataFrame:
    """Predict inside the boundaries, train on labelled rows before they open."""
    day = F.col(decision)
    predicts = (day >= F.col("opens")) & (F.col("closes").isNull() | (day < F.col("closes")))
    trains = (day < F.col("opens")) & F.col(label).isNotNull()
    return df.join(F.broadcast(folds), predicts | trains).withColumn(
        "role", F.when(predicts, "predict").otherwise("train"))


def fold_sizes(assigned: DataFrame, fold: str = "fold", label: str = "label_yoy") -> DataFrame:
    return assigned.groupBy(fold, "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(label).alias("n_labelled"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"))


def constant_scores(assigned: DataFrame, *, fold: str = "fold", label: str = "label_yoy",
                    scored_role: str = "validate", keep: Sequence[str] = ()) -> DataFrame:
    """Always 1, at the fold's own training positive rate."""
    rates = assigned.where(F.col("role") == "train").groupBy(fold).agg(
        F.avg(F.col(label).cast("double")).alias("probability"))
    scored = assigned.where(F.col("role") == scored_role).select(fold, label, *keep)
    return scored.join(F.broadcast(rates), fold).select(
        fold, *keep, F.lit("constant").alias("model"), F.col(label).alias("y_true"),
        F.lit(1).alias("prediction"), "probability")


# --- metrics ---------------------------------------------------------------


def with_prediction(scored: DataFrame, threshold: float = 0.5,
                    probability: str = "probability", out: str = "prediction") -> DataFrame:
    return scored.withColumn(out, decide(F.col(probability), threshold))


def binary_metrics(scored: DataFrame, by: Sequence[str] = (), *, label: str = "y_true",
                   probability: str = "probability", prediction: str = "prediction") -> DataFrame:
    """Log-loss, accuracy, Brier score and predicted positive rate per group."""
    y, p = F.col(label), F.col(probability)
    aggregates = [
        F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("positive_rate"),
        F.avg(log_loss_term(y, p)).alias("log_loss"),
        F.avg((F.col(prediction) == y).cast("double")).alias("accuracy"),
        F.avg(brier_term(y, p)).alias("brier"),
        F.avg(F.col(prediction).cast("double")).alias("predicted_positive_rate"),
    ]
    labelled = scored.where(y.isNotNull())
    return labelled.groupBy(*by).agg(*aggregates) if by else labelled.agg(*aggregates)


def against_constant(metrics: DataFrame, *, fold: str = "fold", model: str = "model",
                     constant: str = "constant") -> DataFrame:
    """Deltas to the fold's own constant baseline, and the pass verdicts."""
    based = _with_constant(metrics, fold, model, constant).where(F.col("_constant").isNotNull())
    return verdicts(based.select(
        fold, *[c for c in metrics.columns if c != fold],
        F.col("_constant.log_loss").alias("constant_log_loss"),
        F.col("_constant.accuracy").alias("constant_accuracy")))


def _with_constant(metrics: DataFrame, fold: str, model: str, constant: str) -> DataFrame:
    """Adds the constant's row of the fold, null where it has none.

    A window, not a self-join: a join computes the averages twice, their last digits
    follow the order in which rows arrive, and the constant would beat itself.
    """
    own = F.when(F.col(model) == constant, F.struct("log_loss", "accuracy"))
    return metrics.withColumn("_constant", F.max(own).over(Window.partitionBy(fold)))


def verdicts(table: DataFrame, log_loss: str = "log_loss",
             accuracy: str = "accuracy") -> DataFrame:
    """Pass on log-loss below and accuracy above the constant; both must hold."""
    return (
        table.withColumn("log_loss_delta", F.col(log_loss) - F.col("constant_log_loss"))
        .withColumn("accuracy_delta", F.col(accuracy) - F.col("constant_accuracy"))
        .withColumn("passes_log_loss", F.col("log_loss_delta") < 0)
        .withColumn("passes_accuracy", F.col("accuracy_delta") > 0)
        .withColumn("passes_both", F.col("passes_log_loss") & F.col("passes_accuracy")))


def mean_of_folds(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Each fold weighs the same: mean and sample deviation over folds."""
    return metrics.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("log_loss").alias("mean_log_loss"),
        F.stddev_samp("log_loss").alias("sd_log_loss"),
        F.avg("accuracy").alias("mean_accuracy"), F.avg("brier").alias("mean_brier"))


def pooled_against_constant(scored: DataFrame, rates: DataFrame, *, fold: str = "fold",
                            label: str = "y_true", probability: str = "probability",
                            prediction: str = "prediction") -> DataFrame:
    """Pooled rows against a baseline at each row's own fold rate.

    ``rates`` holds one (fold, train_positive_rate) row per fold.
    """
    rows = scored.where(F.col(label).isNotNull()).join(F.broadcast(rates), fold)
    y = F.col(label)
    pooled = rows.agg(
        F.count(F.lit(1)).alias("n_labelled"),
        F.avg(y.cast("double")).alias("actual_positive_rate"),
        F.avg(log_loss_term(y, F.col(probability))).alias("log_loss"),
        F.avg(log_loss_term(y, F.col("train_positive_rate"))).alias("constant_log_loss"),
        F.avg((F.col(prediction) == y).cast("double")).alias("accuracy"),
        F.avg((y == 1).cast("double")).alias("constant_accuracy"),
        F.avg(brier_term(y, F.col(probability))).alias("brier"))
    return verdicts(pooled)


def fold_model_matrix(metrics: DataFrame, models: Sequence[str], *, fold: str = "fold",
                      model: str = "model", measure: str = "log_loss") -> DataFrame:
    """Folds x models of one measure, and the fold's lowest value."""
    wide = metrics.groupBy(fold).pivot(model, list(models)).agg(F.first(measure))
    lowest = F.least(*[F.col(name) for name in models]) if len(models) > 1 else F.col(models[0])
    return wide.withColumn("lowest", lowest)


def fold_wins(matrix: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model: mean over folds and folds in which it was lowest."""
    cells = F.array(*[F.struct(F.lit(name).alias("model"), F.col(name).alias("value"))
                      for name in models])
    return matrix.select("lowest", F.explode(cells).alias("cell")).groupBy(
        F.col("cell.model").alias("model")).agg(
        F.avg("cell.value").alias("mean"),
        F.count_if(F.col("cell.value") == F.col("lowest")).alias("wins"))


def compare_models(metrics: DataFrame, before: str, after: str, *, fold: str = "fold",
                   model: str = "model") -> DataFrame:
    """Two variants aligned by fold, with log-loss and accuracy deltas."""
    def side(name: str, tag: str) -> DataFrame:
        return metrics.where(F.col(model) == name).select(
            fold, F.col("log_loss").alias(f"log_loss_{tag}"),
            F.col("accuracy").alias(f"accuracy_{tag}"))

    return side(before, "before").join(side(after, "after"), fold).select(
        fold, "log_loss_before", "log_loss_after",
        (F.col("log_loss_after") - F.col("log_loss_before")).alias("log_loss_delta"),
        "accuracy_before", "accuracy_after",
        (F.col("accuracy_after") - F.col("accuracy_before")).alias("accuracy_delta"))


def paired_t(compared: DataFrame, left: str = "log_loss_before",
             right: str = "log_loss_after") -> DataFrame:
    """Paired difference ``right - left`` over folds: mean, error, t, folds won."""
    difference = F.col(right) - F.col(left)
    error = F.stddev_samp(difference) / F.sqrt(F.count(F.lit(1)))
    return compared.agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg(difference).alias("mean_difference"),
        error.alias("standard_error"),
        F.when(error == 0, 0.0).otherwise(F.avg(difference) / F.nullif(error, F.lit(0.0)))
        .alias("t_statistic"),
        F.count_if(difference > 0).alias("folds_won"))


def rank_models(metrics: DataFrame, eligible: Sequence[str], *, fold: str = "fold",
                model: str = "model", constant: str = "constant") -> DataFrame:
    """Eligible models by mean log-loss, with folds beating the constant."""
    table = _with_constant(metrics, fold, model, constant).where(F.col(model).isin(*eligible))
    # One row per model.
    return table.groupBy(model).agg(
        F.avg("log_loss").alias("mean_log_loss"), F.stddev_samp("log_loss").alias("sd"),
        F.count_if(F.col("log_loss") < F.col("_constant.log_loss")).alias("folds_beating_constant")) \
        .withColumn("rank", F.row_number().over(Window.orderBy("mean_log_loss", model)))


def freeze_choice(metrics: DataFrame, eligible: Sequence[str], *, fold: str = "fold",
                  model: str = "model", tie_below: float = 2.0) -> DataFrame:
    """The best model, its runner-up, and whether folds separate the two.

    Everything after the per-model ranking is one row per fold at most.
    """
    ranked = rank_models(metrics, eligible, fold=fold, model=model)
    places = ranked.where(F.col("rank") <= 2).select(model, "rank", "mean_log_loss")
    losses = metrics.join(F.broadcast(places.select(model, "rank")), model).groupBy(fold).agg(
        F.max(F.when(F.col("rank") == 1, F.col("log_loss"))).alias("winner"),
        F.max(F.when(F.col("rank") == 2, F.col("log_loss"))).alias("runner_up"))
    stats = paired_t(losses, "winner", "runner_up")
    names = places.agg(
        F.max(F.when(F.col("rank") == 1, F.col(model))).alias("best_model"),
        F.max(F.when(F.col("rank") == 2, F.col(model))).alias("runner_up"),
        (F.max(F.when(F.col("rank") == 2, F.col("mean_log_loss")))
         - F.max(F.when(F.col("rank") == 1, F.col("mean_log_loss")))).alias("margin"))
    return names.join(F.broadcast(stats)).withColumn(
        "is_tie", F.abs("t_statistic") < tie_below)


# --- calibration -----------------------------------------------------------


def with_quantile_bin(df: DataFrame, probability: str = "probability", bins: int = DECILES,
                      by: Sequence[str] = (), out: str = "decile") -> DataFrame:
    """Bin by interpolated quantile edges: right-closed, lowest value included.

    Repeated edges are dropped, so tied probabilities never split. When all
    probabilities are equal everything lands in bin 0. Groups are few, as folds and models
    are: their edges go to the rows, which aren't dealt by group.
    """
    edges = quantile_arrays(df, probability, [i / bins for i in range(bins + 1)], by)
    tagged = df.join(F.broadcast(edges), list(by) or None)
    inner = F.slice(F.array_distinct("edges"), 2, bins)
    below = F.size(F.filter(inner, lambda e: e < F.col(probability)))
    return tagged.withColumn(
        out, F.when(F.col(probability).isNotNull(), below)).drop("edges")


def calibration_table(scored: DataFrame, *, label: str = "y_true",
                      probability: str = "probability", bins: int = DECILES,
                      by: Sequence[str] = ()) -> DataFrame:
    """Per bin: rows, mean probability, actual rate, range, gap."""
    labelled = scored.where(F.col(label).isNotNull())
    binned = with_quantile_bin(labelled, probability, bins, by)
    return binned.groupBy(*by, "decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("predicted"),
        F.avg(F.col(label).cast("double")).alias("actual"),
        F.min(probability).alias("p_min"), F.max(probability).alias("p_max")) \
        .withColumn("gap", F.col("actual") - F.col("predicted"))


def calibration_summary(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error, rising steps and spread of a bin table."""
    order = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("decile")
    stepped = table.withColumn("_rise", F.col("actual") > F.lag("actual").over(order))
    aggregates = [
        (F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"),
        F.count_if(F.col("_rise")).alias("rising_steps"),
        (F.count(F.lit(1)) - 1).alias("steps"),
        (F.max_by("actual", "decile") - F.min_by("actual", "decile")).alias("spread"),
    ]
    return stepped.groupBy(*by).agg(*aggregates) if by else stepped.agg(*aggregates)


# --- entities and drift ----------------------------------------------------


def entity_lift(scored: DataFrame, *, entity: str = "ticker", label: str = "y_true",
                prediction: str = "prediction", min_rows: int = MIN_ENTITY_ROWS) -> DataFrame:
    """Per entity with enough rows: accuracy, base rate and lift over always-1."""
    y = F.col(label)
    return scored.where(y.isNotNull()).groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("positive_rate"),
        F.avg((F.col(prediction) == y).cast("double")).alias("accuracy")) \
        .withColumn("lift", F.col("accuracy") - F.col("positive_rate")) \
        .where(F.col("n") >= min_rows)


def lift_summary(lifts: DataFrame) -> DataFrame:
    """Medians, share of positive lift and correlations with the base rate."""
    table = lifts.agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_rows"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.count_if(F.col("lift") > 0).alias("n_beating"),
        (F.count_if(F.col("lift") > 0) / F.count(F.lit(1))).alias("share_beating"),
        F.corr("accuracy", "positive_rate").alias("corr_accuracy_rate"),
        F.corr("lift", "positive_rate").alias("corr_lift_rate"))
    return table.join(F.broadcast(exact_median(lifts, "accuracy", out="median_accuracy"))) \
        .join(F.broadcast(exact_median(lifts, "lift", out="median_lift")))


def rate_drift(metrics: DataFrame, rate: str = "positive_rate") -> DataFrame:
    """Range and deviation of the positive rate over folds."""
    return metrics.agg(
        F.min(rate).alias("lowest"), F.max(rate).alias("highest"),
        (F.max(rate) - F.min(rate)).alias("spread"), F.stddev_samp(rate).alias("sd"))


def coefficient_stability(coefficients: DataFrame, before: str, after: str, *,
                          model: str = "model") -> DataFrame:
    """Mean coefficient per feature over folds for two variants, and their ratio."""
    def mean_of(name: str) -> Column:
        return F.avg(F.when(F.col(model) == name, F.col("coefficient")))

    means = coefficients.groupBy("feature").agg(
        mean_of(before).alias("before"), mean_of(after).alias("after"))
    return means.withColumn(
        "ratio", F.when(F.abs("before") > 1e-12, F.abs("after") / F.abs("before")))
