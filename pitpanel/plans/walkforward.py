"""Walk-forward selection and the declared holdout run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.contracts import ContractError, forbid_columns, require_columns
from pitpanel.operators import evaluate, gates, ml
from pitpanel.operators.features import MODEL_FEATURES, RANKED_FEATURES, TARGET_IDENTITIES
from pitpanel.operators.knowledge import any_missing, labelled_rows, lock_holdout
from pitpanel.session import settle
from pitpanel.sources.protocol import declared_folds

CONSTANT = "constant"
LOGISTIC_BIASED, LOGISTIC = "logistic_raw", "logistic_rank"
TREES_BIASED, TREES = "boosted_outer_es", "boosted_inner_es"
CORRECTED = (CONSTANT, LOGISTIC, TREES)
VARIANTS = (CONSTANT, LOGISTIC_BIASED, TREES_BIASED, LOGISTIC, TREES)


@dataclass(frozen=True)
class Evaluation:
    scored: DataFrame
    results: DataFrame
    coefficients: DataFrame | None = None
    iterations: DataFrame | None = None


def modelling_frame(features: DataFrame, boundary: str, label: str = "label_yoy") -> DataFrame:
    """Lock the holdout first, then keep labelled rows, nulls in features included."""
    require_columns(features, [*MODEL_FEATURES, label], "feature table")
    problems = gates.unclean_features(MODEL_FEATURES, TARGET_IDENTITIES, label)
    if problems:
        raise ContractError("; ".join(problems))
    return labelled_rows(lock_holdout(features, boundary), label)


def fold_table(assigned: DataFrame, scored_role: str, label: str = "label_yoy",
               features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Row counts, rates and rows with a missing feature, per fold and side."""
    incomplete = any_missing(features)

    def side(role: str, tag: str) -> list:
        here = F.col("role") == role
        return [F.count_if(here).alias(f"n_{tag}"),
                F.count_if(here & incomplete).alias(f"n_{tag}_rows_with_null_feature"),
                F.avg(F.when(here, F.col(label).cast("double"))).alias(f"{tag}_positive_rate")]

    return assigned.groupBy("fold").agg(*side("train", "train"), *side(scored_role, scored_role),
                                        F.count_if(F.col("role") == "inner_train")
                                        .alias("n_inner_train"))


def walk_forward(features: DataFrame, first_train: int, first_validate: int, last_validate: int,
                 boundary: str, *, variants: Sequence[str] = VARIANTS,
                 tree_options: dict | None = None, entity: str = "ticker") -> Evaluation:
    """Refit every variant on every expanding fold and score the validation years."""
    frame = modelling_frame(features, boundary)
    folds = evaluate.expanding_folds(frame.sparkSession, first_train, first_validate,
                                     last_validate)
    used = ["period_end", "prediction_date", "label_yoy", entity, *MODEL_FEATURES]
    assigned = evaluate.with_inner_roles(
        evaluate.assign_expanding(settle(frame.select(*used)), folds))
    gates.enforce(gates.fold_order(assigned, boundary), "fold discipline")
    parts, coefficients, iterations = [], [], []
    keep = [entity]
    regressions = {name: RANKED_FEATURES if name == LOGISTIC else ()
                   for name in variants if name in (LOGISTIC, LOGISTIC_BIASED)}
    if regressions:
        scored, weights = ml.logistic_variants(assigned, MODEL_FEATURES, regressions, keep=keep)
        parts.append(scored)
        coefficients.append(weights)
    for name in variants:
        if name in regressions:
            continue
        if name == CONSTANT:
            parts.append(evaluate.constant_scores(assigned, keep=keep))
        elif name in (TREES, TREES_BIASED):
            scored, best = ml.trees_by_fold(assigned, MODEL_FEATURES, inner=name == TREES,
                                            keep=keep, model=name, **(tree_options or {}))
            parts.append(scored)
            iterations.append(best)
        else:
            raise ValueError(f"unknown variant {name!r}")
    scored = settle(_union(parts))
    metrics = evaluate.binary_metrics(scored, ["fold", "model"])
    results = metrics.join(F.broadcast(folds), "fold") \
        .join(F.broadcast(fold_table(assigned, "validate").drop("n_validate")), "fold") \
        .withColumn("corrected", F.col("model").isin(*CORRECTED)) \
        .withColumn("n_train_used", F.when(F.col("model") == TREES, F.col("n_inner_train"))
                    .otherwise(F.col("n_train")))
    base = metrics.where(F.col("model") == CONSTANT).select(
        "fold", F.col("accuracy").alias("_constant"))
    results = results.join(F.broadcast(base), "fold", "left").withColumn(
        "accuracy_minus_constant", F.col("accuracy") - F.col("_constant")).drop("_constant")
    return Evaluation(scored, results, _union(coefficients) if coefficients else None,
                      _union(iterations) if iterations else None)


def run_holdout(features: DataFrame, protocol: dict,
                boundaries: Sequence[tuple[str, str | None]],
                entity: str = "ticker", settled: bool = False) -> Evaluation:
    """Execute the declared protocol once: check it, refit per fold, score.

    ``settled`` states that the features are written already.
    """
    columns = protocol["features"]["columns"]
    identities = protocol["features"]["excluded_target_identities"]["columns"]
    problems = gates.unclean_features(columns, identities, "label_yoy")
    if problems:
        raise ContractError("; ".join(problems))
    require_columns(features, [*columns, "label_yoy"], "feature table")
    spark = features.sparkSession
    features = features.select(entity, "period_end", "prediction_date", "label_yoy", *columns)
    features = features if settled else settle(features)
    assigned = evaluate.assign_boundary(features, evaluate.boundary_folds(spark, boundaries))
    opening = F.lit(boundaries[0][0]).cast("date")
    keys = [entity, "period_end"]
    gates.enforce(gates.protocol_breaches(
        assigned, declared_folds(spark, protocol),
        features.where(F.col("prediction_date") >= opening), keys), "declared protocol")
    threshold = protocol["model"]["decision_threshold"]
    ranked = protocol["preprocessing"]["step_1_rank_transform"]["applies_to"]
    penalty = protocol["model"]["estimator"]["params"]["C"]
    scored, weights = ml.logistic_by_fold(
        assigned, columns, ranked=ranked, keep=[*keys, "prediction_date"],
        scored_role="predict", c=penalty, threshold=threshold)
    constant = evaluate.constant_scores(assigned, scored_role="predict", keep=[entity])
    metrics = evaluate.binary_metrics(
        scored.select("fold", "model", "y_true", "prediction", "probability").unionByName(
            constant.select("fold", "model", "y_true", "prediction", "probability")),
        ["fold", "model"])
    results = evaluate.against_constant(metrics).where(F.col("model") != CONSTANT)
    return Evaluation(scored, results.join(F.broadcast(fold_table(assigned, "predict")), "fold"),
                      weights)


@dataclass(frozen=True)
class Selection:
    """What a choice among variants rests on; a part is computed when it is first read."""

    run: Evaluation
    metrics: DataFrame
    models: list[str]
    calibrated: str = LOGISTIC
    entity: str = "ticker"

    @property
    def _shown(self) -> DataFrame:
        return self.run.scored.where(F.col("model") == self.calibrated)

    @property
    def _pairs(self) -> list[tuple[str, str]]:
        return [(biased, corrected) for biased, corrected in
                ((LOGISTIC_BIASED, LOGISTIC), (TREES_BIASED, TREES))
                if biased in self.models and corrected in self.models]

    @cached_property
    def means(self) -> DataFrame:
        return evaluate.mean_of_folds(self.metrics)

    @cached_property
    def matrix(self) -> DataFrame:
        return evaluate.fold_model_matrix(self.metrics, self.models)

    @cached_property
    def wins(self) -> DataFrame:
        return evaluate.fold_wins(self.matrix, self.models)

    @cached_property
    def corrections(self) -> DataFrame | None:
        compared = [evaluate.paired_t(evaluate.compare_models(self.metrics, a, b)).select(
            F.lit(a).alias("before"), F.lit(b).alias("after"), "*") for a, b in self._pairs]
        return _union(compared) if compared else None

    @cached_property
    def choice(self) -> DataFrame:
        eligible = [m for m in self.models if m in CORRECTED]
        return evaluate.freeze_choice(self.metrics, eligible)

    @cached_property
    def calibration(self) -> DataFrame:
        return settle(evaluate.calibration_table(self._shown))

    @cached_property
    def calibration_summary(self) -> DataFrame:
        return evaluate.calibration_summary(self.calibration)

    @cached_property
    def lifts(self) -> DataFrame:
        return settle(evaluate.entity_lift(self._shown, entity=self.entity))

    @cached_property
    def lift_summary(self) -> DataFrame:
        return evaluate.lift_summary(self.lifts)

    @cached_property
    def stability(self) -> DataFrame | None:
        if self.run.coefficients is None or (LOGISTIC_BIASED, LOGISTIC) not in self._pairs:
            return None
        return evaluate.coefficient_stability(self.run.coefficients, LOGISTIC_BIASED, LOGISTIC)


def select_variant(run: Evaluation, calibrated: str = LOGISTIC,
                   entity: str = "ticker") -> Selection:
    """Compare the variants of a walk-forward run and freeze the best corrected one.

    Biased variants are compared with their corrections and never chosen; the constant is
    chosen where no model is better.
    """
    metrics = settle(run.results)
    models = [m for m in VARIANTS if m in {r.model for r in
                                           metrics.select("model").distinct().collect()}]
    return Selection(run, metrics, models, calibrated, entity)


@dataclass(frozen=True)
class Verdict:
    """The holdout's answer: by fold, pooled, and where it comes from.

    A part is computed when it is first read.
    """

    folds: DataFrame
    scored: DataFrame
    entity: str = "ticker"

    @cached_property
    def pooled(self) -> DataFrame:
        return settle(evaluate.pooled_against_constant(
            self.scored, self.folds.select("fold", "train_positive_rate")))

    @cached_property
    def passed(self) -> DataFrame:
        flags = ["passes_log_loss", "passes_accuracy", "passes_both"]
        return self.folds.select(F.col("fold").cast("string").alias("fold"), *flags).unionByName(
            self.pooled.select(F.lit("pooled").alias("fold"), *flags))

    @cached_property
    def calibration(self) -> DataFrame:
        return settle(evaluate.calibration_table(self.scored))

    @cached_property
    def calibration_summary(self) -> DataFrame:
        return evaluate.calibration_summary(self.calibration)

    @cached_property
    def lifts(self) -> DataFrame:
        return settle(evaluate.entity_lift(self.scored, entity=self.entity))

    @cached_property
    def lift_summary(self) -> DataFrame:
        return evaluate.lift_summary(self.lifts)

    @cached_property
    def drift(self) -> DataFrame:
        return evaluate.rate_drift(self.folds)


def judge_holdout(run: Evaluation, entity: str = "ticker") -> Verdict:
    """Pass or fail per fold and pooled, calibration, and lift by entity.

    Every pooled row carries its own fold's constant rate; log-loss decides where
    the two conditions disagree.
    """
    return Verdict(settle(run.results), settle(run.scored), entity)


def forbid_outcomes(predictions: DataFrame) -> DataFrame:
    """A prediction table must not carry what it is scored against."""
    return forbid_columns(predictions, ("actual_label", "label_yoy", "outcome", "correct"),
                          "predictions")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
