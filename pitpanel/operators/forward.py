"""Forward test: pending rows, outcome resolution, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.contracts import known_true
from pitpanel.functions.scores import brier_term, log_loss_term
from pitpanel.operators.asof import covered_at
from pitpanel.operators.evaluate import verdicts
from pitpanel.operators.knowledge import MAX_LAG_DAYS, first_row
from pitpanel.operators.profile import recent_step

MIN_HISTORY = 4
MAX_SILENCE_DAYS = 220

SCORED = "scored"
NO_LABEL = "excluded_no_label"
LATE = "excluded_late_filing"
NO_FILING = "excluded_no_filing"
OUTSTANDING = "outstanding"

# The reasons a resolved table gives.
EXCLUSION_REASONS = {
    NO_LABEL: "filed in time; label null under the panel's rules",
    LATE: f"filed after expected_period_end + {MAX_LAG_DAYS}d",
    NO_FILING: f"no qualifying filing by expected_period_end + {MAX_LAG_DAYS}d",
}


def prefer_first(preferred: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union in which the preferred table's row wins for a key both hold."""
    extra = other.join(preferred.select(*keys), list(keys), "left_anti")
    return preferred.unionByName(extra, allowMissingColumns=True)


def split_at_cut(fresh: DataFrame, cut: str,
                 decision: str = "prediction_date") -> tuple[DataFrame, DataFrame]:
    """(knowable by the cut, withheld)."""
    day = F.lit(cut).cast("date")
    return fresh.where(F.col(decision) <= day), fresh.where(F.col(decision) > day)


def pending_rows(history: DataFrame, members: DataFrame, cut: str, *, entity: str = "ticker",
                 period: str = "period_end", decision: str = "prediction_date",
                 carry: Sequence[str] = (), min_history: int = MIN_HISTORY,
                 max_silence: int = MAX_SILENCE_DAYS) -> tuple[DataFrame, DataFrame]:
    """(next period of each member, members skipped with a reason).

    The pending row sits one day after the cut so that it ranks behind all
    history; that day is a marker, not a forecast. The expected period is the
    last one plus the entity's usual step.
    """
    day = F.lit(cut).cast("date")
    order = F.struct(decision, period)
    last = F.max_by(F.struct(period, decision, *carry), order)
    known = history.groupBy(entity).agg(F.count(F.lit(1)).alias("n_history"), last.alias("_last"))
    steps = recent_step(history, entity=entity, period=period, decision=decision)
    state = (
        members.select(entity).distinct()
        .join(known, entity, "left").join(steps, entity, "left")
        .withColumn("silence_days", F.datediff(day, F.col(f"_last.{decision}"))))
    reason = (F.when(F.col("n_history").isNull(), "no history")
              .when(F.col("n_history") < min_history, f"fewer than {min_history} rows")
              .when(F.col("silence_days") > max_silence, f"silent more than {max_silence} days"))
    judged = state.withColumn("reason", reason)
    pending = judged.where(F.col("reason").isNull()).select(
        entity, F.date_add(F.col(f"_last.{period}"), F.col("quarter_gap_days")).alias(period),
        F.date_add(day, 1).alias(decision), *[F.col(f"_last.{c}").alias(c) for c in carry],
        F.col(f"_last.{period}").alias(f"last_known_{period}"),
        F.col(f"_last.{decision}").alias(f"last_known_{decision}"),
        F.col("quarter_gap_days").alias("quarter_gap_days_used"))
    skipped = judged.where(F.col("reason").isNotNull()).select(
        entity, "n_history", "silence_days", "reason")
    return pending, skipped


def pending_coverage(pending: DataFrame, skipped: DataFrame) -> DataFrame:
    """Predicted members out of those with any history."""
    made = pending.agg(F.count(F.lit(1)).alias("n_pending"))
    lost = skipped.agg(F.count(F.lit(1)).alias("n_skipped"),
                       F.count_if(F.col("reason") == "no history").alias("n_no_history"))
    return made.join(F.broadcast(lost)).select(
        "n_pending", "n_skipped", "n_no_history",
        (F.col("n_pending") + F.col("n_skipped") - F.col("n_no_history")).alias("n_eligible"))


def first_outcome(predictions: DataFrame, quarters: DataFrame, cut: str, *,
                  entity: str = "ticker", period: str = "period_end",
                  filed: str = "filed_date", decision: str = "prediction_date",
                  value: str = "eps_diluted", label: str = "label_yoy") -> DataFrame:
    """Each prediction with the first row its entity filed after the cut.

    The whole row is taken: a row with a missing part must not borrow it from
    the next one.
    """
    after = quarters.where(F.col(decision) > F.lit(cut).cast("date")).select(
        entity, F.col(period).alias("actual_period_end"),
        F.col(filed).alias("actual_filed_date"),
        F.col(decision).alias("actual_prediction_date"),
        F.col(value).alias("actual_value"), F.col(label).alias("actual_label"))
    first = first_row(after, entity, ["actual_filed_date", "actual_period_end"])
    return predictions.join(first, entity, "left")


def resolve_outcomes(predictions: DataFrame, quarters: DataFrame, cut: str, scored_at: str, *,
                     expected: str = "expected_period_end", deadline_days: int = MAX_LAG_DAYS,
                     **columns: str) -> DataFrame:
    """Status of every prediction under the fixed deadline.

    Lateness is judged on the filing's own decision date, so a row's fate does
    not depend on when this runs; only rows with no filing consult the clock.
    """
    matched = first_outcome(predictions, quarters, cut, **columns).withColumn(
        "resolution_deadline", F.date_add(F.col(expected), deadline_days))
    filed = F.col("actual_filed_date").isNotNull()
    in_time = filed & known_true(
        F.col("actual_prediction_date") <= F.col("resolution_deadline"))
    status = (F.when(in_time & F.col("actual_label").isNotNull(), SCORED)
              .when(in_time, NO_LABEL)
              .when(filed, LATE)
              .when(F.lit(scored_at).cast("date") > F.col("resolution_deadline"), NO_FILING)
              .otherwise(OUTSTANDING))
    return matched.withColumn("status", status)


def explain_resolution(resolved: DataFrame, prediction: str = "predicted_label") -> DataFrame:
    """Add ``correct`` on scored rows and the exclusion text on the others."""
    reason = F.lit("")
    for status, text in EXCLUSION_REASONS.items():
        reason = F.when(F.col("status") == status, text).otherwise(reason)
    return resolved.withColumn(
        "correct", F.when(F.col("status") == SCORED, F.col(prediction) == F.col("actual_label"))) \
        .withColumn("excluded_reason", reason)


def score_resolved(resolved: DataFrame, training_rate: float, *,
                   probability: str = "predicted_probability",
                   prediction: str = "predicted_label") -> DataFrame:
    """Tallies per status and the scored rows against the recorded constant.

    With every row excluded the metrics are null and the tallies stand.
    """
    y, p = F.col("actual_label"), F.col(probability)
    scored = F.col("status") == SCORED

    def on_scored(value: Column) -> Column:
        return F.avg(F.when(scored, value))

    tallies = [F.count(F.lit(1)).alias("n_predicted"), F.count_if(scored).alias("n_scored")]
    tallies += [F.count_if(F.col("status") == status).alias(f"n_{status}")
                for status in (NO_LABEL, LATE, NO_FILING, OUTSTANDING)]
    table = resolved.agg(
        *tallies,
        on_scored(y.cast("double")).alias("actual_positive_rate"),
        on_scored(log_loss_term(y, p)).alias("log_loss"),
        on_scored(log_loss_term(y, F.lit(training_rate))).alias("constant_log_loss"),
        on_scored((F.col(prediction) == y).cast("double")).alias("accuracy"),
        on_scored((y == 1).cast("double")).alias("constant_accuracy"),
        on_scored(brier_term(y, p)).alias("brier"),
        on_scored(F.col(prediction).cast("double")).alias("predicted_positive_rate"))
    return verdicts(table)


def membership_at_filing(resolved: DataFrame, intervals: DataFrame,
                         entity: str = "ticker") -> DataFrame:
    """How many scored rows were members when they filed; nothing is dropped."""
    scored = resolved.where(F.col("status") == SCORED)
    flagged = covered_at(scored, intervals, entity=entity, moment="actual_prediction_date",
                         out="member_at_filing")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.count_if("member_at_filing").alias("n_member"),
        F.count_if(~F.col("member_at_filing")).alias("n_not_member"))
