"""Predict the next unfiled period, and later resolve and score it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.contracts import require_columns
from pitpanel.operators import evaluate, forward, gates, ml
from pitpanel.operators.asof import gate_on_intervals, year_ago_match
from pitpanel.operators.features import MODEL_FEATURES, RANKED_FEATURES, build_features
from pitpanel.operators.knowledge import split_by_lag, with_decision_date
from pitpanel.operators.membership import members_at
from pitpanel.plans.panel import Known, known_facts, label_quarters
from pitpanel.plans.walkforward import forbid_outcomes
from pitpanel.session import settle
from pitpanel.sources import runs

KEYS = ("ticker", "period_end")
FACT_COLUMNS = ("ticker", "period_end", "filed_date", "prediction_date", "eps_diluted",
                "n_filings_seen", "filing_lag_days")
# What a prediction says of whom it is about and what its row was made of.
IDENTITY = ("cik",)
PENDING_BASIS = ("last_known_period_end", "last_known_prediction_date", "quarter_gap_days_used")


@dataclass(frozen=True)
class History:
    history: DataFrame
    fresh: DataFrame
    withheld: DataFrame


def extend_history(facts: DataFrame, panel: DataFrame, cut: str, study_start: str, *,
                   intervals: DataFrame | None = None,
                   ties: Sequence[str] = ("accn",), known: Known | None = None) -> History:
    """Panel plus rows that became knowable by the cut, under the panel's rules.

    Panel rows are only looked up, never rebuilt. Filings after the cut are
    withheld, but kept so that the outcome gate can see them.
    """
    known = known or known_facts(facts, ties)
    kept, _ = split_by_lag(known.first)
    unseen = with_decision_date(kept).join(panel.select(*KEYS), list(KEYS), "left_anti")
    fresh, withheld = forward.split_at_cut(unseen, cut)
    carried = [c for c in (*FACT_COLUMNS, *IDENTITY)
               if c in panel.columns and c in fresh.columns]
    # Panel and fresh rows share no key, so one table holds both and is matched with itself.
    both = fresh.withColumn("_is_fresh", F.lit(True)).unionByName(
        panel.select(*carried), allowMissingColumns=True)
    matched = year_ago_match(both).where(
        F.col("_is_fresh") & (F.col("period_end") >= F.lit(study_start).cast("date"))) \
        .drop("_is_fresh")
    labelled = label_quarters(matched, known.events)
    if intervals is not None:
        labelled, _ = gate_on_intervals(labelled, intervals)
    added = labelled.select(*[c for c in panel.columns if c in labelled.columns])
    return History(panel.unionByName(added, allowMissingColumns=True), added, withheld)


def forward_features(history: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features of pending rows, features of history), from one ranked table.

    Pending rows are told apart by their marker column, not by a date.
    """
    extras = [c for c in pending.columns if c not in history.columns]
    frame = history.unionByName(pending, allowMissingColumns=True)
    built = build_features(frame)
    marker = F.col("quarter_gap_days_used")
    return built.where(marker.isNotNull()), built.where(marker.isNull()).drop(*extras)


def training_rows(history_features: DataFrame, cut: str) -> DataFrame:
    """Labelled history decided by the cut: what the refit may learn from."""
    return history_features.where(
        F.col("label_yoy").isNotNull() & (F.col("prediction_date") <= F.lit(cut).cast("date")))


def predict_pending(pending_features: DataFrame, history_features: DataFrame, cut: str, *,
                    features: Sequence[str] = MODEL_FEATURES,
                    ranked: Sequence[str] = RANKED_FEATURES, threshold: float = 0.5,
                    c: float = 1.0) -> DataFrame:
    """Refit on labelled history up to the cut and score the pending rows.

    The features ride along untransformed, beside what the pending row was made
    of, so a prediction can be audited without its inputs.
    """
    raw = {f: f"given_{f}" for f in features}
    made_of = [n for n in (*IDENTITY, *PENDING_BASIS) if n in pending_features.columns]
    keep = ["ticker", "period_end", "prediction_date"]
    train = training_rows(history_features, cut)
    columns = [*keep, "label_yoy", *features]
    pending = pending_features.select(
        *columns, *[n for n in made_of if n not in columns],
        *[F.col(f).alias(given) for f, given in raw.items()]).withColumn("role", F.lit("predict"))
    rows = pending.unionByName(train.select(*columns).withColumn("role", F.lit("train")),
                               allowMissingColumns=True).withColumn("fold", F.lit(1))
    scored, _ = ml.logistic_by_fold(rows, features, ranked=ranked,
                                    keep=[*keep, *made_of, *raw.values()],
                                    scored_role="predict", threshold=threshold, c=c)
    return scored.select(
        F.lit(cut).cast("date").alias("cut_date"), "ticker",
        *[n for n in IDENTITY if n in made_of],
        F.col("period_end").alias("expected_period_end"),
        *[n for n in PENDING_BASIS if n in made_of],
        F.col("probability").alias("predicted_probability"),
        F.col("prediction").alias("predicted_label"),
        *[F.col(given).alias(f) for f, given in raw.items()])


@dataclass(frozen=True)
class ForwardRun:
    predictions: DataFrame
    training: DataFrame


def run_forward(facts: DataFrame, panel: DataFrame, intervals: DataFrame, cut: str,
                study_start: str, *, gate: bool = True, threshold: float = 0.5,
                c: float = 1.0) -> DataFrame:
    """Predictions for every member's next period, refused if any is resolvable."""
    return forward_run(facts, panel, intervals, cut, study_start, gate=gate,
                       threshold=threshold, c=c).predictions


def forward_run(facts: DataFrame, panel: DataFrame, intervals: DataFrame, cut: str,
                study_start: str, *, gate: bool = True, threshold: float = 0.5, c: float = 1.0,
                ties: Sequence[str] = ("accn",), carry: Sequence[str] = ()) -> ForwardRun:
    """:func:`run_forward` with the rows the refit learned from."""
    extended = extend_history(facts, panel, cut, study_start,
                              intervals=intervals if gate else None, ties=ties)
    extended = replace(extended, history=settle(extended.history))
    members = members_at(intervals, cut)
    known = [*carry, *[c for c in IDENTITY if c in extended.history.columns and c not in carry]]
    pending, skipped = forward.pending_rows(extended.history, members, cut, carry=known)
    gates.enforce(gates.below_floor(forward.pending_coverage(pending, skipped),
                                    "n_pending", "n_eligible", 0.5), "coverage floor")
    built, history_features = forward_features(extended.history, pending)
    gates.enforce(gates.lag_leaks(built), "lag leakage")
    gates.enforce(gates.resolvable_rows(built, extended.history, extended.withheld),
                  "resolvable outcome")
    return ForwardRun(
        predict_pending(built, history_features, cut, threshold=threshold, c=c),
        training_rows(history_features, cut))


def training_summary(training: DataFrame) -> dict[str, str]:
    """How many rows the refit learned from, and their rate of positive labels."""
    row = training.agg(F.count(F.lit(1)).alias("n"),
                       F.avg(F.col("label_yoy").cast("double")).alias("rate")).first()
    return {"training_rows_labelled": str(row.n),
            "training_positive_rate": "" if row.rate is None else f"{row.rate:.6f}"}


def write_forward(facts: DataFrame, panel: DataFrame, intervals: DataFrame, cut: str,
                  study_start: str, root: str, protocol: dict, code: dict[str, str],
                  **options) -> str:
    """Predict, and commit the predictions with their provenance under the cut's name.

    ``code`` says what code ran: ``code_sha`` and ``working_tree_clean``. A cut that
    has been committed is refused before any work, and an input that changed while
    the run went on before it is marked.
    """
    spark = panel.sparkSession
    runs.refuse_taken(spark, root, cut)
    before = runs.digest_text(panel)
    threshold = protocol["model"]["decision_threshold"]
    made = forward_run(facts, panel, intervals, cut, study_start, threshold=threshold,
                       c=protocol["model"]["estimator"]["params"]["C"], **options)
    made = ForwardRun(settle(forbid_outcomes(made.predictions)), made.training)
    provenance = {
        "cut_date": cut, **code, "config": f"revision {protocol['revision']}",
        "model": protocol["model"]["variant_name"], "decision_threshold": str(threshold),
        "panel_sha256": before, "training_window": f"prediction_date <= {cut}",
        **training_summary(made.training)}
    return runs.commit_run(made.predictions, provenance, root, cut,
                           inputs={"the panel": (panel, before)})


@dataclass(frozen=True)
class ForwardScore:
    resolved: DataFrame
    scores: DataFrame
    calibration: DataFrame


def score_committed(spark: SparkSession, root: str, cut: str, facts: DataFrame,
                    panel: DataFrame, protocol: dict, scored_at: str, recorded_at: str,
                    study_start: str, *, ties: Sequence[str] = ("accn",),
                    write: bool = True) -> ForwardScore:
    """Score a committed run against what has been filed since.

    Refused are runs without their provenance, with outcomes in them, with a ticker
    twice, or made from another panel or protocol than the present ones.
    """
    predictions, provenance = runs.load_run(spark, root, cut)
    predictions = require_columns(
        forbid_outcomes(predictions),
        ["ticker", "expected_period_end", "predicted_probability", "predicted_label"],
        f"run {cut}")
    gates.enforce(gates.duplicate_keys(predictions, ["ticker"]), "one prediction per ticker")
    runs.check_unmoved(provenance, {
        "cut_date": cut, "config": f"revision {protocol['revision']}",
        "panel_sha256": runs.digest_text(panel)})
    resolved, scores = score_forward(
        predictions, facts, panel, cut, scored_at, recorded_at, study_start,
        float(provenance["training_positive_rate"]), ties=ties)
    resolved = settle(resolved)
    calibration = evaluate.calibration_table(
        resolved.where(F.col("status") == forward.SCORED), label="actual_label",
        probability="predicted_probability")
    if write:
        header = {"cut_date": cut, "scored_at": scored_at, "recorded_at": recorded_at,
                  "panel_sha256": provenance["panel_sha256"]}
        for name, table in (("resolved", resolved), ("scores", scores),
                            ("calibration", calibration)):
            runs.commit_run(table, header, f"{root}/{cut}/scored-{scored_at}", name,
                            required=tuple(header))
    return ForwardScore(resolved, scores, calibration)


def rebuild_quarters(facts: DataFrame, panel: DataFrame, study_start: str,
                     ties: Sequence[str] = ("accn",), known: Known | None = None) -> DataFrame:
    """Labelled quarters for scoring; a quarter the panel holds stays the panel's."""
    known = known or known_facts(facts, ties)
    kept, _ = split_by_lag(known.first)
    carried = [c for c in FACT_COLUMNS if c in panel.columns]
    combined = forward.prefer_first(
        panel.select(*carried), with_decision_date(kept).select(*carried), KEYS)
    matched = year_ago_match(combined).where(
        F.col("period_end") >= F.lit(study_start).cast("date"))
    return label_quarters(matched, known.events)


def score_forward(predictions: DataFrame, facts: DataFrame, panel: DataFrame, cut: str,
                  scored_at: str, recorded_at: str, study_start: str,
                  training_rate: float,
                  ties: Sequence[str] = ("accn",)) -> tuple[DataFrame, DataFrame]:
    """(resolved rows, scores); refuses while a row waits or was recorded late."""
    quarters = rebuild_quarters(facts, panel, study_start, ties)
    resolved = forward.resolve_outcomes(predictions, quarters, cut, scored_at)
    gates.enforce(gates.outstanding_rows(resolved), "outstanding predictions")
    gates.enforce(gates.recorded_too_late(resolved, recorded_at), "recorded after the outcome")
    return (forward.explain_resolution(resolved),
            forward.score_resolved(resolved, training_rate))
