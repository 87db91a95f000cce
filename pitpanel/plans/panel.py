"""Facts -> point-in-time panel with label, gate and reject log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators import gates
from pitpanel.operators.asof import gate_on_intervals, year_ago_match
from pitpanel.operators.knowledge import (
    MAX_LAG_DAYS, first_known, reject_log, split_by_lag, split_by_window, with_decision_date,
    with_label,
)
from pitpanel.operators.restatements import adjust_year_ago, detect_unit_changes

LOG_COLUMNS = ("ticker", "period_end", "filed_date", "filing_lag_days")


@dataclass(frozen=True)
class PanelResult:
    panel: DataFrame
    rejected: DataFrame
    events: DataFrame


@dataclass(frozen=True)
class Known:
    """What every table over the same facts starts from: first filings, unit changes."""

    first: DataFrame
    events: DataFrame


def known_facts(facts: DataFrame, ties: Sequence[str] = ("accn",)) -> Known:
    return Known(first_known(facts, ties=ties), detect_unit_changes(facts, ties=ties))


def label_quarters(matched: DataFrame, events: DataFrame) -> DataFrame:
    """Decision dates, unit adjustment and label of year-ago matched rows."""
    dated = with_decision_date(
        with_decision_date(matched), "filed_date_year_ago", "prediction_date_year_ago")
    return with_label(adjust_year_ago(dated, events))


def build_panel(facts: DataFrame, study_start: str, study_end: str, *,
                intervals: DataFrame | None = None, metadata: DataFrame | None = None,
                ties: Sequence[str] = ("accn",), max_lag_days: int = MAX_LAG_DAYS,
                columns: Sequence[str] | None = None,
                known: Known | None = None) -> PanelResult:
    """First filings, lag cap, year-ago match, window, adjustment, label, gate.

    ``known`` is what :func:`known_facts` made of the facts, where it's at hand.

    The match precedes the window trim, so a row before the window can still be
    the year-ago base of a row inside it. Without intervals no gate applies.
    """
    known = known or known_facts(facts, ties)
    kept, late_filed = split_by_lag(known.first, max_lag_days)
    inside, before, after = split_by_window(year_ago_match(kept), study_start, study_end)
    labelled = label_quarters(inside, known.events)
    rejects = [late_filed, before, after]
    if intervals is not None:
        labelled, outside = gate_on_intervals(labelled, intervals)
        rejects.append(outside)
    if metadata is not None:
        flags = metadata.select("ticker", "is_removed_name")
        labelled = labelled.join(flags, "ticker", "left").withColumn(
            "is_removed_name", F.coalesce("is_removed_name", F.lit(False)))
    panel = labelled.select(*columns) if columns else labelled.drop("filed_date_year_ago")
    return PanelResult(panel, reject_log(*rejects, columns=LOG_COLUMNS), known.events)


def panel_violations(panel: DataFrame, study_start: str, study_end: str, *,
                     max_lag_days: int = MAX_LAG_DAYS,
                     gated: bool = True) -> dict[str, DataFrame]:
    """Every invariant of the panel, by name, as violating rows."""
    checks = {
        "duplicate key": gates.duplicate_keys(panel, ["ticker", "period_end"]),
        "decision not after period": gates.not_after(panel),
        "missing filing date": gates.nulls_in(panel, ["filed_date"]),
        "decision is not the day after filing": gates.wrong_offset(panel),
        "filing lag over the cap": gates.above(panel, "filing_lag_days", max_lag_days),
        "outside the study window": gates.outside_window(panel, study_start, study_end),
    }
    if gated:
        checks["not a member at decision"] = gates.flag_not_set(panel)
    return checks


def verify_panel(panel: DataFrame, study_start: str, study_end: str, **options) -> None:
    for name, violations in panel_violations(panel, study_start, study_end, **options).items():
        gates.enforce(violations, name)
