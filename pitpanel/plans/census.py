"""Ever-member census: ids, coverage, flags, recovery by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators import entities, membership, profile, spans


@dataclass(frozen=True)
class Recovery:
    recovered: DataFrame
    decisions: DataFrame
    remaps: DataFrame


def run_census(events: DataFrame, current: DataFrame, overrides: DataFrame,
               current_map: DataFrame, facts: DataFrame, window_start: str,
               window_end: str) -> DataFrame:
    """First/last seen, id, fact coverage and flag of every ever-member."""
    seen = membership.first_last_seen(events, window_start, window_end, current=current)
    ids = entities.resolve_for_census(seen, overrides=overrides, current_map=current_map)
    census = profile.coverage_census(seen.join(ids, "ticker"), facts)
    return profile.with_coverage_flag(census)


def run_recovery(census: DataFrame, names: DataFrame, registry: DataFrame, facts: DataFrame,
                 position: str | None = None, open_end: str = "2025-12-31") -> Recovery:
    """Name recovery, overlap decisions for ambiguous names, remap proposals."""
    ranges = spans.fact_ranges(facts)
    recovered = entities.recover_missing(census, names, registry, ranges, position=position)
    ambiguous = recovered.where(F.col("match_kind") == "exact_ambiguous").select(
        "ticker", "norm", F.col("first_seen_in_index").alias("tenure_start"),
        F.col("last_seen_in_index").alias("tenure_end"))
    decisions = spans.choose_by_overlap(
        ambiguous, entities.name_candidates(registry, position=position), ranges,
        open_end=open_end)
    remaps = entities.propose_remaps(census, names, registry, ranges, position=position)
    return Recovery(recovered, decisions, remaps)


def spanned_facts(tickers: DataFrame, facts: DataFrame, *, id_spans: DataFrame,
                  overrides: DataFrame, recovered: DataFrame,
                  current_map: DataFrame) -> DataFrame:
    """Every ticker's facts under its resolved ids, with the route and span text."""
    resolved = entities.resolve_ids(tickers, spans=id_spans, overrides=overrides,
                                    recovered=recovered, current_map=current_map)
    usable = resolved.where(F.col("cik").isNotNull())
    text = spans.describe_spans(usable)
    return spans.facts_in_spans(facts, usable).join(text, "ticker")


def unresolved(tickers: DataFrame, facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Tickers without an id, and tickers whose ids have no facts."""
    without_id = resolved.where(F.col("cik").isNull()).select(
        "ticker", F.lit("no_cik_from_any_source").alias("reason"))
    barren = resolved.where(F.col("cik").isNotNull()).select("ticker").distinct() \
        .join(facts.select("ticker").distinct(), "ticker", "left_anti") \
        .select("ticker", F.lit("no_eps_facts").alias("reason"))
    return without_id.unionByName(barren).join(
        tickers.select("ticker").distinct(), "ticker", "left_semi")
