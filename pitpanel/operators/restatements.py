"""Unit changes inferred from restatements, and the adjustment they imply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.knowledge import filing_order

EQUAL_WITHIN = 1e-9


def restatement_evidence(facts: DataFrame, *, entity: str = "ticker", period: str = "period_end",
                         filed: str = "filed_date", value: str = "eps_diluted",
                         ties: Sequence[str] = ("accn",), min_magnitude: float = 0.01,
                         min_factor: int = 2, ratio_tolerance: float = 0.02) -> DataFrame:
    """Later values that are the original divided by almost exactly an integer.

    Facts are first reduced to one row per (entity, period, value) with its
    earliest filing, which keeps every bound the evidence can give.
    """
    keyed = facts.where(F.abs(value) > min_magnitude)
    # Both readers of `values` need `_order`, so they share one shuffle.
    values = keyed.groupBy(entity, period, value).agg(
        F.min(filing_order(filed, ties)).alias("_order"))
    originals = values.groupBy(entity, period).agg(
        F.min_by(value, "_order").alias("original"),
        F.min("_order").getField("filed").alias("original_filed"))
    ratio = F.col("original") / F.col(value)
    factor = F.rint(ratio)
    return (
        values.withColumn("later_filed", F.col("_order.filed"))
        .join(originals, [entity, period])
        .where(F.abs(F.col(value) - F.col("original")) > EQUAL_WITHIN)
        .withColumn("factor", factor)
        .where((F.col("factor") >= min_factor)
               & (F.abs(ratio - F.col("factor")) / F.col("factor") <= ratio_tolerance))
        .select(entity, period, "original", F.col(value).alias("later"),
                F.col("factor").cast("long").alias("factor"), "original_filed", "later_filed")
    )


def detect_unit_changes(facts: DataFrame, *, entity: str = "ticker", **options) -> DataFrame:
    """(entity, factor) events, each bounded by filings before and after it.

    ``established`` is false when the bounds cross, i.e. the evidence
    contradicts itself.
    """
    events = restatement_evidence(facts, entity=entity, **options).groupBy(entity, "factor").agg(
        F.max("original_filed").alias("window_start"),
        F.min("later_filed").alias("window_end"))
    return events.withColumn("established", F.col("window_start") < F.col("window_end"))


def adjust_year_ago(panel: DataFrame, events: DataFrame, *, entity: str = "ticker",
                    period: str = "period_end", filed: str = "filed_date",
                    value: str = "eps_year_ago") -> DataFrame:
    """Restate the year-ago value in current units; the current value is untouched.

    An event between the two filings multiplies the factor, an event that
    leaves both on one side does nothing, and anything else -- a filing inside
    the event's window, or an event that was never established -- makes the row
    ambiguous.
    """
    then, now = F.col(f"{filed}_year_ago"), F.col(filed)
    matched = F.col(f"{period}_year_ago").isNotNull()

    def judged(event: Column) -> tuple[Column, Column]:
        """(the event multiplies the factor, it leaves no doubt)"""
        start, end, sided = event["window_start"], event["window_end"], event["established"]
        intervenes = (then <= start) & (now >= end)
        same_side = ((then <= start) & (now <= start)) | ((then >= end) & (now >= end))
        return sided & intervenes, F.coalesce(sided & (intervenes | same_side), F.lit(False))

    # An entity's few events come as one row, so no row of the panel is multiplied or
    # folded back, and the join keeps the panel's partitioning by entity.
    packed = events.where(F.col("factor").isNotNull()).groupBy(entity).agg(F.collect_list(
        F.struct("factor", "window_start", "window_end", "established")).alias("_events"))
    applied = F.aggregate("_events", F.lit(1.0), lambda product, event: F.when(
        judged(event)[0], product * event["factor"]).otherwise(product))
    doubtful = F.exists("_events", lambda event: ~judged(event)[1])
    return (
        panel.join(packed, entity, "left").select(
            *panel.columns,
            F.when(matched & F.col("_events").isNotNull(), applied.cast("long"))
            .otherwise(F.lit(1).cast("long")).alias("split_factor_applied"),
            F.coalesce(matched & doubtful, F.lit(False)).alias("split_ambiguous"))
        .withColumn(f"{value}_adjusted", F.col(value) / F.col("split_factor_applied"))
        .withColumn("split_contaminated",
                    (F.col("split_factor_applied") > 1) | F.col("split_ambiguous"))
    )
