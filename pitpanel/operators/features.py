"""Leakage-safe lags and streaks in decision order.

One window per entity, ordered by decision date, serves every feature. Decision
dates are unique per entity (``gates.ties`` checks it), so an entity brings at
most one row per day to its task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitpanel.operators.knowledge import growth

STREAK_CAP = 8
EXPOSED_LAGS = (1, 2, 3, 4)

MODEL_FEATURES = (
    "eps_growth_yoy_lag_1", "eps_growth_yoy_lag_2", "eps_growth_yoy_lag_3",
    "eps_growth_yoy_lag_4", "label_lag_1", "label_lag_2", "label_lag_3", "label_lag_4",
    "growth_streak", "quarters_available",
)
RANKED_FEATURES = MODEL_FEATURES[:4]
# Columns that restate the outcome of their own row.
TARGET_IDENTITIES = ("eps_growth_yoy", "growth_acceleration")
FEATURE_COLUMNS = (
    "eps_growth_yoy", *RANKED_FEATURES, "growth_acceleration",
    *MODEL_FEATURES[4:8], "growth_streak", "quarters_available",
)
AUDIT_COLUMNS = tuple(f"prediction_date_lag_{k}" for k in EXPOSED_LAGS)


def decision_window(entity: str, decision: str, ties: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(decision, *ties)


def with_rank(df: DataFrame, entity: str = "ticker", decision: str = "prediction_date",
              out: str = "quarters_available") -> DataFrame:
    """Number of rows of the entity decided strictly before this one."""
    return df.withColumn(out, F.row_number().over(decision_window(entity, decision)) - 1)


def with_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int], *,
              entity: str = "ticker", decision: str = "prediction_date") -> DataFrame:
    """``<column>_lag_<k>``: the value k decisions earlier, with its source date."""
    order = decision_window(entity, decision)
    carried = [decision, *[name for name in columns if name != decision]]
    packed = df.withColumn("_row", F.struct(*carried))
    lagged = packed.select("*", *[F.lag("_row", k).over(order).alias(f"_lag_{k}") for k in lags])
    return lagged.select(
        *df.columns,
        *[F.col(f"_lag_{k}.{name}").alias(f"{name}_lag_{k}") for k in lags for name in carried])


def with_streak(df: DataFrame, label: str = "label_yoy", *, entity: str = "ticker",
                decision: str = "prediction_date", cap: int = STREAK_CAP,
                out: str = "growth_streak") -> DataFrame:
    """Consecutive prior rows with label 1, capped; a null label ends the run.

    The row's own label is never read: the frame stops one row before it.
    """
    order = decision_window(entity, decision)
    rank = F.row_number().over(order) - 1
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    broken = F.when(~F.coalesce(F.col(label) == 1, F.lit(False)), F.col("_rank"))
    return (
        df.withColumn("_rank", rank)
        .withColumn("_broken", F.coalesce(F.max(broken).over(prior), F.lit(-1)))
        .withColumn(out, F.least(F.lit(cap), F.col("_rank") - 1 - F.col("_broken")))
        .drop("_rank", "_broken")
    )


def build_features(panel: DataFrame, *, entity: str = "ticker", decision: str = "prediction_date",
                   value: str = "eps_diluted", base: str = "eps_year_ago_adjusted",
                   label: str = "label_yoy") -> DataFrame:
    """Panel columns, the twelve features, then the source dates of the lags."""
    panel_columns = panel.columns
    grown = panel.withColumn("eps_growth_yoy", growth(value, base))
    ranked = with_rank(grown, entity, decision)
    lagged = with_lags(ranked, [label, "eps_growth_yoy"], EXPOSED_LAGS,
                       entity=entity, decision=decision)
    streaked = with_streak(lagged, label, entity=entity, decision=decision)
    named = streaked
    for k in EXPOSED_LAGS:
        named = named.withColumnRenamed(f"{label}_lag_{k}", f"label_lag_{k}")
    named = named.withColumn(
        "growth_acceleration", F.col("eps_growth_yoy") - F.col("eps_growth_yoy_lag_1"))
    audit = [f"{decision}_lag_{k}" for k in EXPOSED_LAGS]
    return named.select(*panel_columns, *FEATURE_COLUMNS, *audit)
