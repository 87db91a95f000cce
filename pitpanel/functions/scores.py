"""Row-level score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: double machine epsilon, the clip applied to probabilities.
EPSILON = 2.220446049250313e-16


def log_loss_term(label: Column, probability: Column) -> Column:
    p = F.least(F.greatest(probability, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return -F.when(label == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))


def brier_term(label: Column, probability: Column) -> Column:
    return F.pow(probability - label.cast("double"), F.lit(2.0))


def decide(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= threshold).cast("int")
