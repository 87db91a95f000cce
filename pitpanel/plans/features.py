"""Panel -> verified feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pitpanel.operators import gates
from pitpanel.operators.features import FEATURE_COLUMNS, build_features
from pitpanel.sources.tables import write_verified

FLOAT_FEATURES = [name for name in FEATURE_COLUMNS if "growth" in name and name != "growth_streak"]


def check_preconditions(panel: DataFrame) -> None:
    """No missing decision date and no tie: otherwise order is undefined."""
    gates.enforce(gates.nulls_in(panel, ["prediction_date"]), "missing decision date")
    gates.enforce(gates.ties(panel), "tied decision dates")


def verify_features(built: DataFrame, panel: DataFrame) -> None:
    keys = ["ticker", "period_end"]
    gates.enforce(gates.row_count_gap(built, panel), "row count")
    gates.enforce(gates.duplicate_keys(built, keys), "duplicate key")
    gates.enforce(gates.altered_rows(built, panel, keys, ["eps_diluted", "label_yoy"]),
                  "panel rows altered")
    gates.enforce(gates.lag_leaks(built), "lag leakage")
    gates.enforce(gates.impossible_history(built), "impossible history")
    gates.enforce(gates.infinite_values(built, FLOAT_FEATURES), "infinite feature")


def build_verified(panel: DataFrame, path: str, replace: bool = False) -> DataFrame:
    """Check, build, fire-test, verify, write, and check what was written."""
    check_preconditions(panel)
    built = build_features(panel)
    gates.enforce(gates.fire_test_failures(gates.fire_test(built)), "fire test")
    verify_features(built, panel)
    return write_verified(built, path, gates.lag_leaks, "lag leakage", replace)
