"""Column contracts and the table schemas of the data model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table lacks a required column or carries a forbidden one."""


class GateError(AssertionError):
    """A data-quality gate found violating rows."""


def require_columns(df: DataFrame, columns: Iterable[str], table: str = "table") -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ContractError(f"{table}: missing columns {missing}")
    return df


def forbid_columns(df: DataFrame, columns: Iterable[str], table: str = "table") -> DataFrame:
    present = [name for name in columns if name in df.columns]
    if present:
        raise ContractError(f"{table}: forbidden columns {present}")
    return df


def nan_to_null(column: str | Column) -> Column:
    """Spark orders NaN above every number, so missing doubles must be null."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(value.cast("double")), value)


def known_true(condition: Column) -> Column:
    """Three-valued condition -> boolean, with unknown counted as false."""
    return F.coalesce(condition, F.lit(False))


RAW_FACTS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("cik", T.StringType()),
    T.StructField("start", T.DateType()),
    T.StructField("end", T.DateType()),
    T.StructField("filed", T.DateType()),
    T.StructField("val", T.DoubleType()),
    T.StructField("accn", T.StringType()),
    T.StructField("fy", T.IntegerType()),
    T.StructField("fp", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("frame", T.StringType()),
])

CHANGE_LOG = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("added", T.StringType()),
    T.StructField("removed", T.StringType()),
])

CURRENT_MEMBERS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date_added", T.DateType()),
])

INTERVALS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("start", T.DateType()),
    T.StructField("end", T.DateType()),
])

ID_SPANS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("cik", T.StringType()),
    T.StructField("valid_from", T.DateType()),
    T.StructField("valid_to", T.DateType()),
])

RECOVERED_IDS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("match_kind", T.StringType()),
    T.StructField("resolution_rule", T.StringType()),
    T.StructField("recovered_cik", T.StringType()),
    T.StructField("n_eps_records", T.DoubleType()),
    T.StructField("earliest_period_end", T.DateType()),
])

_FACT = T.StructType([
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("filed", T.StringType()),
    T.StructField("val", T.DoubleType()),
    T.StructField("accn", T.StringType()),
    T.StructField("fy", T.IntegerType()),
    T.StructField("fp", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("frame", T.StringType()),
])

UNITS = T.MapType(T.StringType(), T.ArrayType(_FACT))

NESTED_PAYLOAD = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("units", UNITS),
])

BULK_PAYLOAD = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("units", UNITS),
    ])))),
])

PANEL_COLUMNS = (
    "ticker", "cik", "cik_span_used", "period_end", "filed_date", "prediction_date",
    "eps_diluted", "n_filings_seen", "label_yoy", "in_index_at_prediction",
    "is_removed_name", "period_end_year_ago", "prediction_date_year_ago",
    "eps_year_ago", "split_factor_applied", "eps_year_ago_adjusted",
    "split_ambiguous", "split_contaminated", "filing_lag_days",
)
