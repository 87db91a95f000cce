"""The membership change log, from whatever header its source gave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.contracts import ContractError
from pitpanel.functions.dates import parse_date


def flatten_header(levels: list[tuple[str, ...]]) -> list[str]:
    """Two-level headers as ``level1_level2`` in lower case."""
    return ["_".join(str(part) for part in level).lower() for level in levels]


def pick_column(columns: list[str], *needles: str) -> str:
    """The first column whose lower-case name contains every needle."""
    for column in columns:
        if all(needle in column.lower() for needle in needles):
            return column
    raise ContractError(f"no column matching {needles} in {columns}")


def _symbol_or_null(name: str) -> Column:
    text = F.trim(F.col(f"`{name}`").cast("string"))
    return F.when(~text.isin("", "nan"), text)


def normalise_changes(raw: DataFrame, *, keep_undated: bool = False) -> DataFrame:
    """(date, added, removed); unparsable dates are null and dropped unless kept."""
    names = raw.columns
    tidy = raw.select(
        parse_date(F.col(f"`{pick_column(names, 'date')}`").cast("string")).alias("date"),
        _symbol_or_null(pick_column(names, "added", "ticker")).alias("added"),
        _symbol_or_null(pick_column(names, "removed", "ticker")).alias("removed"))
    return tidy if keep_undated else tidy.where(F.col("date").isNotNull())
