"""What was known, and when: first filings, lags, windows, labels.

A fact table repeats one (entity, period) once per filing. These operators
reduce it to what the first filing said and derive the decision moment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.contracts import known_true, nan_to_null

QUARTER_DAYS = (60, 110)
MAX_LAG_DAYS = 120


def quarterly_facts(facts: DataFrame, start: str = "start", end: str = "end",
                    days: tuple[int, int] = QUARTER_DAYS) -> DataFrame:
    """Keep facts whose duration is about a quarter, both bounds inclusive."""
    return facts.where(F.datediff(end, start).between(*days))


def with_lag_days(facts: DataFrame, filed: str = "filed_date", period: str = "period_end",
                  out: str = "filing_lag_days") -> DataFrame:
    return facts.withColumn(out, F.datediff(filed, period))


def filing_order(filed: str, ties: Sequence[str] = ()) -> Column:
    """Ascending filing order; facts without a filing date come last."""
    return F.struct(F.col(filed).isNull().alias("undated"), F.col(filed).alias("filed"),
                    *[F.col(name) for name in ties])


def first_known(facts: DataFrame, keys: Sequence[str] = ("ticker", "period_end"),
                filed: str = "filed_date", ties: Sequence[str] = ("accn",),
                count: str = "n_filings_seen", mode: str = "row") -> DataFrame:
    """One row per key: the earliest filing, plus how many filings were seen.

    ``mode='row'`` keeps the earliest row whole. ``mode='column'`` takes each
    column from the earliest filing that has it. Both are single aggregations
    with map-side partials, so a hot key never sits in one task.
    """
    if mode not in ("row", "column"):
        raise ValueError(f"mode must be 'row' or 'column', not {mode!r}")
    keyed = facts.where(_all_present(keys))
    rest = [name for name in facts.columns if name not in keys]
    order = filing_order(filed, ties)
    if mode == "row":
        picked = keyed.groupBy(*keys).agg(
            F.min_by(F.struct(*rest), order).alias("first"), F.count(F.lit(1)).alias(count))
        return picked.select(*keys, "first.*", count)
    picks = [
        F.min_by(F.col(name), F.when(F.col(name).isNotNull(), order)).alias(name)
        for name in rest
    ]
    return keyed.groupBy(*keys).agg(*picks, F.count(F.lit(1)).alias(count))


def first_row(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole row per key under ``order`` (nulls last, as a sort puts them)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [name for name in df.columns if name not in keys]
    ordering = F.struct(*[
        part for name in order
        for part in (F.col(name).isNull().alias(f"{name}_missing"), F.col(name))
    ])
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("first"))
            .select(*keys, "first.*"))


def split_by_lag(df: DataFrame, max_days: int = MAX_LAG_DAYS,
                 lag: str = "filing_lag_days") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason). An unknown lag is kept."""
    late = known_true(F.col(lag) > max_days)
    rejected = df.where(late).withColumn("reason", F.lit(f"{lag} > {max_days}"))
    return df.where(~late), rejected


def with_window_bucket(df: DataFrame, start: str, end: str | None = None,
                       period: str = "period_end", out: str = "window_bucket") -> DataFrame:
    """``before`` / ``inside`` / ``after`` the study window, both ends inside.

    Apply it after the year-ago match: rows before the window still serve as
    year-ago lookups for rows inside it.
    """
    bucket = F.when(F.col(period) < F.lit(start).cast("date"), F.lit("before"))
    if end is not None:
        bucket = bucket.when(F.col(period) > F.lit(end).cast("date"), F.lit("after"))
    return df.withColumn(out, bucket.otherwise(F.lit("inside")))


def split_by_window(df: DataFrame, start: str, end: str | None = None,
                    period: str = "period_end") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inside, before with reason, after with reason)."""
    tagged = with_window_bucket(df, start, end, period)

    def part(name: str) -> DataFrame:
        return tagged.where(F.col("window_bucket") == name).drop("window_bucket")

    return (part("inside"),
            part("before").withColumn("reason", F.lit(f"{period} < window start ({start})")),
            part("after").withColumn("reason", F.lit("after_study_window")))


def with_decision_date(df: DataFrame, filed: str = "filed_date",
                       out: str = "prediction_date") -> DataFrame:
    """The first day on which the filed number can be acted upon."""
    return df.withColumn(out, F.date_add(filed, 1))


def with_label(df: DataFrame, value: str = "eps_diluted", base: str = "eps_year_ago_adjusted",
               ambiguous: str | None = "split_ambiguous", out: str = "label_yoy") -> DataFrame:
    """1 when the value is strictly above its base, 0 otherwise, null if undecidable.

    A missing value gives null as well: nothing was compared. NaN is missing.
    """
    current, before = nan_to_null(value), nan_to_null(base)
    usable = before.isNotNull() & current.isNotNull()
    if ambiguous is not None:
        usable = usable & ~F.coalesce(F.col(ambiguous), F.lit(False))
    return df.withColumn(out, F.when(usable, (current > before).cast("int")))


def growth(value: str | Column, base: str | Column) -> Column:
    """(value - base) / |base|; null, never infinite, on a zero or missing base.

    NaN is missing, on either side.
    """
    v, b = nan_to_null(value), nan_to_null(base)
    return F.when(b != 0, (v - b) / F.abs(b))


def growth_census(df: DataFrame, base: str = "eps_year_ago_adjusted",
                  growth_col: str = "eps_growth_yoy") -> DataFrame:
    """How many growth values exist, and why the others do not."""
    return df.agg(
        F.count(growth_col).alias("n_computed"),
        F.count_if(F.col(base).isNull()).alias("n_no_base"),
        F.count_if(F.col(base) == 0).alias("n_zero_base"),
    )


def lock_holdout(df: DataFrame, boundary: str, decision: str = "prediction_date") -> DataFrame:
    """Drop everything at or after the boundary before anything else reads it."""
    return df.where(~known_true(F.col(decision) >= F.lit(boundary).cast("date")))


def labelled_rows(df: DataFrame, label: str = "label_yoy") -> DataFrame:
    """Rows with a label; rows with missing features are kept."""
    return df.where(F.col(label).isNotNull())


def any_missing(columns: Sequence[str]) -> Column:
    condition = F.lit(False)
    for name in columns:
        condition = condition | F.col(name).isNull()
    return condition


def reject_log(*rejected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every dropped row of every step, with its reason."""
    parts = [part.select(*columns, "reason") for part in rejected]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part, allowMissingColumns=True)
    return log


def _all_present(columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition
