"""As-of matching and interval gating on day-grain time axes.

Both operators reduce each side to one row per (key, day) before the window
sorts a key, so the rows one task can receive for a hot key are bounded by the
days its history spans and not by how often a day repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.contracts import known_true

DIRECTIONS = ("nearest", "backward", "forward")


def asof_match(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_on: str,
               right_on: str, payload: Sequence[str] = (), right_order: Sequence[str] = (),
               tolerance_days: int | None = None, direction: str = "nearest",
               left_unique: bool = False, right_unique: bool = False) -> DataFrame:
    """Left join each left row to one right row of its key, by date proximity.

    Adds ``right_on`` and ``payload`` from the matched row (null when there is
    none). The tolerance is inclusive, an equally near pair resolves to the
    earlier row, and of several right rows on one day the last under
    ``right_order`` is taken.

    ``left_unique=True`` promises one left row per (key, left_on); the left row
    then travels through the window itself and no join back is needed.
    ``right_unique=True`` promises the same of the right side and saves its
    reduction to one row per day.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    by = list(by)
    payload = [name for name in payload if name != right_on]
    found = F.struct(F.col(right_on), *[F.col(name) for name in payload])

    dated = right.where(F.col(right_on).isNotNull())
    if right_order:
        order = F.struct(*[F.col(name) for name in right_order])
    else:
        order = found
    if right_unique:
        candidates = dated.select(*by, F.col(right_on).alias("_day"), found.alias("_found"))
    else:
        candidates = dated.groupBy(*by, F.col(right_on).alias("_day")).agg(
            F.max_by(found, order).alias("_found"))

    if left_unique:
        probes = left.select(*by, F.col(left_on).alias("_day"),
                             F.struct(*left.columns).alias("_left"))
    else:
        probes = left.select(*by, F.col(left_on).alias("_day")).distinct()
    timeline = (
        candidates.withColumn("_is_probe", F.lit(0))
        .unionByName(probes.withColumn("_is_probe", F.lit(1)), allowMissingColumns=True)
    )
    matched = _matched(timeline, by, right_on, tolerance_days, direction)
    added = [F.col(f"_match.{name}").alias(name) for name in (right_on, *payload)]
    if left_unique:
        return matched.select(*_carried(left.columns, by), *added)
    lookup = matched.select(*by, F.col("_day").alias(left_on), "_match")
    return (left.join(lookup, [*by, left_on], "left")
            .select(*left.columns, *added))


def asof_self_match(df: DataFrame, *, by: Sequence[str], day: str,
                    payload: dict[str, str], target: Column | None = None,
                    back_days: int | None = None, tolerance_days: int | None = None,
                    direction: str = "nearest") -> DataFrame:
    """``asof_match`` of a table with itself, reading it once.

    The table has one row per (key, day). Each row enters the timeline twice,
    as a candidate on its day and as a probe on its target day. ``payload``
    maps the columns taken from the matched row, ``day`` included, to their
    new names.

    ``back_days`` states that the target is that many days before the row's own
    day. With a tolerance the rows within reach are then a range of days, and one
    window over the rows as they are finds the match.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    by = list(by)
    if back_days is not None and tolerance_days is not None and tolerance_days < back_days:
        return _self_match_in_range(df, by, day, back_days, payload, tolerance_days, direction)
    target = target if back_days is None else F.date_sub(day, back_days)
    found = F.struct(*[F.col(old).alias(new) for old, new in payload.items()])
    row = F.struct(*df.columns)
    roles = F.array(
        F.struct(F.col(day).alias("_day"), F.lit(0).alias("_is_probe"), found.alias("_found"),
                 F.when(F.lit(False), row).alias("_left")),
        F.struct(target.alias("_day"), F.lit(1).alias("_is_probe"),
                 F.when(F.lit(False), found).alias("_found"), row.alias("_left")))
    timeline = df.select(*by, F.explode(roles).alias("_role")).select(*by, "_role.*") \
        .where((F.col("_is_probe") == 1) | F.col("_day").isNotNull())
    matched = _matched(timeline, by, payload[day], tolerance_days, direction)
    return matched.select(*_carried(df.columns, by), *[
        F.col(f"_match.{new}").alias(new) for new in payload.values()])


def _self_match_in_range(df: DataFrame, by: list[str], day: str, back_days: int,
                         payload: dict[str, str], tolerance_days: int,
                         direction: str) -> DataFrame:
    """The match of rows whose target is ``back_days`` before their own day."""
    found = F.when(F.col(day).isNotNull(), F.struct(
        *[F.col(old).alias(new) for old, new in payload.items()]))
    order = Window.partitionBy(*by).orderBy("_number")
    reached = df.withColumn("_number", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    if direction in ("nearest", "backward"):
        reached = reached.withColumn("_back", F.last(found, True).over(
            order.rangeBetween(-back_days - tolerance_days, -back_days)))
    if direction in ("nearest", "forward"):
        reached = reached.withColumn("_ahead", F.first(found, True).over(
            order.rangeBetween(-back_days, -back_days + tolerance_days)))
    matched = reached.withColumn("_day", F.date_sub(day, back_days)).withColumn(
        "_match", _choose(direction, payload[day], tolerance_days))
    return matched.select(*df.columns, *[
        F.col(f"_match.{new}").alias(new) for new in payload.values()])


def _carried(columns: Sequence[str], by: Sequence[str]) -> list[Column]:
    """The left row's columns. Keys are the window's own, so that Spark still
    knows the result to be partitioned by them."""
    return [F.col(c) if c in by else F.col(f"_left.{c}").alias(c) for c in columns]


def _matched(timeline: DataFrame, by: Sequence[str], right_on: str,
             tolerance_days: int | None, direction: str) -> DataFrame:
    """The probes of a timeline with their match in ``_match``."""
    is_probe = F.col("_is_probe")
    # On an equal day the candidate sorts first in both directions, so each
    # running "last seen" includes it.
    ascending = Window.partitionBy(*by).orderBy(F.col("_day").asc(), is_probe.asc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    descending = Window.partitionBy(*by).orderBy(F.col("_day").desc(), is_probe.asc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if direction in ("nearest", "backward"):
        timeline = timeline.withColumn("_back", F.last("_found", True).over(ascending))
    if direction in ("nearest", "forward"):
        timeline = timeline.withColumn("_ahead", F.last("_found", True).over(descending))

    return timeline.where(is_probe == 1).withColumn(
        "_match", _choose(direction, right_on, tolerance_days))


def _choose(direction: str, right_on: str, tolerance_days: int | None) -> Column:
    def reach(side: str, sign: int) -> Column:
        gap = F.datediff(F.col("_day"), F.col(f"{side}.{right_on}")) * sign
        usable = gap >= 0
        if tolerance_days is not None:
            usable = usable & (gap <= tolerance_days)
        return F.when(usable, gap)

    if direction == "backward":
        return F.when(reach("_back", 1).isNotNull(), F.col("_back"))
    if direction == "forward":
        return F.when(reach("_ahead", -1).isNotNull(), F.col("_ahead"))
    behind, ahead = reach("_back", 1), reach("_ahead", -1)
    return (F.when(behind.isNotNull() & (ahead.isNull() | (behind <= ahead)), F.col("_back"))
            .when(ahead.isNotNull(), F.col("_ahead")))


def year_ago_match(panel: DataFrame, *, entity: str = "ticker", period: str = "period_end",
                   filed: str = "filed_date", value: str = "eps_diluted",
                   value_out: str = "eps_year_ago", target_days: int = 365,
                   tolerance_days: int = 45, history: DataFrame | None = None,
                   unique: bool = True) -> DataFrame:
    """Attach each row's year-ago row by date, never by row offset.

    ``history`` supplies the candidates; by default the panel is its own.
    ``unique`` states that the panel has one row per (entity, period), which
    first-known dedupe guarantees.
    """
    names = {period: f"{period}_year_ago", filed: f"{filed}_year_ago", value: value_out}
    target = F.date_sub(period, target_days)
    if history is None and unique:
        return asof_self_match(panel, by=[entity], day=period, back_days=target_days,
                               payload=names, tolerance_days=tolerance_days)
    source = panel if history is None else history
    candidates = source.select(entity, *[F.col(old).alias(new) for old, new in names.items()])
    return asof_match(
        panel.withColumn("_target", target), candidates,
        by=[entity], left_on="_target", right_on=names[period],
        payload=[names[filed], value_out], right_order=[names[filed], value_out],
        tolerance_days=tolerance_days, left_unique=unique, right_unique=unique,
    ).drop("_target")


def covered_at(rows: DataFrame, intervals: DataFrame, *, entity: str = "ticker",
               moment: str = "prediction_date", start: str = "start", end: str = "end",
               out: str = "in_index_at_prediction") -> DataFrame:
    """Flag rows whose moment lies in an interval of their entity (ends inclusive).

    An interval holds the moment exactly when the latest end among intervals
    started by then reaches it, so one running maximum per entity answers every
    row: no row x interval pairs, overlapping intervals included. A null start
    or end is open; a null moment is outside.
    """
    opened = (
        intervals.select(
            entity,
            F.coalesce(F.col(start), F.lit("0001-01-01").cast("date")).alias("_day"),
            F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")).alias("_until"))
        .groupBy(entity, "_day").agg(F.max("_until").alias("_until"))
        .withColumn("_is_probe", F.lit(0))
    )
    probes = (rows.where(F.col(moment).isNotNull())
              .select(entity, F.col(moment).alias("_day")).distinct()
              .withColumn("_is_probe", F.lit(1)))
    running = Window.partitionBy(entity).orderBy("_day", "_is_probe") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = (
        opened.unionByName(probes, allowMissingColumns=True)
        .withColumn("_reach", F.max("_until").over(running))
        .where(F.col("_is_probe") == 1)
        .select(entity, F.col("_day").alias(moment),
                known_true(F.col("_reach") >= F.col("_day")).alias(out))
    )
    joined = rows.drop(out).join(answers, [entity, moment], "left")
    return joined.select(*rows.drop(out).columns, known_true(F.col(out)).alias(out))


def gate_on_intervals(rows: DataFrame, intervals: DataFrame, *,
                      reason: str = "not_in_index_at_prediction_date",
                      out: str = "in_index_at_prediction",
                      **columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows inside an interval, rows outside with a reason)."""
    flagged = covered_at(rows, intervals, out=out, **columns)
    outside = flagged.where(~F.col(out)).withColumn("reason", F.lit(reason))
    return flagged.where(F.col(out)), outside
