"""Membership intervals from an add/remove log, and summaries of the log.

Every per-entity window here runs over distinct (day, kind) events, so a hot
entity contributes at most two rows per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ADD, REMOVE = "add", "remove"


def change_events(changes: DataFrame, entity: str = "ticker", date: str = "date",
                  added: str = "added", removed: str = "removed") -> DataFrame:
    """A two-sided change log as rows (entity, date, kind)."""
    sides = F.array(
        F.struct(F.col(added).alias("who"), F.lit(ADD).alias("kind")),
        F.struct(F.col(removed).alias("who"), F.lit(REMOVE).alias("kind")))
    return (
        changes.where(F.col(date).isNotNull())
        .select(date, F.explode(sides).alias("side"))
        .select(F.trim("side.who").alias(entity), F.col(date), F.col("side.kind").alias("kind"))
        .where(F.col(entity).isNotNull() & (F.col(entity).cast("string") != ""))
    )


def membership_intervals(events: DataFrame, window_start: str, horizon: str, *,
                         entity: str = "ticker", date: str = "date", kind: str = "kind",
                         current: DataFrame | None = None,
                         date_added: str = "date_added") -> DataFrame:
    """Disjoint stints (entity, start, end, left_censored) of every entity seen.

    Adds sort before removals of the same day. A log that opens with a removal
    means membership began before the log: that stint opens at the earlier of
    the window start and the removal. Repeats of the current state are ignored,
    and a stint still open ends at the horizon. Current members without any
    event open at their added date, or at the window start.
    """
    floor_day = F.lit(window_start).cast("date")
    last_day = F.lit(horizon).cast("date")
    log = events.select(entity, F.col(date).alias("date"), F.col(kind).alias("kind")).distinct()
    timeline = Window.partitionBy(entity).orderBy("date", "kind")
    flips = (
        log.withColumn("_before", F.lag("kind").over(timeline))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("kind")))
        .withColumn("_next", F.lead("date").over(timeline))
    )
    opening_removal = F.col("_before").isNull() & (F.col("kind") == REMOVE)
    stints = (
        flips.where((F.col("kind") == ADD) | opening_removal)
        .select(
            entity,
            F.when(opening_removal, F.least(floor_day, F.col("date")))
            .otherwise(F.col("date")).alias("start"),
            F.when(opening_removal, F.col("date"))
            .otherwise(F.coalesce("_next", last_day)).alias("end"),
            opening_removal.alias("left_censored"))
    )
    if current is None:
        return stints
    standing = (
        current.where(F.col(entity).isNotNull() & (F.col(entity).cast("string") != ""))
        .groupBy(entity).agg(F.max(date_added).alias("_added"))
        .join(log.select(entity).distinct(), entity, "left_anti")
        .withColumn("_opened", F.coalesce("_added", floor_day))
        .select(
            entity, F.greatest("_opened", floor_day).alias("start"), last_day.alias("end"),
            (F.col("_opened") < floor_day).alias("left_censored"))
    )
    return stints.unionByName(standing)


def membership_metadata(intervals: DataFrame, events: DataFrame, *, entity: str = "ticker",
                        kind: str = "kind", current: DataFrame | None = None) -> DataFrame:
    """One row per entity: first/last seen, removals, stints, censoring."""
    summary = intervals.groupBy(entity).agg(
        F.min("start").alias("first_seen"), F.max("end").alias("_last"),
        F.count(F.lit(1)).alias("n_stints"), F.bool_or("left_censored").alias("left_censored"))
    removed = events.where(F.col(kind) == REMOVE).select(entity).distinct() \
        .withColumn("is_removed_name", F.lit(True))
    joined = summary.join(removed, entity, "left")
    if current is None:
        joined = joined.withColumn("still_in_index", F.lit(False))
    else:
        standing = current.select(entity).distinct().withColumn("still_in_index", F.lit(True))
        joined = joined.join(standing, entity, "left")
    still = F.coalesce("still_in_index", F.lit(False))
    return joined.select(
        entity, "first_seen", F.when(~still, F.col("_last")).alias("last_seen"),
        still.alias("still_in_index"),
        F.coalesce("is_removed_name", F.lit(False)).alias("is_removed_name"),
        "n_stints", "left_censored")


def members_at(intervals: DataFrame, moment: str, entity: str = "ticker") -> DataFrame:
    """Entities with an interval that contains the moment."""
    day = F.lit(moment).cast("date")
    return intervals.where((F.col("start") <= day) & (F.col("end") >= day)) \
        .select(entity).distinct()


def first_last_seen(events: DataFrame, window_start: str, window_end: str, *,
                    entity: str = "ticker", date: str = "date", kind: str = "kind",
                    current: DataFrame | None = None,
                    date_added: str = "date_added") -> DataFrame:
    """Earliest add and latest removal inside the window, per ever-member."""
    inside = events.where(F.col(date).between(window_start, window_end))
    seen = inside.groupBy(entity).agg(
        F.min(F.when(F.col(kind) == ADD, F.col(date))).alias("_added"),
        F.max(F.when(F.col(kind) == REMOVE, F.col(date))).alias("_removed"))
    if current is not None:
        standing = current.groupBy(entity).agg(F.max(date_added).alias("_listed")) \
            .withColumn("_current", F.lit(True))
        seen = seen.join(standing, entity, "full_outer")
    else:
        seen = seen.withColumn("_listed", F.lit(None).cast("date")) \
            .withColumn("_current", F.lit(False))
    floor_day = F.lit(window_start).cast("date")
    known = F.coalesce("_listed", "_added")
    censored = known.isNull() | (known < floor_day)
    still = F.coalesce("_current", F.lit(False))
    return seen.select(
        entity,
        F.when(censored, floor_day).otherwise(known).alias("first_seen_in_index"),
        F.when(~still, F.col("_removed")).alias("last_seen_in_index"),
        still.alias("still_in_index"), censored.alias("first_seen_left_censored"))


def log_coverage(changes: DataFrame, window_start: str, window_end: str,
                 date: str = "date") -> DataFrame:
    """Parseable rows, date range and in-window rows of a change log."""
    return changes.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(date).alias("n_dated"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.count_if(F.col(date).between(window_start, window_end)).alias("n_in_window"))


def log_years(changes: DataFrame, window_start: str, window_end: str,
              date: str = "date") -> DataFrame:
    """Changes per year of the window; a year without any shows zero."""
    inside = changes.where(F.col(date).between(window_start, window_end))
    counted = inside.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    years = changes.sparkSession.range(int(window_start[:4]), int(window_end[:4]) + 1) \
        .select(F.col("id").cast("int").alias("year"))
    return years.join(counted, "year", "left").select(
        "year", F.coalesce("n", F.lit(0)).alias("n_changes"),
        F.col("n").isNull().alias("missing"))
