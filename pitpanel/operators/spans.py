"""Date-ranged identifiers: overlap checks, range joins, provenance text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_START, OPEN_END = "0001-01-01", "9999-12-31"


def _bounds(valid_from: str, valid_to: str) -> tuple[Column, Column]:
    return (F.coalesce(F.col(valid_from), F.lit(OPEN_START).cast("date")),
            F.coalesce(F.col(valid_to), F.lit(OPEN_END).cast("date")))


def span_conflicts(spans: DataFrame, *, entity: str = "ticker", valid_from: str = "valid_from",
                   valid_to: str = "valid_to") -> DataFrame:
    """Spans that end before they start or touch an earlier span of the entity.

    Ends are inclusive, so a shared endpoint is an overlap. Each span is
    compared with the furthest end before it, not only with its neighbour.
    """
    low, high = _bounds(valid_from, valid_to)
    earlier = Window.partitionBy(entity).orderBy("_low", "_high") \
        .rowsBetween(Window.unboundedPreceding, -1)
    checked = spans.withColumn("_low", low).withColumn("_high", high) \
        .withColumn("_reach", F.max("_high").over(earlier))
    problem = (F.when(F.col("_low") > F.col("_high"), "inverted")
               .when(F.col("_low") <= F.col("_reach"), "overlap"))
    return checked.withColumn("problem", problem).where(F.col("problem").isNotNull()) \
        .drop("_low", "_high", "_reach")


def facts_in_spans(facts: DataFrame, spans: DataFrame, *, identifier: str = "cik",
                   period: str = "period_end", valid_from: str = "valid_from",
                   valid_to: str = "valid_to") -> DataFrame:
    """Facts of each span's identifier whose period lies inside the span."""
    low, high = _bounds(valid_from, valid_to)
    bounded = spans.withColumn("_low", low).withColumn("_high", high)
    return facts.join(bounded, identifier).where(
        (F.col(period) >= F.col("_low")) & (F.col(period) <= F.col("_high"))) \
        .drop("_low", "_high")


def describe_spans(spans: DataFrame, *, entity: str = "ticker", identifier: str = "cik",
                   valid_from: str = "valid_from", valid_to: str = "valid_to",
                   out: str = "cik_span_used") -> DataFrame:
    """``id[from:to]`` pieces in date order, a bare id where both ends are open.

    The text lists every span of the entity, so it is as long as its curated
    span list; nothing else is collected.
    """
    start = F.coalesce(F.col(valid_from).cast("string"), F.lit(""))
    end = F.coalesce(F.col(valid_to).cast("string"), F.lit(""))
    piece = F.when((start == "") & (end == ""), F.col(identifier)).otherwise(
        F.concat(F.col(identifier), F.lit("["), start, F.lit(":"), end, F.lit("]")))
    low, _ = _bounds(valid_from, valid_to)
    ordered = F.array_sort(F.collect_list(F.struct(low.alias("at"), piece.alias("text"))))
    return spans.groupBy(entity).agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "|").alias(out))


def fact_ranges(facts: DataFrame, identifier: str = "cik",
                period: str = "period_end") -> DataFrame:
    """Per identifier: number of facts and first and last period."""
    return facts.groupBy(identifier).agg(
        F.count(F.lit(1)).alias("n_records"), F.min(period).alias("first_period"),
        F.max(period).alias("last_period"))


def choose_by_overlap(tenures: DataFrame, candidates: DataFrame, ranges: DataFrame, *,
                      entity: str = "ticker", name: str = "norm", identifier: str = "cik",
                      start: str = "tenure_start", end: str = "tenure_end",
                      open_end: str = "2025-12-31") -> DataFrame:
    """Choose each entity's identifier by how long its facts overlap the tenure.

    ``tenures``: (entity, name, start, end); ``candidates``: (name, identifier,
    position); ``ranges``: see ``fact_ranges``. Candidates without facts are
    out, one overlapping candidate is taken, of several the longest overlap
    (first position on a tie), of none nothing. Candidates of one name that
    cover the same days are reduced to one row carrying their number, so a name
    shared by many identifiers costs one row per distinct range.
    """
    probed = candidates.join(ranges, identifier, "left")
    per_name = probed.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col("n_records") > 0).alias("n_with_records"))
    first = F.min_by(F.struct(F.col(identifier), "n_records"), F.struct("position", identifier))
    distinct_ranges = (
        probed.where(F.col("n_records") > 0)
        .groupBy(name, "first_period", "last_period")
        .agg(F.count(F.lit(1)).alias("_same"), first.alias("_who"),
             F.min("position").alias("_position")))
    closed = tenures.select(
        entity, name, F.col(start).alias("tenure_start"),
        F.coalesce(F.col(end), F.lit(open_end).cast("date")).alias("tenure_end"))
    windows = closed.select(name, "tenure_start", "tenure_end").distinct()
    overlap = F.datediff(F.least("last_period", "tenure_end"),
                         F.greatest("first_period", "tenure_start"))
    best = (
        windows.join(distinct_ranges, name)
        .withColumn("overlap_days", overlap).where(F.col("overlap_days") > 0)
        .groupBy(name, "tenure_start", "tenure_end")
        .agg(F.sum("_same").alias("n_overlapping"),
             F.min_by(F.struct(F.col(f"_who.{identifier}").alias("chosen"),
                               F.col("_who.n_records").alias("chosen_n"),
                               F.col("first_period").alias("chosen_first"),
                               F.col("last_period").alias("chosen_last"), "overlap_days"),
                      F.struct((-F.col("overlap_days")).alias("_short"), "_position",
                               F.col(f"_who.{identifier}").alias("_id")))
             .alias("_best")))
    decided = closed.join(per_name, name, "left") \
        .join(best, [name, "tenure_start", "tenure_end"], "left")
    n = F.coalesce("n_overlapping", F.lit(0))
    return decided.select(
        entity, name, "tenure_start", "tenure_end",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_with_records", F.lit(0)).alias("n_with_records"),
        n.alias("n_overlapping"),
        F.col("_best.chosen").alias(f"chosen_{identifier}"),
        F.coalesce("_best.chosen_n", F.lit(0)).alias("chosen_n"),
        F.col("_best.chosen_first").alias("chosen_first"),
        F.col("_best.chosen_last").alias("chosen_last"),
        F.coalesce("_best.overlap_days", F.lit(0)).alias("overlap_days"),
        F.when(n == 1, "b_single_overlap").when(n > 1, "c_longest_overlap")
        .otherwise("d_unresolved_ambiguous").alias("rule"))
