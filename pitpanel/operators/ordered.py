"""Exact global order without a single-task sort.

Ranks, quantiles and cumulative counts over a whole table need a global order.
An unpartitioned window would put every row into one task, and an exact
percentile aggregate keeps every distinct value in one buffer. Here values are
counted per distinct value, cut into slices that ascend with the value, and
summed inside each slice on top of the totals of the slices below.

A slice is a fixed function of the value alone: its sign, its power of two and
the leading bits of its fraction. Equal values always meet, any recomputation
lands in the same slices, heavy tails spread over their magnitudes, and nothing
has to be sampled first.

A slice that holds too many distinct values is split by the next bits of the
fraction, and its crowded parts again, until all 52 are used: identifiers,
timestamps or narrow probabilities then fill as many slices as they need. Sums
below a part run over the parts of the same slice only, on top of the sum below
that slice, so no running sum passes over more than one slice's parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.session import settle

# Slices per power of two, and an offset that keeps every exponent positive.
SLICES_PER_OCTAVE = 4096
EXPONENT_OFFSET = 1100
# Parts of a crowded slice, level by level: 12 + 13 + 13 + 14 fraction bits.
PARTS = (1 << 13, 1 << 13, 1 << 14)
# Distinct values beyond which a slice is crowded, and the number of crowded
# slices there can be at most: in larger tables they may hold more values.
SLICE_VALUES = 50_000
MOST_CROWDED = 1 << 16


def _magnitude(value: Column) -> tuple[Column, Column]:
    """(exponent, fraction in [0, 1)) of a double's size, both exact.

    The logarithm may round across a power of two; dividing by one is exact, so
    the fraction tells.
    """
    size = F.abs(value)
    rough = F.floor(F.log2(size))
    share = size / F.pow(F.lit(2.0), rough)
    exponent = rough + F.when(share < 1, -1).when(share >= 2, 1).otherwise(0)
    return exponent, size / F.pow(F.lit(2.0), exponent) - 1.0


def value_slice(value: Column) -> Column:
    """Slice number of a double; ascends with the value."""
    exponent, fraction = _magnitude(value)
    number = (exponent + EXPONENT_OFFSET) * SLICES_PER_OCTAVE \
        + F.floor(fraction * SLICES_PER_OCTAVE)
    return (F.when(value > 0, number).when(value < 0, -number).otherwise(F.lit(0))).cast("long")


def value_part(value: Column, level: int) -> Column:
    """Number of the part that a double falls into at a level; ascends with the value."""
    _, fraction = _magnitude(value)
    scale = SLICES_PER_OCTAVE
    for parts in PARTS[:level - 1]:
        scale *= parts
    inner = fraction * scale
    number = F.floor((inner - F.floor(inner)) * PARTS[level - 1])
    return (F.when(value > 0, number).when(value < 0, PARTS[level - 1] - 1 - number)
            .otherwise(F.lit(0))).cast("long")


@dataclass(frozen=True)
class Slices:
    """Distinct values with their slice and, where that is crowded, their parts."""

    tagged: DataFrame
    levels: list[str]


def slices(counts: DataFrame, value: str, by: Sequence[str] = ()) -> Slices:
    """Place one row per (by, value) in slices of bounded size.

    Every level costs one aggregation that finds what is crowded; the first
    usually finds nothing. Crowded slices are at most ``MOST_CROWDED`` rows,
    which go to all tasks.
    """
    by, x = list(by), F.col(value).cast("double")
    tagged = settle(counts.withColumn("_slice", value_slice(x)))
    levels = ["_slice"]
    sizes = tagged.groupBy(*by, *levels).agg(F.count(F.lit(1)).alias("_n"))
    largest = None
    for level in range(1, len(PARTS) + 1):
        sizes = settle(sizes)
        if largest is None:
            total = sizes.agg(F.sum("_n")).first()[0] or 0
            largest = max(SLICE_VALUES, total // MOST_CROWDED)
        crowded = sizes.where(F.col("_n") > largest).select(
            *by, *levels, F.lit(True).alias("_crowded"))
        if not crowded.limit(1).count():
            break
        part = f"_part{level}"
        inside = tagged.join(F.broadcast(crowded), [*by, *levels], "left")
        tagged = inside.withColumn(part, F.when(
            F.col("_crowded"), value_part(x, level)).otherwise(F.lit(0))).drop("_crowded")
        levels.append(part)
        split = inside.where("_crowded").withColumn(part, value_part(x, level))
        sizes = split.groupBy(*by, *levels).agg(F.count(F.lit(1)).alias("_n"))
    return Slices(tagged, levels)


def _offsets(placed: Slices, sums: Sequence[str], by: Sequence[str]) -> list[DataFrame]:
    """Per level, one row per (group, slice or part): the sums of all lower values.

    The first also has the group totals. A level's running sums are taken among
    the parts of one slice, and start from what lies below that slice.
    """
    own = [placed.tagged.groupBy(*by, *placed.levels).agg(
        *[F.sum(s).alias(f"_{s}_here") for s in sums])]
    for depth in range(len(placed.levels) - 1, 0, -1):
        own.insert(0, own[0].groupBy(*by, *placed.levels[:depth]).agg(
            *[F.sum(f"_{s}_here").alias(f"_{s}_here") for s in sums]))
    found: list[DataFrame] = []
    for depth, table in enumerate(own):
        above = [*by, *placed.levels[:depth]]
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        lower = siblings.orderBy(placed.levels[depth]) \
            .rowsBetween(Window.unboundedPreceding, -1)
        below = table.select(
            *above, placed.levels[depth],
            *[F.coalesce(F.sum(f"_{s}_here").over(lower), F.lit(0)).alias(f"_{s}_offset")
              for s in sums],
            *[F.sum(f"_{s}_here").over(siblings).alias(f"{s}_total")
              for s in (sums if depth == 0 else ())])
        if depth:
            start = found[-1].select(*above, *[F.col(f"_{s}_offset").alias(f"_{s}_start")
                                               for s in sums],
                                     *[f"{s}_total" for s in sums])
            below = below.join(start, above).select(
                *above, placed.levels[depth],
                *[(F.col(f"_{s}_start") + F.col(f"_{s}_offset")).alias(f"_{s}_offset")
                  for s in sums], *[f"{s}_total" for s in sums])
        found.append(below)
    return found


def _with_inside_sums(placed: Slices, value: str, sums: Sequence[str],
                      by: Sequence[str]) -> DataFrame:
    inside = Window.partitionBy(*by, *placed.levels).orderBy(value) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return placed.tagged.select("*", *[
        F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_{s}_inside") for s in sums])


def cumulative_by_value(counts: DataFrame, value: str, sums: Sequence[str],
                        by: Sequence[str] = ()) -> DataFrame:
    """Add ``<s>_below`` (sum over smaller values) and ``<s>_total`` per group.

    ``counts`` holds one row per (by, value).
    """
    by = list(by)
    placed = slices(counts, value, by)
    offsets = _offsets(placed, sums, by)[-1]
    joined = _with_inside_sums(placed, value, sums, by).join(offsets, [*by, *placed.levels])
    return joined.select(
        *counts.columns,
        *[(F.col(f"_{s}_offset") + F.col(f"_{s}_inside")).alias(f"{s}_below") for s in sums],
        *[f"{s}_total" for s in sums])


def with_previous(counts: DataFrame, value: str, by: Sequence[str] = (),
                  out: str = "previous") -> DataFrame:
    """Add the next smaller value of the group, null for its smallest.

    ``counts`` holds one row per (by, value). Inside a slice it is the row
    before; a slice's first value follows the largest one of lower slices.
    """
    by = list(by)
    placed = slices(counts, value, by)
    tops = placed.tagged.groupBy(*by, *placed.levels).agg(F.max(value).alias("_top"))
    start: DataFrame | None = None
    for depth, level in enumerate(placed.levels):
        above = [*by, *placed.levels[:depth]]
        own = tops.groupBy(*above, level).agg(F.max("_top").alias("_top"))
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        lower = siblings.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        below = own.select(*above, level, F.max("_top").over(lower).alias("_below"))
        if start is not None:
            below = below.join(start.withColumnRenamed("_below", "_start"), above) \
                .select(*above, level, F.coalesce("_below", "_start").alias("_below"))
        start = below
    inside = Window.partitionBy(*by, *placed.levels).orderBy(value)
    joined = placed.tagged.withColumn("_before", F.lag(value).over(inside)) \
        .join(start, [*by, *placed.levels])
    return joined.select(*counts.columns, F.coalesce("_before", "_below").alias(out))


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), count: str = "n") -> DataFrame:
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.where(usable).groupBy(*by, value).agg(F.count(F.lit(1)).alias(count))


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles: rows (by, q_index, probability, quantile)."""
    by = list(by)
    values = df.select(*by, F.col(value).cast("double").alias("_value"))
    placed = slices(value_counts(values, "_value", by, "n"), "_value", by)
    levels = _offsets(placed, ["n"], by)
    grid = F.expr("array(" + ", ".join(f"{float(p)!r}D" for p in probabilities) + ")")
    position = (F.col("n_total") - 1) * F.col("probability")
    targets = (
        levels[0].groupBy(*by).agg(F.first("n_total").alias("n_total"))
        .select(*by, "n_total", F.posexplode(grid).alias("q_index", "probability"))
        .withColumn("_low", F.floor(position))
        .withColumn("_share", position - F.floor(position))
        .withColumn("_at", F.explode(F.array_distinct(F.array(
            F.floor(position), F.ceil(position)))))
        .select(*by, "_at", "q_index", "probability", "_share",
                (F.col("_at") == F.col("_low")).alias("_is_low"))
    )
    # A wanted position falls into the last slice that starts at or before it,
    # and there into the last such part. Starts and positions share one small
    # timeline, and each slice then receives only its own targets.
    for depth, offsets in enumerate(levels):
        above, own = [*by, *placed.levels[:depth]], placed.levels[depth]
        starts = offsets.select(*above, F.col("_n_offset").alias("_at"), F.struct(
            own, "_n_offset").alias("_start"))
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        along = siblings.orderBy("_at", F.col("q_index").asc_nulls_first()) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        targets = (
            starts.unionByName(targets.drop("_begin"), allowMissingColumns=True)
            .withColumn("_in", F.last("_start", True).over(along))
            .where(F.col("q_index").isNotNull())
            .select(*above, F.col(f"_in.{own}").alias(own), "q_index", "probability", "_share",
                    "_at", F.col("_in._n_offset").alias("_begin"), "_is_low")
        )
    targets = targets.withColumn("_at", F.col("_at") - F.col("_begin"))
    hits = _with_inside_sums(placed, "_value", ["n"], by).join(
        targets, [*by, *placed.levels]).where(
        (F.col("_n_inside") <= F.col("_at"))
        & (F.col("_at") < F.col("_n_inside") + F.col("n")))
    ends = hits.groupBy(*by, "q_index", "probability").agg(
        F.max(F.when(F.col("_is_low"), F.col("_value"))).alias("_v_low"),
        F.max(F.when(~F.col("_is_low"), F.col("_value"))).alias("_v_high"),
        F.max("_share").alias("_share"))
    return ends.select(
        *by, "q_index", "probability",
        F.when(F.col("_share") == 0, F.col("_v_low"))
        .otherwise(F.col("_v_low") + (F.col("_v_high") - F.col("_v_low")) * F.col("_share"))
        .alias("quantile"))


def quantile_arrays(df: DataFrame, value: str, probabilities: Sequence[float],
                    by: Sequence[str] = (), out: str = "edges") -> DataFrame:
    """The quantiles of each group as one array in grid order."""
    rows = exact_quantiles(df, value, probabilities, by)
    packed = F.array_sort(F.collect_list(F.struct("q_index", "quantile")))
    return rows.groupBy(*by).agg(F.transform(packed, lambda e: e["quantile"]).alias(out))


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (),
                 out: str = "median") -> DataFrame:
    return exact_quantiles(df, value, [0.5], by).select(*by, F.col("quantile").alias(out))


def average_ranks(counts: DataFrame, value: str, count: str = "n",
                  by: Sequence[str] = ()) -> DataFrame:
    """Average rank of every distinct value, ties sharing their mean rank."""
    ranked = cumulative_by_value(counts, value, [count], by)
    return ranked.withColumn(
        "rank", F.col(f"{count}_below") + (F.col(count) + 1) / F.lit(2.0))
