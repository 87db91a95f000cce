"""Data-quality gates. Each returns the violating rows; ``enforce`` raises.

Gates are plain filters and small aggregations, so they run where the data is
and the driver sees a bounded sample of offenders at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.contracts import GateError, known_true
from pitpanel.operators.features import EXPOSED_LAGS, STREAK_CAP
from pitpanel.session import settle


def enforce(violations: DataFrame, gate: str, show: int = 10) -> None:
    """Raise when any row violates the gate, naming a few of them."""
    offenders = violations.limit(show).collect()
    if offenders:
        raise GateError(f"{gate}: violated, e.g. {[row.asDict() for row in offenders]}")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def ties(df: DataFrame, entity: str = "ticker", decision: str = "prediction_date") -> DataFrame:
    """Entities with two rows decided on one day: strict order is impossible."""
    return duplicate_keys(df, [entity, decision])


def not_after(df: DataFrame, later: str = "prediction_date",
              earlier: str = "period_end") -> DataFrame:
    return df.where(known_true(F.col(later) <= F.col(earlier)))


def wrong_offset(df: DataFrame, later: str = "prediction_date", earlier: str = "filed_date",
                 days: int = 1) -> DataFrame:
    return df.where(~known_true(F.datediff(later, earlier) == days))


def nulls_in(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def flag_not_set(df: DataFrame, flag: str = "in_index_at_prediction") -> DataFrame:
    return df.where(~known_true(F.col(flag)))


def above(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.where(known_true(F.col(column) > limit))


def outside_window(df: DataFrame, start: str, end: str | None = None,
                   period: str = "period_end") -> DataFrame:
    outside = F.col(period) < F.lit(start).cast("date")
    if end is not None:
        outside = outside | (F.col(period) > F.lit(end).cast("date"))
    return df.where(known_true(outside))


def beyond_boundary(df: DataFrame, boundary: str, decision: str = "prediction_date") -> DataFrame:
    """The latest decision, when it reaches the locked boundary."""
    latest = df.agg(F.max(decision).alias("latest"))
    return latest.where(F.col("latest") >= F.lit(boundary).cast("date"))


def infinite_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    unbounded = [F.abs(F.col(c).cast("double")) == float("inf") for c in columns]
    return df.where(known_true(reduce(lambda a, b: a | b, unbounded)))


def impossible_history(df: DataFrame, *, streak: str = "growth_streak",
                       available: str = "quarters_available",
                       decision: str = "prediction_date", cap: int = STREAK_CAP,
                       lags: Sequence[int] = EXPOSED_LAGS) -> DataFrame:
    """Streaks out of bounds or longer than history; lags without enough history."""
    checks = [
        ("streak outside bounds", ~F.col(streak).between(0, cap)),
        ("streak beyond history", F.col(streak) > F.col(available)),
        *[(f"lag {k} without history",
           F.col(f"{decision}_lag_{k}").isNotNull() & (F.col(available) < k)) for k in lags],
    ]
    return _tagged(df, checks)


def lag_leaks(df: DataFrame, *, decision: str = "prediction_date",
              values: Sequence[str] = ("label", "eps_growth_yoy"),
              lags: Sequence[int] = EXPOSED_LAGS) -> DataFrame:
    """Lags not decided strictly earlier, and lag values without a source row."""
    checks: list[tuple[str, Column]] = []
    for k in lags:
        source = F.col(f"{decision}_lag_{k}")
        checks.append((f"lag {k} not strictly earlier", source >= F.col(decision)))
        checks += [(f"{name}_lag_{k} without source",
                    F.col(f"{name}_lag_{k}").isNotNull() & source.isNull()) for name in values]
    return _tagged(df, checks)


def _tagged(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per (row, failed check), in a single pass over the table."""
    failed = F.array_compact(F.array(*[
        F.when(known_true(condition), F.lit(name)) for name, condition in checks]))
    return df.withColumn("_failed", failed).where(F.size("_failed") > 0) \
        .withColumn("violation", F.explode("_failed")).drop("_failed")


Gate = Callable[[DataFrame], DataFrame]


def fire_test(df: DataFrame, gate: Gate = lag_leaks, *, keys: Sequence[str] = ("ticker",
              "period_end"), decision: str = "prediction_date") -> DataFrame:
    """Corrupt one row in each way the leakage gate must catch, and run it.

    Returns (injection, injected, caught): ``caught`` counts the violations the
    gate reported for that copy of the row. The clean table must report none.
    The corrupted rows go through the gate beside the clean ones, told apart by
    a tag, so it runs once; it must judge each row by itself and keep columns.
    """
    source = F.col(f"{decision}_lag_1")
    table, key = settle(df), F.struct(*keys)
    whole = F.struct(*[F.col(c) for c in df.columns])
    # One row: the first rows with and without a source, null where there is none.
    victims = table.agg(
        F.min_by(whole, F.when(source.isNotNull(), key)).alias("with_lag"),
        F.min_by(whole, F.when(source.isNull(), key)).alias("without_lag"))

    def corrupted(name: str, victim: str, column: str, value: Column) -> Column:
        changed = F.col(victim).withField(column, value)
        return F.struct(F.lit(name).alias("injection"), changed.alias("row"))

    day, lag = F.col(f"with_lag.{decision}"), f"{decision}_lag_1"
    copies = F.array(
        corrupted("lag decided on the same day", "with_lag", lag, day),
        corrupted("lag decided later", "with_lag", lag, F.date_add(day, 90)),
        corrupted("lag value without source row", "without_lag", "label_lag_1",
                  F.lit(1).cast(df.schema["label_lag_1"].dataType)))
    injected = settle(victims.select(F.explode(copies).alias("c")).select(
        F.col("c.injection").alias("_injection"), F.col("c.row").alias("_row")))
    tagged = table.withColumn("_injection", F.lit("clean")).unionByName(
        injected.where(F.col("_row").isNotNull()).select("_row.*", "_injection"))
    caught = gate(tagged).groupBy("_injection").agg(F.count(F.lit(1)).alias("caught"))
    names = injected.select("_injection", F.col("_row").isNotNull().cast("long")
                            .alias("injected")).unionByName(
        injected.sparkSession.range(1).select(F.lit("clean").alias("_injection"),
                                              F.lit(0).cast("long").alias("injected")))
    return names.join(F.broadcast(caught), "_injection", "left").select(
        F.col("_injection").alias("injection"), "injected",
        F.coalesce("caught", F.lit(0).cast("long")).alias("caught"))


def fire_test_failures(report: DataFrame) -> DataFrame:
    """Injections the gate missed, or a clean copy it rejected."""
    clean = F.col("injection") == "clean"
    return report.where((clean & (F.col("caught") > 0))
                        | (~clean & (F.col("injected") > 0) & (F.col("caught") == 0)))


def row_count_gap(built: DataFrame, source: DataFrame) -> DataFrame:
    """The two row counts, when they differ."""
    counts = built.agg(F.count(F.lit(1)).alias("n_built")).join(
        source.agg(F.count(F.lit(1)).alias("n_source")))
    return counts.where(F.col("n_built") != F.col("n_source"))


def altered_rows(built: DataFrame, source: DataFrame, keys: Sequence[str],
                 columns: Sequence[str]) -> DataFrame:
    """Source rows that are missing from, or changed in, the built table."""
    before = source.select(*keys, F.struct(*columns).alias("before"), F.lit(1).alias("_in_source"))
    after = built.select(*keys, F.struct(*columns).alias("after"), F.lit(1).alias("_in_built"))
    joined = before.join(after, list(keys), "full_outer")
    problem = (F.when(F.col("_in_built").isNull(), "missing")
               .when(F.col("_in_source").isNull(), "extra")
               .when(~F.col("before").eqNullSafe(F.col("after")), "altered"))
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()) \
        .select(*keys, "problem", "before", "after")


def fold_order(roles: DataFrame, boundary: str, *, fold: str = "fold", role: str = "role",
               decision: str = "prediction_date") -> DataFrame:
    """Folds that break the expanding-window discipline.

    ``roles`` holds (fold, role, decision) rows with roles train, validate,
    inner_train and inner_validate.
    """
    def last(name: str) -> Column:
        return F.max(F.when(F.col(role) == name, F.col(decision)))

    def first(name: str) -> Column:
        return F.min(F.when(F.col(role) == name, F.col(decision)))

    def size(name: str) -> Column:
        return F.count_if(F.col(role) == name)

    stats = roles.groupBy(fold).agg(
        F.max(decision).alias("last_decision"),
        last("train").alias("train_last"), first("validate").alias("validate_first"),
        last("inner_train").alias("inner_train_last"),
        first("inner_validate").alias("inner_validate_first"),
        last("inner_validate").alias("inner_validate_last"),
        size("train").alias("n_train"), size("validate").alias("n_validate"),
        (size("inner_train") + size("inner_validate")).alias("n_inner"))
    checks = [
        ("reaches the holdout", F.col("last_decision") >= F.lit(boundary).cast("date")),
        ("empty side", (F.col("n_train") == 0) | (F.col("n_validate") == 0)),
        ("trains on or after validation", F.col("train_last") >= F.col("validate_first")),
        ("inner split overlaps", F.col("inner_train_last") >= F.col("inner_validate_first")),
        ("stops on scored rows", F.col("inner_validate_last") >= F.col("validate_first")),
        ("inner split loses rows", F.col("n_inner") != F.col("n_train")),
    ]
    return _tagged(stats, checks)


def protocol_breaches(roles: DataFrame, declared: DataFrame, holdout: DataFrame,
                      keys: Sequence[str], *, fold: str = "fold",
                      decision: str = "prediction_date", label: str = "label_yoy") -> DataFrame:
    """Breaches of a declared boundary-fold protocol, as (fold, violation) rows.

    ``roles`` holds train and predict rows per fold, ``declared`` one row per
    fold with ``n_predict_rows`` and ``n_predict_rows_labelled``.
    """
    is_train, is_predict = F.col("role") == "train", F.col("role") == "predict"
    stats = roles.groupBy(fold).agg(
        F.max(F.when(is_train, F.col(decision))).alias("train_last"),
        F.min(F.when(is_predict, F.col(decision))).alias("predict_first"),
        F.count_if(is_predict).alias("n_predict"),
        F.count_if(is_predict & F.col(label).isNotNull()).alias("n_labelled"))
    per_fold = _tagged(stats.join(declared, fold, "full_outer"), [
        ("trains on or after the first predicted row",
         F.col("train_last") >= F.col("predict_first")),
        ("predicted rows differ from declaration",
         ~F.col("n_predict").eqNullSafe(F.col("n_predict_rows"))),
        ("labelled rows differ from declaration",
         ~F.col("n_labelled").eqNullSafe(F.col("n_predict_rows_labelled"))),
    ]).select(F.col(fold).cast("string").alias(fold), "violation")
    both = roles.groupBy(fold, *keys).agg(
        F.countDistinct("role").alias("n_roles")).where(F.col("n_roles") > 1)
    per_key = roles.where(is_predict).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"))
    coverage = holdout.select(*keys).distinct().join(per_key, list(keys), "left")
    return _union([
        per_fold,
        both.select(F.col(fold).cast("string").alias(fold),
                    F.lit("trains on a row it predicts").alias("violation")),
        per_key.where(F.col("n_folds") > 1).select(
            F.lit("all").alias(fold), F.lit("row predicted by several folds").alias("violation")),
        coverage.where(F.col("n_folds").isNull()).select(
            F.lit("all").alias(fold), F.lit("holdout row in no fold").alias("violation")),
    ])


def resolvable_rows(pending: DataFrame, history: DataFrame, withheld: DataFrame, *,
                    entity: str = "ticker", period: str = "period_end",
                    decision: str = "prediction_date", value: str = "eps_diluted",
                    label: str = "label_yoy") -> DataFrame:
    """Pending rows whose outcome could already be worked out, with the reason."""
    def reason(df: DataFrame, text: str) -> DataFrame:
        return df.select(entity, F.lit(text).alias("violation"))

    last_known = history.groupBy(entity).agg(F.max(period).alias("_last"))
    stale = pending.select(entity, period).join(last_known, entity) \
        .where(F.col(period) <= F.col("_last"))
    edge = history.agg(F.max(decision).alias("_history_last"))
    early = pending.select(entity, decision).join(F.broadcast(edge)) \
        .where(~known_true(F.col("_history_last") < F.col(decision)))
    return _union([
        reason(pending.where(F.col(value).isNotNull()), "carries a value"),
        reason(pending.where(F.col(label).isNotNull()), "carries a label"),
        reason(pending.join(withheld.select(entity).distinct(), entity, "left_semi"),
               "already filed after the cut"),
        reason(stale, "not later than known history"),
        reason(early, "history does not precede it"),
    ])


def below_floor(df: DataFrame, numerator: str, denominator: str, floor: float) -> DataFrame:
    """Coverage rows whose share is under the floor; no denominator is no coverage."""
    share = F.coalesce(F.try_divide(F.col(numerator), F.col(denominator)), F.lit(0.0))
    return df.withColumn("share", share).where(F.col("share") < floor)


def outstanding_rows(resolved: DataFrame, status: str = "status",
                     waiting: str = "outstanding") -> DataFrame:
    return resolved.where(F.col(status) == waiting)


def recorded_too_late(resolved: DataFrame, recorded_at: str | Column,
                      filed: str = "actual_filed_date") -> DataFrame:
    """Rows with a filing on or before the day the prediction was recorded.

    Every row with a filing counts, scored or not: same-day order is unknown.
    """
    moment = F.lit(recorded_at) if isinstance(recorded_at, str) else recorded_at
    return resolved.where(known_true(F.col(filed) <= F.to_date(moment.cast("timestamp"))))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count and the exact sum of row hashes."""
    columns = sorted(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash_sum"))


def fingerprint_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both digests, when they differ."""
    old = before.select(F.struct("n_rows", "hash_sum").alias("before"))
    new = after.select(F.struct("n_rows", "hash_sum").alias("after"))
    return old.join(new).where(~F.col("before").eqNullSafe(F.col("after")))


def inconsistent_provenance(recorded: DataFrame, current: dict[str, str]) -> DataFrame:
    """Provenance keys whose recorded value is not the current one."""
    expected = recorded.sparkSession.createDataFrame(
        sorted(current.items()), "key string, current string")
    return recorded.join(F.broadcast(expected), "key", "right") \
        .where(~F.col("value").eqNullSafe(F.col("current")))


def invalid_cut(panel: DataFrame, cut: str, today: str, horizon: str,
                decision: str = "prediction_date") -> DataFrame:
    """Reasons why the cut date cannot be used."""
    day = F.lit(cut).cast("date")
    stats = panel.agg(F.max(decision).alias("latest"))
    return _tagged(stats, [
        ("cut is in the future", day > F.lit(today).cast("date")),
        ("cut is past the membership horizon", day > F.lit(horizon).cast("date")),
        ("table already holds later rows", F.col("latest") > day),
    ])


def unclean_features(features: Sequence[str], identities: Sequence[str], label: str) -> list[str]:
    """Problems with a feature list: leaked identities, the label, repeats."""
    problems = [f"target identity in features: {name}" for name in identities if name in features]
    if label in features:
        problems.append(f"label in features: {label}")
    problems += [f"repeated feature: {name}" for name in sorted(set(features))
                 if list(features).count(name) > 1]
    return problems
