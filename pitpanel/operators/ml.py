"""Fold-wise preprocessing and models.

Everything is learned from a fold's own training rows. What a fold learns --
quantile grids, medians, means, deviations -- has a size fixed by the number of
folds and features, so it is collected to the driver and sent to tasks; rows
never are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField

from pitpanel.contracts import nan_to_null
from pitpanel.functions.scores import decide
from pitpanel.operators import boosting
from pitpanel.operators.ordered import exact_quantiles
from pitpanel.session import settle

N_QUANTILES = 1000
# Distance to a grid end that counts as reaching it, and the
# normal score given to the ends.
BOUND_THRESHOLD = 1e-7
NORMAL_LIMIT = 5.199337582605575


def design(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features as doubles in fixed order, missing as null."""
    return df.select(*keep, *[nan_to_null(F.col(f).cast("double")).alias(f) for f in features])


def _long(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                      for f in features])
    return df.select(*keys, F.explode(cells).alias("cell")).select(
        *keys, "cell.feature", "cell.x")


# --- quantile -> normal ----------------------------------------------------


def fit_quantile_grids(train: DataFrame, features: Sequence[str], fold: str = "fold",
                       n_quantiles: int = N_QUANTILES) -> dict[tuple[int, str], np.ndarray]:
    """(fold, feature) -> quantile grid of the fold's training rows, nulls ignored."""
    sizes = {row[0]: row[1] for row in
             train.groupBy(fold).agg(F.count(F.lit(1))).collect()}
    grids: dict[tuple[int, str], np.ndarray] = {}
    # A fold smaller than the grid gets a grid of its own size; folds that
    # share a grid size are fitted together.
    for size in sorted({min(n_quantiles, n) for n in sizes.values()}):
        members = [f for f, n in sizes.items() if min(n_quantiles, n) == size]
        rows = _long(train.where(F.col(fold).isin(*members)), [fold], features)
        probabilities = np.linspace(0.0, 1.0, size) if size > 1 else [0.0]
        found = exact_quantiles(rows, "x", list(probabilities), [fold, "feature"]).collect()
        for row in sorted(found, key=lambda r: r["q_index"]):
            grids.setdefault((row[fold], row["feature"]), []).append(row["quantile"])
    return {key: np.maximum.accumulate(np.array(values)) for key, values in grids.items()}


def rank_to_normal(values: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Position on the grid, averaged over both ends of flat parts, as a normal score."""
    references = np.linspace(0.0, 1.0, len(grid))
    out = np.full(len(values), np.nan)
    known = ~np.isnan(values)
    x = values[known]
    if len(grid) == 0 or len(x) == 0:
        return out
    rising = np.interp(x, grid, references)
    falling = np.interp(-x, -grid[::-1], -references[::-1])
    share = 0.5 * (rising - falling)
    share[x - BOUND_THRESHOLD < grid[0]] = 0.0
    share[x + BOUND_THRESHOLD > grid[-1]] = 1.0
    inside = (share > 0.0) & (share < 1.0)
    score = np.where(share <= 0.0, -NORMAL_LIMIT, NORMAL_LIMIT)
    # Shares repeat, on grids of few distinct values above all.
    distinct, back = np.unique(share[inside], return_inverse=True)
    score[inside] = np.array([*map(NormalDist().inv_cdf, distinct), 0.0])[back]
    out[known] = np.clip(score, -NORMAL_LIMIT, NORMAL_LIMIT)
    return out


def apply_quantile_grids(df: DataFrame, grids: dict[tuple[int, str], np.ndarray],
                         features: Sequence[str], fold: str = "fold") -> DataFrame:
    """Replace the features by their normal scores under their fold's grid."""
    shared = df.sparkSession.sparkContext.broadcast(grids)
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in features])
    empty = np.array([])

    @F.pandas_udf(schema)
    def score(folds: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        which = folds.to_numpy()
        out = {}
        for name, column in zip(features, columns):
            values = column.to_numpy(dtype="float64", na_value=np.nan)
            scored = np.full(len(values), np.nan)
            for one in np.unique(which):
                rows = which == one
                scored[rows] = rank_to_normal(values[rows],
                                              shared.value.get((int(one), name), empty))
            out[name] = scored
        return pd.DataFrame(out)

    scored = df.withColumn("_scores", score(F.col(fold), *[
        F.col(f).cast("double") for f in features]))
    replaced = [nan_to_null(F.col(f"_scores.{c}")).alias(c) if c in features else F.col(c)
                for c in df.columns]
    return scored.select(*replaced)


# --- impute and scale ------------------------------------------------------


@dataclass
class FoldScaling:
    """Per fold: medians, means and population deviations of each feature."""

    medians: dict[int, dict[str, float]] = field(default_factory=dict)
    means: dict[int, dict[str, float]] = field(default_factory=dict)
    deviations: dict[int, dict[str, float]] = field(default_factory=dict)


def _with_learned(df: DataFrame, fold: str,
                  **learned: tuple[dict[int, dict[str, float]], Sequence[str]]) -> DataFrame:
    """Add ``_<name>_<feature>`` to each row from its fold's values, null where it has none.

    One row per fold goes to the rows: a map of the folds inside the expressions would be
    built again for every row and feature.
    """
    folds = sorted({key for values, _ in learned.values() for key in values})
    schema = T.StructType([T.StructField(fold, df.schema[fold].dataType), *[
        T.StructField(f"_{name}_{f}", T.DoubleType())
        for name, (_, features) in learned.items() for f in features]])
    table = df.sparkSession.createDataFrame([(key, *[
        None if (x := values.get(key, {}).get(f)) is None else float(x)
        for values, features in learned.values() for f in features]) for key in folds], schema)
    return df.join(F.broadcast(table), fold, "left")


def fit_scaling(train: DataFrame, features: Sequence[str], fold: str = "fold") -> FoldScaling:
    """Exact medians, then moments of the imputed training rows."""
    fitted = FoldScaling()
    medians = exact_quantiles(_long(train, [fold], features), "x", [0.5], [fold, "feature"])
    for row in medians.collect():
        fitted.medians.setdefault(row[fold], {})[row["feature"]] = row["quantile"]
    imputed = impute(train, fitted, features, fold)
    moments = imputed.groupBy(fold).agg(
        *[F.avg(f).alias(f"{f}__mean") for f in features],
        *[F.stddev_pop(f).alias(f"{f}__sd") for f in features])
    for row in moments.collect():
        fitted.means[row[fold]] = {f: row[f"{f}__mean"] for f in features}
        fitted.deviations[row[fold]] = {f: row[f"{f}__sd"] or 1.0 for f in features}
    return fitted


def impute(df: DataFrame, fitted: FoldScaling, features: Sequence[str],
           fold: str = "fold") -> DataFrame:
    return _with_learned(df, fold, median=(fitted.medians, features)).select(*[
        F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")).alias(c)
        if c in features else F.col(c) for c in df.columns])


def standardise(df: DataFrame, fitted: FoldScaling, features: Sequence[str],
                fold: str = "fold") -> DataFrame:
    learned = _with_learned(df, fold, mean=(fitted.means, features),
                            deviation=(fitted.deviations, features))
    return learned.select(*[
        ((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_deviation_{c}")).alias(c)
        if c in features else F.col(c) for c in df.columns])


# --- estimators ------------------------------------------------------------


def _dot(features: Sequence[str]) -> Column:
    """Intercept plus weighted features, from joined columns _w_0, _w_1, .."""
    total = F.col("_w_0")
    for k, f in enumerate(features, start=1):
        total = total + F.col(f"_w_{k}") * F.col(f)
    return total


def _weight_table(spark: SparkSession, weights: dict[tuple, np.ndarray],
                  groups: Sequence[StructField]) -> DataFrame:
    """One row per group: its key and _w_0, _w_1, .."""
    width = len(next(iter(weights.values())))
    schema = T.StructType([*groups, *[T.StructField(f"_w_{k}", T.DoubleType())
                                      for k in range(width)]])
    return spark.createDataFrame([(*key, *map(float, w)) for key, w in weights.items()], schema)


def newton_sums(train: DataFrame, weights: DataFrame, features: Sequence[str],
                groups: Sequence[str], label: str) -> DataFrame:
    """Per group, under its weights: rows, loss, gradient and curvature of the loss.

    One aggregation with map-side partials over one scan, for all groups; its
    result has a row per group.
    """
    z, y = F.col("_z"), F.col(label).cast("double")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    rows = train.join(F.broadcast(weights), list(groups)).withColumn("_z", _dot(features)) \
        .withColumns({"_r": p - y, "_v": p * (F.lit(1.0) - p)})
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum(loss).alias("loss"),
        *[F.sum(F.col("_r") * v).alias(f"g_{i}") for i, v in enumerate(x)],
        *[F.sum(F.col("_v") * x[i] * x[j]).alias(f"h_{i}_{j}")
          for i in range(len(x)) for j in range(i, len(x))])


def fit_logistic_groups(train: DataFrame, features: Sequence[str], groups: Sequence[str],
                        label: str = "label_yoy", c: float = 1.0, max_steps: int = 60,
                        tol: float = 1e-9) -> dict[tuple, np.ndarray]:
    """Group -> intercept and weights of an L2 logistic regression.

    The penalty is 1/(2 C) on the summed loss, the intercept is free. Newton steps
    for all groups together: every step is one pass over one table. A step that
    doesn't lower a group's loss is halved; a group is done when its step is below
    ``tol``. Features must be free of nulls.
    """
    spark, width = train.sparkSession, len(features) + 1
    fields = [train.schema[g] for g in groups]
    ridge = np.r_[0.0, np.full(width - 1, 1.0 / c)]
    usable = train.where(F.col(label).isNotNull())
    keys = [tuple(r) for r in usable.select(*groups).distinct().collect()]
    at = {key: np.zeros(width) for key in keys}
    tried = dict(at)
    lowest = {key: np.inf for key in keys}
    steps: dict[tuple, np.ndarray] = {}
    open_keys = set(keys)
    for _ in range(max_steps):
        if not open_keys:
            break
        table = _weight_table(spark, {k: tried[k] for k in open_keys}, fields)
        for row in newton_sums(usable, table, features, groups, label).collect():
            key = tuple(row[g] for g in groups)
            w = tried[key]
            loss = row["loss"] + 0.5 * float(ridge @ (w * w))
            if loss > lowest[key] + 1e-12 * abs(lowest[key]):
                steps[key] = steps[key] / 2
                if np.abs(steps[key]).max() < tol:
                    open_keys.discard(key)
                else:
                    tried[key] = at[key] - steps[key]
                continue
            at[key], lowest[key] = w, loss
            gradient = np.array([row[f"g_{i}"] for i in range(width)]) + ridge * w
            curve = np.diag(ridge)
            for i in range(width):
                for j in range(i, width):
                    curve[i, j] += row[f"h_{i}_{j}"]
                    curve[j, i] = curve[i, j]
            # With one class the curvature vanishes: any step that lowers the loss will do.
            steps[key] = np.linalg.lstsq(curve, gradient, rcond=None)[0]
            if np.abs(steps[key]).max() < tol:
                open_keys.discard(key)
            else:
                tried[key] = w - steps[key]
    return at


def logistic_variants(assigned: DataFrame, features: Sequence[str],
                      variants: dict[str, Sequence[str]], *, fold: str = "fold",
                      label: str = "label_yoy", keep: Sequence[str] = (),
                      scored_role: str = "validate", c: float = 1.0,
                      threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Refit every variant on every fold: (scored rows, coefficients per fold and feature).

    ``variants`` maps a model's name to the features it takes as normal scores.
    Preprocessing is fitted for all folds in one pass each, and all folds of all
    variants share the passes of the regression.
    """
    rows = design(assigned.where(F.col("role").isin("train", scored_role)), features,
                  keep=[fold, "role", label, *keep])
    is_train = (F.col("role") == "train") & F.col(label).isNotNull()
    rows = settle(rows)
    parts = []
    for model, ranked in variants.items():
        mine = rows
        if ranked:
            grids = fit_quantile_grids(rows.where(is_train), ranked, fold)
            mine = settle(apply_quantile_grids(rows, grids, ranked, fold))
        fitted = fit_scaling(mine.where(is_train), features, fold)
        parts.append(standardise(impute(mine, fitted, features, fold), fitted, features, fold)
                     .where(F.col(fold).isin(*fitted.means)).withColumn("model", F.lit(model)))
    scaled = settle(reduce(lambda a, b: a.unionByName(b), parts))
    groups = [fold, "model"]
    weights = fit_logistic_groups(scaled.where(is_train), features, groups, label, c)
    spark = assigned.sparkSession
    if not weights:
        weights = {(0, ""): np.zeros(len(features) + 1)}
    table = _weight_table(spark, weights, [scaled.schema[g] for g in groups])
    scored = scaled.where(F.col("role") == scored_role).join(F.broadcast(table), groups) \
        .withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-_dot(features)))) \
        .select(fold, *keep, "model", F.col(label).alias("y_true"),
                decide(F.col("probability"), threshold).alias("prediction"), "probability")
    coefficients = [(int(key[0]), key[1], f, float(w))
                    for key, ws in sorted(weights.items()) for f, w in zip(features, ws[1:])
                    if key[1]]
    return scored, spark.createDataFrame(
        coefficients, f"{fold} int, model string, feature string, coefficient double")


def logistic_by_fold(assigned: DataFrame, features: Sequence[str], *, ranked: Sequence[str] = (),
                     model: str = "logistic_rank", **options) -> tuple[DataFrame, DataFrame]:
    """:func:`logistic_variants` of a single variant."""
    return logistic_variants(assigned, features, {model: ranked}, **options)


def trees_by_fold(assigned: DataFrame, features: Sequence[str], *, inner: bool = True,
                  fold: str = "fold", label: str = "label_yoy", keep: Sequence[str] = (),
                  scored_role: str = "validate", model: str = "boosted_inner_es",
                  threshold: float = 0.5, **options) -> tuple[DataFrame, DataFrame]:
    """Refit boosted trees per fold: (scored rows, best iteration per fold).

    ``inner=True`` stops on the last training year. ``inner=False`` trains on
    the whole window and stops on the scored rows: a biased diagnostic. Missing
    features stay missing; ``options`` are those of :class:`boosting.TreeOptions`.
    """
    train_role, stop_role = ("inner_train", "inner_validate") if inner else ("train", scored_role)
    rows = settle(design(assigned.where(F.col("role").isin(train_role, stop_role, scored_role)),
                         features, keep=[fold, "role", label, *keep]))
    role = F.col("role")
    sides = rows.where(F.col(label).isNotNull()).withColumn(
        "side", F.when(role == train_role, "train").when(role == stop_role, "stop"))
    fitted = boosting.fit(sides, features, fold=fold, label=label,
                          options=boosting.TreeOptions(**options))
    scored = boosting.with_probability(rows.where(role == scored_role), fitted, features, fold)
    spark = assigned.sparkSession
    return (scored.select(
        fold, *keep, F.lit(model).alias("model"), F.col(label).alias("y_true"),
        decide(F.col("probability"), threshold).alias("prediction"), "probability"),
        spark.createDataFrame([(int(one), model, e.best) for one, e in fitted.items()],
                              f"{fold} int, model string, best_iteration int"))


Fitter = Callable[[DataFrame], DataFrame]


def run_variants(assigned: DataFrame, fitters: dict[str, Fitter]) -> DataFrame:
    """Scored rows of every variant; each refits every fold from nothing."""
    return reduce(lambda a, b: a.unionByName(b), [fit(assigned) for fit in fitters.values()])
