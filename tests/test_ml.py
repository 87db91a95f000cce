from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import ml


def test_rank_to_normal_follows_its_definition():
    grid = np.array([0.0, 1.0, 1.0, 2.0, 4.0])
    got = ml.rank_to_normal(np.array([-5.0, 0.0, 0.5, 1.0, 3.0, 4.0, 9.0, np.nan]), grid)
    inv = NormalDist().inv_cdf
    # The flat part 1.0 spans shares 0.25 and 0.5 and takes their middle.
    want = [-ml.NORMAL_LIMIT, -ml.NORMAL_LIMIT, inv(0.125), inv(0.375), inv(0.875),
            ml.NORMAL_LIMIT, ml.NORMAL_LIMIT]
    np.testing.assert_allclose(got[:-1], want, atol=1e-12)
    assert np.isnan(got[-1])


def frame(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.1]
    p = 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] / 50 + 0.3)))
    data = pd.DataFrame(x, columns=["a", "b", "c"])
    data["label_yoy"] = (rng.random(n) < p).astype(int)
    data.loc[rng.random(n) < 0.1, "b"] = np.nan
    data["fold"] = 1
    data["role"] = np.where(np.arange(n) < n * 3 // 4, "train", "validate")
    return data


def newton(x, y, c=1.0):
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.0] + [1.0 / c] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (p - y) + ridge @ w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, gradient)
    return w


def reference_fit(data, ranked):
    """NumPy model of the fold pipeline: ranks, medians, scaling, Newton."""
    train, test = (data[data["role"] == role].copy() for role in ("train", "validate"))
    for name in ranked:
        grid = np.nanquantile(train[name], np.linspace(0, 1, min(1000, len(train))))
        for part in (train, test):
            part[name] = ml.rank_to_normal(part[name].to_numpy(), grid)
    features = ["a", "b", "c"]
    medians = train[features].median()
    train, test = train.fillna(medians), test.fillna(medians)
    mean, sd = train[features].mean(), train[features].std(ddof=0)
    w = newton(((train[features] - mean) / sd).to_numpy(), train["label_yoy"].to_numpy())
    z = ((test[features] - mean) / sd).to_numpy()
    return w, 1 / (1 + np.exp(-(w[0] + z @ w[1:])))


@pytest.mark.parametrize("ranked", [(), ("a", "b")])
def test_fold_pipeline_equals_numpy(spark, ranked):
    data = frame()
    data["id"] = range(len(data))
    scored, weights = ml.logistic_by_fold(
        spark.createDataFrame(data).withColumn("b", F.when(~F.isnan("b"), F.col("b"))),
        ["a", "b", "c"], ranked=ranked, keep=["id"])
    want, probability = reference_fit(data, ranked)
    got = [r.coefficient for r in weights.collect()]
    np.testing.assert_allclose(got, want[1:], atol=1e-7)
    p = scored.orderBy("id").toPandas()["probability"]
    np.testing.assert_allclose(p, probability, atol=1e-7)


def test_grouped_newton_equals_one_fit_per_group(spark):
    parts = []
    for seed, (name, n) in enumerate([("a", 300), ("b", 40), ("c", 900)]):
        part = frame(n, seed).fillna(0.0)
        part[["a", "b", "c"]] = (part[["a", "b", "c"]] - part[["a", "b", "c"]].mean()) \
            / part[["a", "b", "c"]].std()
        parts.append(part.assign(model=name, fold=seed))
    data = pd.concat(parts)
    train = spark.createDataFrame(data)
    got = ml.fit_logistic_groups(train, ["a", "b", "c"], ["fold", "model"], c=0.7)
    assert len(got) == 3
    for (fold, model), part in data.groupby(["fold", "model"]):
        want = newton(part[["a", "b", "c"]].to_numpy(), part["label_yoy"].to_numpy(), 0.7)
        np.testing.assert_allclose(got[fold, model], want, atol=1e-8)
    table = ml._weight_table(spark, got, [train.schema[g] for g in ("fold", "model")])
    plan = ml.newton_sums(train, table, ["a", "b", "c"], ["fold", "model"], "label_yoy") \
        ._jdf.queryExecution().optimizedPlan().toString()
    # All groups come from one scan of the rows, beside that of the weights.
    assert plan.count("LogicalRDD") == 2 or plan.count("LocalRelation") <= 2


def test_one_class_and_halved_steps(spark):
    flat = spark.createDataFrame([(1, float(k % 3), 1) for k in range(30)],
                                 "fold int, a double, label_yoy int")
    w = ml.fit_logistic_groups(flat, ["a"], ["fold"])[(1,)]
    assert w[0] > 5 and np.isfinite(w).all()
    far = spark.createDataFrame([(1, 1e3 * (k % 7), int(k % 7 > 2)) for k in range(70)],
                                "fold int, a double, label_yoy int")
    w = ml.fit_logistic_groups(far, ["a"], ["fold"])[(1,)]
    want = newton(np.array([[k % 7] for k in range(70)], float),
                  np.array([int(k % 7 > 2) for k in range(70)]), 1e6)
    assert abs(w[1] * 1e3 - want[1]) < 0.05 * want[1]


def test_what_folds_learn_comes_as_a_row_per_fold(spark):
    rows = spark.createDataFrame(
        [(1, 2.0), (1, None), (2, 8.0), (3, 1.0)], "fold int, a double")
    fitted = ml.FoldScaling({1: {"a": 4.0}, 2: {}}, {1: {"a": 3.0}, 2: {"a": 2.0}},
                            {1: {"a": 2.0}, 2: {"a": 3.0}})
    scaled = ml.standardise(ml.impute(rows, fitted, ["a"]), fitted, ["a"])
    assert scaled.columns == rows.columns
    got = sorted(((r.fold, r.a) for r in scaled.collect()), key=str)
    assert got == [(1, -0.5), (1, 0.5), (2, 2.0), (3, None)]
    # Not as a map that every row builds again for each feature.
    plan = scaled._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan and "element_at" not in plan
