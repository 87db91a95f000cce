"""Boosted trees over Spark against the same trees grown by plain loops."""

import math

import numpy as np
import pandas as pd
import pytest

from pitpanel.operators import boosting
from pitpanel.operators.boosting import TreeOptions

FEATURES = ["a", "b", "c"]


def frame(n, seed, fold):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float),
                         "c": rng.normal(size=n) * 10})
    p = 1 / (1 + np.exp(-(data["a"] * (data["b"] > 1) + (data["c"] > 3))))
    data["label_yoy"] = (rng.random(n) < p).astype(int)
    data.loc[rng.random(n) < 0.15, "a"] = np.nan
    data["fold"], data["side"] = fold, np.where(np.arange(n) % 4 == 3, "stop", "train")
    data["id"] = np.arange(n)
    return data


def table(spark, data):
    plain = data.astype(object).where(data.notna(), None)
    return spark.createDataFrame(
        list(plain.itertuples(index=False, name=None)),
        "a double, b double, c double, label_yoy int, fold int, side string, id long")


def soft(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g)


def slow_trees(data, o):
    """The same definition with loops: every cut of every feature, both ways for missing."""
    train, stop = data[data["side"] == "train"], data[data["side"] == "stop"]
    x, y = train[FEATURES].to_numpy(), train["label_yoy"].to_numpy()
    edges = [np.unique(np.nanquantile(x[:, k], np.arange(1, boosting.MAX_BINS)
                                      / boosting.MAX_BINS)) for k in range(x.shape[1])]
    start = math.log(y.mean() / (1 - y.mean()))
    margin, stop_margin = np.full(len(x), start), np.full(len(stop), start)
    sx, losses = stop[FEATURES].to_numpy(), []

    def grow(rows, stop_rows, depth):
        p = 1 / (1 + np.exp(-margin[rows]))
        g, h = y[rows] - p, p * (1 - p)
        score = lambda m: soft(g[m].sum(), o.l1) ** 2 / (h[m].sum() + o.l2)
        if depth == o.depth:
            return [(rows, stop_rows, o.step * soft(g.sum(), o.l1) / (h.sum() + o.l2))]
        best, cut = 1e-12, None
        for k in range(x.shape[1]):
            v = x[rows, k]
            for e in edges[k]:
                for missing_left in (True, False):
                    left = np.where(np.isnan(v), missing_left, v <= e)
                    if min(left.sum(), (~left).sum()) < o.min_leaf:
                        continue
                    gain = score(left) + score(~left) - score(np.ones(len(v), bool))
                    if gain > best + 1e-9:
                        best, cut = gain, (k, e, missing_left, left)
        if cut is None:
            return [(rows, stop_rows, o.step * soft(g.sum(), o.l1) / (h.sum() + o.l2))]
        k, e, missing_left, left = cut
        w = sx[stop_rows, k]
        stop_left = np.where(np.isnan(w), missing_left, w <= e)
        return grow(rows[left], stop_rows[stop_left], depth + 1) \
            + grow(rows[~left], stop_rows[~stop_left], depth + 1)

    for _ in range(o.max_trees):
        for rows, stop_rows, value in grow(np.arange(len(x)), np.arange(len(stop)), 0):
            margin[rows] += value
            stop_margin[stop_rows] += value
        sign = np.where(stop["label_yoy"] == 1, -1, 1)
        losses.append(np.logaddexp(0, sign * stop_margin).mean())
        if len(losses) - 1 - int(np.argmin(losses)) >= o.patience:
            break
    return losses


def test_trees_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(boosting, "MAX_BINS", 16)
    monkeypatch.setattr(boosting, "SETTLE_EVERY", 4)
    options = TreeOptions(max_trees=11, patience=3, depth=2, step=0.4, min_leaf=15,
                          row_share=1.0, column_share=1.0)
    folds = [frame(400, 1, 1), frame(260, 2, 2)]
    fitted = boosting.fit(table(spark, pd.concat(folds)).repartition(3), FEATURES,
                          options=options)
    assert sorted(fitted) == [1, 2]
    for one, data in zip((1, 2), folds):
        want = slow_trees(data, options)
        np.testing.assert_allclose(fitted[one].losses, want, atol=1e-9)
        assert fitted[one].best == int(np.argmin(want)) + 1


def test_patience():
    ensemble = boosting.Ensemble(0.0, [], TreeOptions(patience=3))
    for loss in (0.9, 0.8, 0.7, 0.71, 0.72):
        ensemble.note_loss(loss)
    assert (ensemble.best, ensemble.stopped) == (3, False)
    ensemble.note_loss(0.7)
    assert (ensemble.best, ensemble.stopped) == (3, True)


def test_scores_are_those_of_the_best_trees(spark):
    data = frame(500, 5, 3)
    options = TreeOptions(max_trees=9, patience=2, step=0.6, min_leaf=20, row_share=0.7,
                          column_share=0.7)
    rows = table(spark, data)
    one, two = (boosting.fit(rows, FEATURES, options=options)[3] for _ in range(2))
    assert one.losses == pytest.approx(two.losses, abs=1e-12)
    assert len(one.trees) >= one.best
    stop = boosting.with_probability(rows.where("side = 'stop'"), {3: one}, FEATURES).toPandas()
    p, y = stop["probability"], stop["label_yoy"]
    assert -np.mean(np.log(np.where(y == 1, p, 1 - p))) == pytest.approx(min(one.losses), abs=1e-9)
    assert min(one.losses) < one.losses[0]


def test_rows_are_held_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 150)
    data = pd.concat([frame(400, 1, 1), frame(260, 2, 2)])
    ensembles = {one: boosting.Ensemble(0.25, [np.array([0.0])] * 3, TreeOptions())
                 for one in (1, 2)}
    blocks = boosting._blocks(table(spark, data).coalesce(1), FEATURES, "fold", "label_yoy",
                              "side", ensembles).collect()
    assert len(blocks) <= 8
    assert sum(len(b.y) for b in blocks) == len(data)
    assert sum(sum(b.y) for b in blocks) == data["label_yoy"].sum()
    assert all(len(b.bins) == 3 * len(b.y) and len(b.margin) == 8 * len(b.y) for b in blocks)


def test_leaves_equal_a_walk_row_by_row():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 9, (3, 500)).astype(np.uint8)
    tree = boosting.Tree(np.array([0, 2, -1, 1, 0, 2, 1]), np.array([4, 3, 0, 1, 8, 2, 5]),
                         np.array([True, False, True, False, True, True, False]), np.zeros(8))
    for row, leaf in zip(bins.T, tree.leaf(bins, 3)):
        node = 0
        for _ in range(3):
            f = tree.feature[node]
            left = f < 0 or (tree.missing_left[node] if row[f] == 0 else row[f] <= tree.upto[node])
            node = 2 * node + (1 if left else 2)
        assert leaf == node - 7
