"""Plans and results under a key that holds a third of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import asof, evaluate, knowledge, profile, restatements
from pitpanel.operators.entities import fuzzy_pairs
from pitpanel.operators.ordered import exact_quantiles, value_counts

BASE = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 facts: one (entity, period) holds a third, with many values."""
    rng = random.Random(13)
    rows = []
    for i in range(6000):
        if i % 3 == 0:
            ticker, quarter = "hot", 0
        else:
            ticker, quarter = f"t{rng.randrange(60)}", rng.randrange(8)
        end = BASE + dt.timedelta(days=91 * quarter)
        rows.append((ticker, end, end + dt.timedelta(days=1 + rng.randrange(600)),
                     float(rng.randrange(1, 40)), f"{i:06d}"))
    return spark.createDataFrame(
        rows, "ticker string, period_end date, filed_date date, eps_diluted double, "
              "accn string").repartition(8).cache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_known_combines_before_the_shuffle(skewed):
    plan = plan_of(knowledge.first_known(skewed))
    assert "partial_min_by" in plan and "Window" not in plan


def test_unit_changes_reduce_values_before_joining(skewed):
    pdf = skewed.toPandas().sort_values(["filed_date", "accn"], ignore_index=True)
    key = ["ticker", "period_end"]
    opening = pdf.drop_duplicates(key)
    pairs = opening.merge(pdf.drop(index=opening.index), on=key, suffixes=("_was", "_is"))
    quotient = pairs.eps_diluted_was / pairs.eps_diluted_is
    pairs["factor"] = quotient.round()
    changed = (pairs.eps_diluted_was - pairs.eps_diluted_is).abs() > 1e-9
    near = (quotient / pairs.factor - 1).abs() <= 0.02
    found = pairs[changed & near & (pairs.factor >= 2)].groupby(["ticker", "factor"]).agg(
        opens=("filed_date_was", "max"), closes=("filed_date_is", "min"))
    events = restatements.detect_unit_changes(skewed)
    got = {(r.ticker, r.factor): (r.window_start, r.window_end) for r in events.collect()}
    assert got == {(t, int(f)): (r.opens, r.closes) for (t, f), r in found.iterrows()}
    plan = plan_of(events)
    assert "CartesianProduct" not in plan and "Window" not in plan


def test_gate_on_a_hot_entity_makes_no_pairs(spark, skewed):
    intervals = spark.createDataFrame(
        [("hot", BASE + dt.timedelta(days=2 * i), BASE + dt.timedelta(days=2 * i))
         for i in range(300)], "ticker string, start date, end date")
    rows = skewed.withColumn("prediction_date", F.date_add("filed_date", 1))
    flagged = asof.covered_at(rows, intervals)
    assert flagged.count() == rows.count()
    wrong = flagged.where(F.col("ticker") == "hot").where(
        F.col("in_index_at_prediction") != (
            (F.datediff("prediction_date", F.lit(BASE)) % 2 == 0)
            & (F.datediff("prediction_date", F.lit(BASE)) <= 598)))
    assert wrong.count() == 0
    assert "NestedLoop" not in plan_of(flagged)


def test_quantiles_of_a_hot_value_use_no_global_buffer(skewed):
    df = skewed.withColumn("x", F.when(F.col("ticker") == "hot", 7.0).otherwise(F.rand(3)))
    plan = plan_of(exact_quantiles(df, "x", [0.0, 0.5, 1.0]))
    assert "percentile" not in plan and "collect_list" not in plan
    # What it reads are counts per distinct value, combined before they are dealt.
    assert "ReadSchema: struct<n:bigint" in plan
    assert "partial_count" in plan_of(value_counts(df, "x"))


def test_anomalies_are_one_aggregation(skewed):
    plan = plan_of(profile.restatement_anomalies(skewed.withColumn(
        "filing_lag_days", F.datediff("filed_date", "period_end")), value="eps_diluted"))
    assert plan.count("Exchange hashpartitioning") <= 1 and "Join" not in plan


def test_fuzzy_candidates_avoid_frequent_grams(spark):
    """Names share one frequent word; candidates must not be all pairs."""
    rng = random.Random(17)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    names = ["INTERNATIONAL " + "".join(rng.choices(letters, k=14)) for _ in range(200)]
    near = [n[:-1] + ("A" if n[-1] != "A" else "B") for n in names]
    pairs = fuzzy_pairs(spark.createDataFrame([(n,) for n in near], "norm string"),
                        spark.createDataFrame([(n,) for n in names], "norm string"))
    found = {(r.target, r.name) for r in pairs.collect()}
    assert set(zip(near, names)) <= found and len(found) < 400


def test_year_ago_match_takes_one_window_over_the_rows_as_they_are(spark):
    rng = random.Random(5)
    days = {(f"t{i % 9}", rng.randrange(900)) for i in range(700)}
    rows = [(t, BASE + dt.timedelta(days=d), BASE + dt.timedelta(days=d + 7), float(i))
            for i, (t, d) in enumerate(sorted(days))] + [("t1", None, None, -1.0)]
    panel = spark.createDataFrame(
        rows, "ticker string, period_end date, filed_date date, eps_diluted double")
    matched = asof.year_ago_match(panel)
    assert "Generate" not in plan_of(matched) and "Union" not in plan_of(matched)
    assert matched.count() == len(rows)
    for r in matched.collect():
        near = [(abs((r.period_end - dt.timedelta(days=365) - p).days), p, f, v)
                for t, p, f, v in rows if t == r.ticker and p and r.period_end]
        near = [n for n in near if n[0] <= 45]
        assert (r.period_end_year_ago, r.filed_date_year_ago, r.eps_year_ago) \
            == (min(near)[1:] if near else (None, None, None))


def test_adjustment_does_not_fold_the_panel(spark):
    d = [BASE + dt.timedelta(days=k) for k in range(400)]
    panel = spark.createDataFrame(
        [("a", d[390], d[395], d[20], d[30], 12.0), ("a", d[391], d[51], d[20], d[30], 12.0),
         ("a", d[392], d[395], None, None, None), ("b", d[390], d[395], d[20], d[30], 8.0)],
        "ticker string, period_end date, filed_date date, period_end_year_ago date, "
        "filed_date_year_ago date, eps_year_ago double")
    events = spark.createDataFrame(
        [("a", 2, d[40], d[60], True), ("a", 3, d[45], d[55], True)],
        "ticker string, factor long, window_start date, window_end date, established boolean")
    adjusted = restatements.adjust_year_ago(panel, events)
    assert "first(" not in plan_of(adjusted)
    got = {(r.ticker, r.period_end): (r.split_factor_applied, r.split_ambiguous,
                                      r.eps_year_ago_adjusted) for r in adjusted.collect()}
    assert got == {("a", d[390]): (6, False, 2.0), ("a", d[391]): (1, True, 12.0),
                   ("a", d[392]): (1, False, None), ("b", d[390]): (1, False, 8.0)}


def test_binning_by_group_does_not_deal_rows_by_group(spark):
    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("model"),
        (F.col("id") / 400).alias("probability"), (F.col("id") % 3 == 0).cast("int").alias("y_true"))
    table = evaluate.calibration_table(rows, by=["model"])
    assert "BroadcastHashJoin" in plan_of(evaluate.with_quantile_bin(rows, by=["model"]))
    assert sorted((r.model, r.decile, r.n) for r in table.collect()) \
        == [(m, d, 20) for m in "ab" for d in range(10)]


def test_rank_correlation_computes_its_table_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x % 17)

    rows = spark.range(200).select(seen("id").alias("x"), (F.col("id") % 5).alias("y"))
    assert profile.spearman(rows, "x", "y").collect()[0].n == 200
    # The filter and the projection each call it.
    assert made.value <= 400


def test_fingerprint_query_has_no_fixed_number_of_tasks(spark):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["table_fingerprint"](spark, entry.SMOKE_DIR))
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan


def test_folds_read_written_features(spark, monkeypatch):
    from pitpanel.catalog import evaluation
    from pitpanel.catalog.proxies import part_features

    def windows(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Window")

    folder, written, real = "/root/testdata/sf0.001", [], evaluation.settle
    monkeypatch.setattr(evaluation, "settle", lambda df: written.append(windows(df)) or real(df))
    scores = evaluation.quantile_to_normal(spark, folder)
    # The chain runs once for all folds and roles, and nothing after it runs it again.
    assert written == [windows(part_features(spark, folder))] and windows(scores) == 0
