"""Lags, streaks, gates and profiles of the feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pitpanel.catalog.proxies import (
    FEATURE_CHAIN, FIRST_SQL, HORIZON, KEPT_SQL, LABEL_CHAIN, LAG_CAP, MATCHED_SQL,
    PART_FACTS_SQL, STUDY_END, STUDY_START, SUPPLIER_FACTS_SQL, TIES, part_facts,
    part_features, part_panel, rounded, supplier_facts, table, with_ctes,
)
from pitpanel.catalog.registry import Catalog
from pitpanel.operators import features, gates, knowledge, profile
from pitpanel.plans.panel import panel_violations

catalog = Catalog()

LABEL_LAGS = [f"label_lag_{k}" for k in (1, 2, 3, 4)]
GROWTH_LAGS = [f"eps_growth_yoy_lag_{k}" for k in (1, 2, 3, 4)]
MODEL_SQL = ", ".join(features.MODEL_FEATURES)


@catalog.add(with_ctes(*FEATURE_CHAIN, select=f"""
  SELECT ticker, period_end, {", ".join(f"round({c}, 6) AS {c}" for c in
                                        ("eps_growth_yoy", "growth_acceleration", *GROWTH_LAGS))},
         {", ".join(LABEL_LAGS)}, growth_streak, quarters_available,
         {", ".join(features.AUDIT_COLUMNS)} FROM features"""))
def leakage_safe_features(spark, sf_dir):
    built = part_features(spark, sf_dir)
    return rounded(built.select("ticker", "period_end", *features.FEATURE_COLUMNS,
                                *features.AUDIT_COLUMNS),
                   "eps_growth_yoy", "growth_acceleration", *GROWTH_LAGS)


@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT ticker, period_end, quarters_available FROM features"""))
def decision_order_rank(spark, sf_dir):
    return features.with_rank(part_panel(spark, sf_dir)).select(
        "ticker", "period_end", "quarters_available")


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT a.ticker, a.period_end, b.label_yoy AS label_yoy_lag_2,
         b.prediction_date AS prediction_date_lag_2
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prediction_date) AS r
        FROM panel) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prediction_date) AS r
        FROM panel) b ON a.ticker = b.ticker AND a.r = b.r + 2"""))
def lag_by_rank(spark, sf_dir):
    lagged = features.with_lags(part_panel(spark, sf_dir), ["label_yoy"], [2])
    return lagged.select("ticker", "period_end", "label_yoy_lag_2", "prediction_date_lag_2")


@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT growth_streak, count(*) AS n,
         round(count(*) / (SELECT count(*) FROM features), 6) AS share,
         round(avg(CAST(label_yoy AS DOUBLE)), 6) AS label_rate,
         count(CASE WHEN quarters_available = 0 THEN 1 END) AS n_without_history
  FROM features GROUP BY growth_streak"""))
def streak_distribution(spark, sf_dir):
    return rounded(profile.streak_distribution(part_features(spark, sf_dir)),
                   "share", "label_rate")


# --- gates -----------------------------------------------------------------


def _counted(checks):
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("gate"), "n")
             for name, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _gate_sql(checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS gate, ({sql}) AS n"
                              for name, sql in checks.items())


# The gates run on first filings, which break the panel's window and lag rules.
@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, select=_gate_sql({
    "duplicate key": "SELECT count(*) FROM (SELECT 1 FROM first_rows GROUP BY ticker, "
                     "period_end HAVING count(*) > 1)",
    "decision not after period": "SELECT count(*) FROM first_rows "
                                 "WHERE filed_date + 1 <= period_end",
    "missing filing date": "SELECT count(*) FROM first_rows WHERE filed_date IS NULL",
    "decision is not the day after filing": "SELECT 0",
    "filing lag over the cap": f"SELECT count(*) FROM first_rows "
                               f"WHERE filing_lag_days > {LAG_CAP}",
    "outside the study window": f"SELECT count(*) FROM first_rows WHERE period_end NOT BETWEEN "
                                f"DATE '{STUDY_START}' AND DATE '{STUDY_END}'",
})))
def panel_gates(spark, sf_dir):
    first = knowledge.with_decision_date(
        knowledge.first_known(part_facts(spark, sf_dir), ties=TIES))
    return _counted(panel_violations(first, STUDY_START, STUDY_END, max_lag_days=LAG_CAP,
                                     gated=False))


@catalog.add(with_ctes(PART_FACTS_SQL, select="""
  SELECT ticker, period_end, count(*) AS n FROM facts
  GROUP BY ticker, period_end HAVING count(*) > 1"""))
def duplicate_keys(spark, sf_dir):
    return gates.duplicate_keys(part_facts(spark, sf_dir), ["ticker", "period_end"])


@catalog.add(with_ctes(SUPPLIER_FACTS_SQL, select="""
  SELECT ticker, filed_date AS prediction_date, count(*) AS n FROM facts
  GROUP BY ticker, filed_date HAVING count(*) > 1"""))
def decision_ties(spark, sf_dir):
    facts = supplier_facts(spark, sf_dir).withColumn("prediction_date", F.col("filed_date"))
    return gates.ties(facts)


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT max(prediction_date) AS latest FROM panel
  HAVING max(prediction_date) >= DATE '2001-01-01'"""))
def boundary_gate(spark, sf_dir):
    return gates.beyond_boundary(part_panel(spark, sf_dir), "2001-01-01")


# The features of the period order, not of the decision order, would leak.
@catalog.add(with_ctes(*LABEL_CHAIN, """period_lags AS (
  SELECT ticker, period_end, prediction_date,
         lead(prediction_date, 1) OVER w AS next_decision,
         lead(label_yoy, 1) OVER w AS next_label
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY period_end))""", select="""
  SELECT violation, count(*) AS n FROM (
    SELECT 'lag 1 not strictly earlier' AS violation FROM period_lags
    WHERE next_decision >= prediction_date
    UNION ALL SELECT 'label_lag_1 without source' FROM period_lags
    WHERE next_decision IS NULL AND next_label IS NOT NULL) GROUP BY violation"""))
def leakage_gate_on_leaky_lags(spark, sf_dir):
    from pyspark.sql import Window

    ahead = Window.partitionBy("ticker").orderBy("period_end")
    leaky = part_panel(spark, sf_dir).select(
        "ticker", "period_end", "prediction_date",
        F.lead("prediction_date").over(ahead).alias("prediction_date_lag_1"),
        F.lead("label_yoy").over(ahead).alias("label_lag_1"))
    return profile.counts_by(gates.lag_leaks(leaky, values=["label"], lags=[1]), "violation")


@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT 'leaks' AS gate, (SELECT count(*) FROM features
    WHERE prediction_date_lag_1 >= prediction_date OR prediction_date_lag_2 >= prediction_date
       OR prediction_date_lag_3 >= prediction_date OR prediction_date_lag_4 >= prediction_date)
    AS n
  UNION ALL SELECT 'impossible history', (SELECT count(*) FROM features
    WHERE growth_streak NOT BETWEEN 0 AND 8 OR growth_streak > quarters_available)
  UNION ALL SELECT 'infinite', (SELECT count(*) FROM features WHERE isinf(eps_growth_yoy))
  UNION ALL SELECT 'tied decisions', (SELECT count(*) FROM (SELECT 1 FROM features
    GROUP BY ticker, prediction_date HAVING count(*) > 1))"""))
def feature_gates(spark, sf_dir):
    built = part_features(spark, sf_dir)
    return _counted({
        "leaks": gates.lag_leaks(built),
        "impossible history": gates.impossible_history(built),
        "infinite": gates.infinite_values(built, ["eps_growth_yoy", "growth_acceleration",
                                                  *GROWTH_LAGS]),
        "tied decisions": gates.ties(built)})


@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT 'clean' AS injection, 0 AS injected, 0 AS caught
  UNION ALL SELECT 'lag decided on the same day', CAST(count(prediction_date_lag_1) > 0 AS INT),
                   CAST(count(prediction_date_lag_1) > 0 AS INT) FROM features
  UNION ALL SELECT 'lag decided later', CAST(count(prediction_date_lag_1) > 0 AS INT),
                   CAST(count(prediction_date_lag_1) > 0 AS INT) FROM features
  UNION ALL SELECT 'lag value without source row',
                   CAST(count(*) > count(prediction_date_lag_1) AS INT),
                   CAST(count(*) > count(prediction_date_lag_1) AS INT) FROM features"""))
def leakage_fire_test(spark, sf_dir):
    report = gates.fire_test(part_features(spark, sf_dir))
    return report.select("injection", F.col("injected").cast("int").alias("injected"),
                         F.col("caught").cast("int").alias("caught"))


@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT (SELECT count(*) FROM features) AS n_built, (SELECT count(*) FROM panel) AS n_source,
         (SELECT count(*) FROM panel p JOIN features f USING (ticker, period_end)
          WHERE p.eps_diluted IS DISTINCT FROM f.eps_diluted
             OR p.label_yoy IS DISTINCT FROM f.label_yoy) AS n_altered"""))
def panel_preserved(spark, sf_dir):
    panel = part_panel(spark, sf_dir)
    built = features.build_features(panel)
    altered = gates.altered_rows(built, panel, ["ticker", "period_end"],
                                 ["eps_diluted", "label_yoy"])
    count = F.count(F.lit(1))
    return built.agg(count.alias("n_built")).join(
        F.broadcast(panel.agg(count.alias("n_source")))).join(
        F.broadcast(altered.agg(count.alias("n_altered"))))


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, KEPT_SQL, select="""
  SELECT (SELECT count(*) FROM first_rows) AS n_built, (SELECT count(*) FROM kept) AS n_source
  WHERE (SELECT count(*) FROM first_rows) <> (SELECT count(*) FROM kept)"""))
def row_count_parity(spark, sf_dir):
    first = knowledge.first_known(part_facts(spark, sf_dir), ties=TIES)
    return gates.row_count_gap(first, knowledge.split_by_lag(first, LAG_CAP)[0])


# Fingerprints must not depend on row order or partitioning, only on content.
@catalog.add("SELECT count(*) AS n_rows, 0 AS n_reordered_changes, 1 AS n_content_changes "
             "FROM lineitem")
def table_fingerprint(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    before = gates.fingerprint(line)
    moved = gates.fingerprint(line.repartition("l_partkey"))
    edited = gates.fingerprint(line.withColumn("l_tax", F.col("l_tax") + F.lit(0.01)))
    changed = F.count(F.lit(1)).cast("int")
    return before.select("n_rows").join(F.broadcast(
        gates.fingerprint_change(before, moved).agg(changed.alias("n_reordered_changes")))) \
        .join(F.broadcast(gates.fingerprint_change(before, edited).agg(
            changed.alias("n_content_changes"))))


@catalog.add(f"""
  SELECT max(CAST(l_shipdate AS DATE)) AS latest, v.violation FROM lineitem,
         (VALUES ('cut is past the membership horizon'),
                 ('table already holds later rows')) v(violation)
  WHERE DATE '2001-06-30' > DATE '2001-01-01' GROUP BY v.violation
  HAVING max(CAST(l_shipdate AS DATE)) > DATE '2001-06-30'""")
def invalid_cut(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("prediction_date"))
    return gates.invalid_cut(line, "2001-06-30", today=HORIZON, horizon="2001-01-01")


# --- profiles --------------------------------------------------------------


@catalog.add(with_ctes(*FEATURE_CHAIN, select=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, "
    f"round((count(*) - count({c})) / count(*), 6) AS share FROM features"
    for c in features.FEATURE_COLUMNS)))
def null_profile(spark, sf_dir):
    return rounded(profile.null_profile(part_features(spark, sf_dir), features.FEATURE_COLUMNS),
                   "share")


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in LABEL_LAGS)


@catalog.add(with_ctes(*FEATURE_CHAIN, select=f"""
  SELECT count(*) AS n_rows, count(CASE WHEN {_COMPLETE} THEN 1 END) AS n_complete,
         count(CASE WHEN {_COMPLETE} AND label_yoy IS NOT NULL THEN 1 END)
           AS n_complete_labelled,
         round(count(CASE WHEN {_COMPLETE} THEN 1 END) / count(*), 6) AS share_complete
  FROM features"""))
def completeness(spark, sf_dir):
    return rounded(profile.completeness(part_features(spark, sf_dir), LABEL_LAGS),
                   "share_complete")


@catalog.add(with_ctes(*FEATURE_CHAIN, select=f"""
  SELECT complete, count(*) AS n_rows, count(DISTINCT ticker) AS n_entities,
         count(label_yoy) AS n_labelled,
         round(avg(CAST(label_yoy AS DOUBLE)), 6) AS positive_rate,
         round(avg(CAST(is_removed_name AS DOUBLE)), 6) AS removed_share,
         min(period_end) AS first_period, max(period_end) AS last_period,
         quantile_cont(CAST(quarters_available AS DOUBLE), 0.5) AS median_history
  FROM (SELECT *, {_COMPLETE} AS complete FROM features) GROUP BY complete"""))
def attrition(spark, sf_dir):
    return rounded(profile.attrition(part_features(spark, sf_dir), LABEL_LAGS),
                   "positive_rate", "removed_share")


@catalog.add(with_ctes(*FEATURE_CHAIN, select=f"""
  SELECT CAST(year(period_end) AS INTEGER) AS year, count(*) AS n FROM features
  WHERE NOT ({_COMPLETE}) GROUP BY 1"""))
def losses_by_year(spark, sf_dir):
    return profile.losses_by_year(part_features(spark, sf_dir), LABEL_LAGS)


@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT count(CASE WHEN CAST(eps_growth_yoy > 0 AS INTEGER) = label_yoy THEN 1 END)
           AS n_reproduced,
         count(CASE WHEN eps_growth_yoy IS NOT NULL AND label_yoy IS NOT NULL THEN 1 END)
           AS n_usable, TRUE AS is_identity FROM features"""))
def target_identity(spark, sf_dir):
    return profile.target_identity(part_features(spark, sf_dir))


@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT count(*) AS n, round(corr(eps_growth_yoy_lag_1, label_yoy), 6) AS pearson
  FROM features WHERE eps_growth_yoy_lag_1 IS NOT NULL AND label_yoy IS NOT NULL"""))
def pearson_feature_label(spark, sf_dir):
    return rounded(profile.pearson(part_features(spark, sf_dir), "eps_growth_yoy_lag_1",
                                   "label_yoy"), "pearson")


def _average_rank(column: str) -> str:
    return (f"rank() OVER (ORDER BY {column}) + "
            f"(count(*) OVER (PARTITION BY {column}) - 1) / 2.0")


@catalog.add(with_ctes(*FEATURE_CHAIN, select=f"""
  SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM (
    SELECT {_average_rank('eps_growth_yoy_lag_1')} AS rx, {_average_rank('label_yoy')} AS ry
    FROM features WHERE eps_growth_yoy_lag_1 IS NOT NULL AND label_yoy IS NOT NULL)"""))
def spearman_feature_label(spark, sf_dir):
    return rounded(profile.spearman(part_features(spark, sf_dir), "eps_growth_yoy_lag_1",
                                    "label_yoy"), "spearman")


@catalog.add(f"""
  SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM (
    SELECT {_average_rank('l_extendedprice')} AS rx, {_average_rank('l_quantity')} AS ry
    FROM lineitem)""")
def spearman_prices(spark, sf_dir):
    return rounded(profile.spearman(table(spark, sf_dir, "lineitem"), "l_extendedprice",
                                    "l_quantity"), "spearman")


@catalog.add("""
  WITH x AS (SELECT l_extendedprice AS x, CAST(l_quantity > 25 AS INTEGER) AS y FROM lineitem),
  cuts AS (SELECT DISTINCT unnest(quantile_cont(x, [i / 255.0 FOR i IN range(0, 256)])) AS cut
           FROM x),
  counted AS (SELECT x, count(*) AS n, sum(y) AS pos FROM x GROUP BY x),
  scored AS (
    SELECT cut, (SELECT count(*) FROM x) AS n, (SELECT sum(y) FROM x) AS pos,
           sum(CASE WHEN c.x <= cut THEN c.n - c.pos ELSE c.pos END) AS right_above
    FROM cuts, counted c GROUP BY cut),
  sides AS (SELECT cut, n, pos, right_above AS correct, 0 AS mirror FROM scored
            UNION ALL SELECT cut, n, pos, n - right_above, 1 FROM scored),
  best AS (SELECT * FROM sides ORDER BY correct DESC, cut, mirror LIMIT 1)
  SELECT round(correct / n, 6) AS accuracy, round(cut, 6) AS cut,
         round(greatest(pos / n, 1 - pos / n), 6) AS baseline, CAST(n AS BIGINT) AS n
  FROM best""")
def best_threshold(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_extendedprice", (F.col("l_quantity") > 25).cast("int").alias("label"))
    return rounded(profile.best_threshold(line, "l_extendedprice", "label"),
                   "accuracy", "cut", "baseline")


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT is_removed_name, CAST(grouping(is_removed_name) AS INTEGER) AS is_total,
         count(*) AS n_labelled, CAST(sum(label_yoy) AS BIGINT) AS n_positive,
         round(avg(CAST(label_yoy AS DOUBLE)), 6) AS positive_rate,
         grouping(is_removed_name) = 1 AND avg(CAST(label_yoy AS DOUBLE))
           NOT BETWEEN 0.40 AND 0.65 AS out_of_band
  FROM panel WHERE label_yoy IS NOT NULL GROUP BY ROLLUP (is_removed_name)"""))
def label_balance(spark, sf_dir):
    return rounded(profile.label_balance(part_panel(spark, sf_dir), "is_removed_name"),
                   "positive_rate")


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT round(a, 6) AS rate_flagged, round(b, 6) AS rate_rest, round(a - b, 6) AS gap
  FROM (SELECT avg(CAST(label_yoy AS DOUBLE)) FILTER (is_removed_name) AS a,
               avg(CAST(label_yoy AS DOUBLE)) FILTER (NOT is_removed_name) AS b FROM panel)"""))
def label_gap(spark, sf_dir):
    return rounded(profile.label_gap(part_panel(spark, sf_dir), "is_removed_name"),
                   "rate_flagged", "rate_rest", "gap")


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT CAST(year(period_end) AS INTEGER) AS year, count(*) AS n FROM panel GROUP BY 1"""))
def rows_per_year(spark, sf_dir):
    return profile.rows_per_year(part_panel(spark, sf_dir))


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT count(*) AS n_entities, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_rows,
         count(CASE WHEN n < 16 THEN 1 END) AS n_thin,
         CAST(coalesce(sum(CASE WHEN n < 16 THEN n END), 0) AS BIGINT) AS rows_in_thin,
         round(coalesce(sum(CASE WHEN n < 16 THEN n END), 0) / sum(n), 6) AS share_in_thin
  FROM (SELECT ticker, count(*) AS n FROM panel GROUP BY ticker)"""))
def panel_depth(spark, sf_dir):
    return rounded(profile.depth(part_panel(spark, sf_dir), thin_below=16), "share_in_thin")


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, KEPT_SQL, MATCHED_SQL, select="""
  SELECT ticker, CAST(coalesce(CAST(trunc(quantile_cont(CAST(step AS DOUBLE), 0.5)) AS INTEGER),
                               91) AS INTEGER) AS quarter_gap_days
  FROM (
    SELECT ticker, nth, period_end - lead(period_end) OVER (PARTITION BY ticker ORDER BY nth)
             AS step
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filed_date DESC,
                 period_end DESC) AS nth FROM kept) WHERE nth <= 8)
  GROUP BY ticker"""))
def recent_quarter_step(spark, sf_dir):
    kept, _ = knowledge.split_by_lag(
        knowledge.first_known(part_facts(spark, sf_dir), ties=TIES), LAG_CAP)
    return profile.recent_step(knowledge.with_decision_date(kept))
