"""Folds, metrics, calibration, comparison, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.catalog.proxies import (
    CONSTANT_SQL, FEATURE_CHAIN, METRICS_CHAIN, METRICS_SQL, SCORED_SQL, fold_metrics,
    part_features, part_panel, rounded, scored_lines, scored_with_constant, table, with_ctes,
)
from pitpanel.catalog.registry import Catalog
from pitpanel.operators import evaluate, gates, ml, ordered, profile
from pitpanel.operators.features import MODEL_FEATURES, RANKED_FEATURES
from pitpanel.operators.knowledge import labelled_rows
from pitpanel.plans import walkforward
from pitpanel.session import settle

catalog = Catalog()

METRIC_COLUMNS = ("positive_rate", "log_loss", "accuracy", "brier", "predicted_positive_rate")
MODELS = ("constant", "price", "quantity")


def _rounds(columns, prefix=""):
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in columns)


@catalog.add(with_ctes(*METRICS_CHAIN, select=f"""
  SELECT fold, model, n, {_rounds(METRIC_COLUMNS)} FROM metrics"""))
def fold_model_metrics(spark, sf_dir):
    return rounded(fold_metrics(spark, sf_dir), *METRIC_COLUMNS)


@catalog.add(with_ctes(SCORED_SQL, CONSTANT_SQL, select="""
  SELECT fold, count(*) AS n, round(max(probability), 6) AS probability,
         round(avg(CAST(y_true AS DOUBLE)), 6) AS realised
  FROM all_scored WHERE model = 'constant' GROUP BY fold"""))
def constant_baseline(spark, sf_dir):
    constant = scored_with_constant(spark, sf_dir).where(F.col("model") == "constant")
    return rounded(constant.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.max("probability").alias("probability"),
        F.avg(F.col("y_true").cast("double")).alias("realised")), "probability", "realised")


@catalog.add(with_ctes(*METRICS_CHAIN, select=f"""
  SELECT model, count(*) AS n_folds, {", ".join(
    f"round({sql}, 6) AS {name}" for sql, name in (
        ("avg(log_loss)", "mean_log_loss"), ("stddev_samp(log_loss)", "sd_log_loss"),
        ("avg(accuracy)", "mean_accuracy"), ("avg(brier)", "mean_brier")))}
  FROM metrics GROUP BY model"""))
def mean_of_folds(spark, sf_dir):
    return rounded(evaluate.mean_of_folds(fold_metrics(spark, sf_dir)),
                   "mean_log_loss", "sd_log_loss", "mean_accuracy", "mean_brier")


@catalog.add(with_ctes(SCORED_SQL, CONSTANT_SQL,
                       METRICS_SQL.replace("fold, model, count", "model, count")
                       .replace("GROUP BY fold, model", "GROUP BY model"), select=f"""
  SELECT model, n, {_rounds(METRIC_COLUMNS)} FROM metrics"""))
def pooled_metrics(spark, sf_dir):
    return rounded(evaluate.binary_metrics(scored_with_constant(spark, sf_dir), ["model"]),
                   *METRIC_COLUMNS)


POOLED_COLUMNS = ("actual_positive_rate", "log_loss", "constant_log_loss", "accuracy",
                  "constant_accuracy", "brier", "log_loss_delta", "accuracy_delta")


@catalog.add(with_ctes(SCORED_SQL, CONSTANT_SQL, """pooled AS (
  SELECT count(*) AS n_labelled, avg(CAST(y_true AS DOUBLE)) AS actual_positive_rate,
    avg(-(CASE WHEN y_true = 1 THEN ln(probability) ELSE ln(1 - probability) END)) AS log_loss,
    avg(-(CASE WHEN y_true = 1 THEN ln(rate) ELSE ln(1 - rate) END)) AS constant_log_loss,
    avg(CAST(prediction = y_true AS DOUBLE)) AS accuracy,
    avg(CAST(y_true = 1 AS DOUBLE)) AS constant_accuracy,
    avg(power(probability - y_true, 2)) AS brier
  FROM all_scored JOIN train_rates USING (fold) WHERE model = 'price')""", select=f"""
  SELECT n_labelled, {_rounds(POOLED_COLUMNS[:6])},
         round(log_loss - constant_log_loss, 6) AS log_loss_delta,
         round(accuracy - constant_accuracy, 6) AS accuracy_delta,
         log_loss < constant_log_loss AS passes_log_loss,
         accuracy > constant_accuracy AS passes_accuracy,
         log_loss < constant_log_loss AND accuracy > constant_accuracy AS passes_both
  FROM pooled"""))
def pooled_verdict(spark, sf_dir):
    scored = scored_with_constant(spark, sf_dir)
    rates = scored.where(F.col("model") == "constant").groupBy("fold").agg(
        F.max("probability").alias("train_positive_rate"))
    return rounded(evaluate.pooled_against_constant(
        scored.where(F.col("model") == "price"), rates), *POOLED_COLUMNS)


@catalog.add(with_ctes(*METRICS_CHAIN, select="""
  SELECT m.fold, m.model, round(m.log_loss - c.log_loss, 6) AS log_loss_delta,
         round(m.accuracy - c.accuracy, 6) AS accuracy_delta,
         m.log_loss < c.log_loss AS passes_log_loss, m.accuracy > c.accuracy AS passes_accuracy,
         m.log_loss < c.log_loss AND m.accuracy > c.accuracy AS passes_both
  FROM metrics m JOIN metrics c ON m.fold = c.fold AND c.model = 'constant'
  WHERE m.model <> 'constant'"""))
def fold_verdicts(spark, sf_dir):
    table_ = evaluate.against_constant(fold_metrics(spark, sf_dir))
    return rounded(table_.where(F.col("model") != "constant").select(
        "fold", "model", "log_loss_delta", "accuracy_delta", "passes_log_loss",
        "passes_accuracy", "passes_both"), "log_loss_delta", "accuracy_delta")


@catalog.add(with_ctes(*METRICS_CHAIN, select="""
  SELECT fold, round(max(log_loss) FILTER (model = 'constant'), 6) AS constant,
         round(max(log_loss) FILTER (model = 'price'), 6) AS price,
         round(max(log_loss) FILTER (model = 'quantity'), 6) AS quantity,
         round(min(log_loss), 6) AS lowest FROM metrics GROUP BY fold"""))
def fold_model_matrix(spark, sf_dir):
    return rounded(evaluate.fold_model_matrix(fold_metrics(spark, sf_dir), MODELS),
                   *MODELS, "lowest")


@catalog.add(with_ctes(*METRICS_CHAIN, select="""
  SELECT model, round(avg(log_loss), 6) AS mean, count(CASE WHEN log_loss = low THEN 1 END) AS wins
  FROM (SELECT *, min(log_loss) OVER (PARTITION BY fold) AS low FROM metrics) GROUP BY model"""))
def fold_wins(spark, sf_dir):
    matrix = evaluate.fold_model_matrix(fold_metrics(spark, sf_dir), MODELS)
    return rounded(evaluate.fold_wins(matrix, MODELS), "mean")


PAIRED_SQL = """paired AS (
  SELECT a.fold, a.log_loss AS log_loss_before, b.log_loss AS log_loss_after,
         b.log_loss - a.log_loss AS log_loss_delta, a.accuracy AS accuracy_before,
         b.accuracy AS accuracy_after, b.accuracy - a.accuracy AS accuracy_delta
  FROM metrics a JOIN metrics b ON a.fold = b.fold
  WHERE a.model = 'price' AND b.model = 'quantity')"""
PAIRED_COLUMNS = ("log_loss_before", "log_loss_after", "log_loss_delta", "accuracy_before",
                  "accuracy_after", "accuracy_delta")


@catalog.add(with_ctes(*METRICS_CHAIN, PAIRED_SQL, select=f"""
  SELECT fold, {_rounds(PAIRED_COLUMNS)} FROM paired"""))
def before_after(spark, sf_dir):
    return rounded(evaluate.compare_models(fold_metrics(spark, sf_dir), "price", "quantity"),
                   *PAIRED_COLUMNS)


@catalog.add(with_ctes(*METRICS_CHAIN, PAIRED_SQL, select="""
  SELECT count(*) AS n_folds, round(avg(log_loss_delta), 6) AS mean_difference,
         round(stddev_samp(log_loss_delta) / sqrt(count(*)), 6) AS standard_error,
         round(avg(log_loss_delta) / (stddev_samp(log_loss_delta) / sqrt(count(*))), 4)
           AS t_statistic, count(CASE WHEN log_loss_delta > 0 THEN 1 END) AS folds_won
  FROM paired"""))
def paired_t(spark, sf_dir):
    compared = evaluate.compare_models(fold_metrics(spark, sf_dir), "price", "quantity")
    return rounded(rounded(evaluate.paired_t(compared), "mean_difference", "standard_error"),
                   "t_statistic", digits=4)


@catalog.add(with_ctes(*METRICS_CHAIN, select="""
  SELECT m.model, round(avg(m.log_loss), 6) AS mean_log_loss,
         round(stddev_samp(m.log_loss), 6) AS sd,
         count(CASE WHEN m.log_loss < c.log_loss THEN 1 END) AS folds_beating_constant,
         CAST(row_number() OVER (ORDER BY avg(m.log_loss), m.model) AS INTEGER) AS rank
  FROM metrics m JOIN metrics c ON m.fold = c.fold AND c.model = 'constant' GROUP BY m.model"""))
def model_ranking(spark, sf_dir):
    return rounded(evaluate.rank_models(fold_metrics(spark, sf_dir), MODELS),
                   "mean_log_loss", "sd")


@catalog.add(with_ctes(*METRICS_CHAIN, """means AS (
  SELECT model, avg(log_loss) AS m, row_number() OVER (ORDER BY avg(log_loss), model) AS place
  FROM metrics GROUP BY model),
duel AS (
  SELECT w.fold, r.log_loss - w.log_loss AS d FROM metrics w JOIN metrics r ON w.fold = r.fold
  WHERE w.model = (SELECT model FROM means WHERE place = 1)
    AND r.model = (SELECT model FROM means WHERE place = 2))""", select="""
  SELECT (SELECT model FROM means WHERE place = 1) AS best_model,
         (SELECT model FROM means WHERE place = 2) AS runner_up,
         round(avg(d), 6) AS margin, count(CASE WHEN d > 0 THEN 1 END) AS folds_won,
         abs(avg(d) / (stddev_samp(d) / sqrt(count(*)))) < 2 AS is_tie FROM duel"""))
def freeze_choice(spark, sf_dir):
    choice = evaluate.freeze_choice(fold_metrics(spark, sf_dir), MODELS)
    return rounded(choice.select("best_model", "runner_up", "margin", "folds_won", "is_tie"),
                   "margin")


def _bins_sql(where: str) -> str:
    return f"""edges AS (
  SELECT list_distinct(list_slice(quantile_cont(probability,
           [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), 2, 11)) AS inner_edges,
         min(probability) AS lowest FROM scored WHERE {where}),
binned AS (
  SELECT s.*, CAST(len(list_filter(list_filter(inner_edges, lambda e: e <> lowest),
                                   lambda e: e < s.probability)) AS INTEGER) AS decile
  FROM scored s, edges WHERE {where})"""


_BIN_COLUMNS = ("predicted", "actual", "p_min", "p_max", "gap")
_BINS_SELECT = """bins AS (
  SELECT decile, count(*) AS n, avg(probability) AS predicted,
         avg(CAST(y_true AS DOUBLE)) AS actual, min(probability) AS p_min,
         max(probability) AS p_max, avg(CAST(y_true AS DOUBLE)) - avg(probability) AS gap
  FROM binned GROUP BY decile)"""


@catalog.add(with_ctes(SCORED_SQL, _bins_sql("model = 'price'"), _BINS_SELECT, select=f"""
  SELECT decile, n, {_rounds(_BIN_COLUMNS)} FROM bins"""))
def decile_calibration(spark, sf_dir):
    scored = scored_lines(spark, sf_dir).where(F.col("model") == "price")
    return rounded(evaluate.calibration_table(scored), *_BIN_COLUMNS)


# Edges of every model's own quantiles, in one pass over all models.
@catalog.add(with_ctes(SCORED_SQL, """edges AS (
  SELECT model, list_distinct(list_slice(quantile_cont(probability,
           [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), 2, 11)) AS inner_edges,
         min(probability) AS lowest FROM scored GROUP BY model),
binned AS (
  SELECT s.*, CAST(len(list_filter(list_filter(inner_edges, lambda e: e <> lowest),
                                   lambda e: e < s.probability)) AS INTEGER) AS decile
  FROM scored s JOIN edges USING (model))""",
  _BINS_SELECT.replace("SELECT decile", "SELECT model, decile")
  .replace("GROUP BY decile", "GROUP BY model, decile"), select=f"""
  SELECT model, decile, n, {_rounds(_BIN_COLUMNS)} FROM bins"""))
def decile_calibration_by_model(spark, sf_dir):
    table_ = evaluate.calibration_table(scored_lines(spark, sf_dir), by=["model"])
    return rounded(table_, *_BIN_COLUMNS)


# Fifty distinct probabilities: edges repeat and ties must not split.
@catalog.add(with_ctes(SCORED_SQL, _bins_sql("model = 'quantity'"), _BINS_SELECT, select=f"""
  SELECT decile, n, {_rounds(_BIN_COLUMNS)} FROM bins"""))
def decile_calibration_with_ties(spark, sf_dir):
    scored = scored_lines(spark, sf_dir).where(F.col("model") == "quantity")
    return rounded(evaluate.calibration_table(scored), *_BIN_COLUMNS)


@catalog.add(with_ctes(SCORED_SQL, _bins_sql("model = 'price'"), _BINS_SELECT, select="""
  SELECT round(sum(n * abs(gap)) / sum(n), 6) AS ece,
         count(CASE WHEN rise THEN 1 END) AS rising_steps, count(*) - 1 AS steps,
         round(arg_max(actual, decile) - arg_min(actual, decile), 6) AS spread
  FROM (SELECT *, actual > lag(actual) OVER (ORDER BY decile) AS rise FROM bins)"""))
def calibration_error(spark, sf_dir):
    scored = scored_lines(spark, sf_dir).where(F.col("model") == "price")
    return rounded(evaluate.calibration_summary(evaluate.calibration_table(scored)),
                   "ece", "spread")


@catalog.add("""
  WITH s AS (
    SELECT quality, 1.0 / (1.0 + exp(-(n_chars - 3000) / 3000.0)) AS p
    FROM labels JOIN documents USING (doc_id)),
  e AS (SELECT list_slice(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9,
                                            1.0]), 2, 11) AS inner_edges FROM s)
  SELECT decile, count(*) AS n, round(avg(p), 6) AS predicted,
         round(avg(CAST(quality AS DOUBLE)), 6) AS actual FROM (
    SELECT s.*, CAST(len(list_filter(list_distinct(inner_edges), lambda x: x < p)) AS INTEGER)
             AS decile FROM s, e) GROUP BY decile""")
def document_score_calibration(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("y_true"),
        (1.0 / (1.0 + F.exp(-(F.col("n_chars") - 3000) / 3000.0))).alias("probability"))
    return rounded(evaluate.calibration_table(scored).select("decile", "n", "predicted", "actual"),
                   "predicted", "actual")


LIFT_SQL = """lifts AS (
  SELECT ticker, count(*) AS n, avg(CAST(y_true AS DOUBLE)) AS positive_rate,
         avg(CAST(prediction = y_true AS DOUBLE)) AS accuracy,
         avg(CAST(prediction = y_true AS DOUBLE)) - avg(CAST(y_true AS DOUBLE)) AS lift
  FROM scored WHERE model = 'price' GROUP BY ticker HAVING count(*) >= 20)"""


def _lifts(spark, sf_dir):
    return evaluate.entity_lift(scored_lines(spark, sf_dir).where(F.col("model") == "price"))


@catalog.add(with_ctes(SCORED_SQL, LIFT_SQL, select="""
  SELECT ticker, n, round(positive_rate, 6) AS positive_rate, round(accuracy, 6) AS accuracy,
         round(lift, 6) AS lift FROM lifts"""))
def entity_lift(spark, sf_dir):
    return rounded(_lifts(spark, sf_dir), "positive_rate", "accuracy", "lift")


_LIFT_COLUMNS = ("mean_accuracy", "share_beating", "corr_accuracy_rate", "corr_lift_rate",
                 "median_accuracy", "median_lift")


@catalog.add(with_ctes(SCORED_SQL, LIFT_SQL, select="""
  SELECT count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_rows,
         round(avg(accuracy), 6) AS mean_accuracy,
         count(CASE WHEN lift > 0 THEN 1 END) AS n_beating,
         round(count(CASE WHEN lift > 0 THEN 1 END) / count(*), 6) AS share_beating,
         round(corr(accuracy, positive_rate), 6) AS corr_accuracy_rate,
         round(corr(lift, positive_rate), 6) AS corr_lift_rate,
         round(quantile_cont(accuracy, 0.5), 6) AS median_accuracy,
         round(quantile_cont(lift, 0.5), 6) AS median_lift FROM lifts"""))
def entity_lift_summary(spark, sf_dir):
    return rounded(evaluate.lift_summary(_lifts(spark, sf_dir)), *_LIFT_COLUMNS)


@catalog.add(with_ctes(*METRICS_CHAIN, select="""
  SELECT round(min(positive_rate), 6) AS lowest, round(max(positive_rate), 6) AS highest,
         round(max(positive_rate) - min(positive_rate), 6) AS spread,
         round(stddev_samp(positive_rate), 6) AS sd FROM metrics WHERE model = 'constant'"""))
def baseline_drift(spark, sf_dir):
    constant = fold_metrics(spark, sf_dir).where(F.col("model") == "constant")
    return rounded(evaluate.rate_drift(constant), "lowest", "highest", "spread", "sd")


@catalog.add("""
  SELECT i AS q_index, i / 255.0 AS probability, round(q, 4) AS quantile FROM (
    SELECT unnest(range(0, 256)) AS i,
           unnest(quantile_cont(l_extendedprice, [i / 255.0 FOR i IN range(0, 256)])) AS q
    FROM lineitem)""")
def exact_quantile_grid(spark, sf_dir):
    grid = ordered.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice",
                                   [i / 255.0 for i in range(256)])
    return rounded(grid.select(F.col("q_index").cast("long").alias("q_index"), "probability",
                               "quantile"), "quantile", digits=4)


# --- folds -----------------------------------------------------------------


@catalog.add(with_ctes(*FEATURE_CHAIN, """roles AS (
  SELECT f.fold, CASE WHEN year(prediction_date) = f.fold THEN 'validate' ELSE 'train' END AS role,
         year(prediction_date) AS y, label_yoy FROM features, (VALUES (1998), (1999), (2000), (2001)) f(fold)
  WHERE label_yoy IS NOT NULL AND year(prediction_date) BETWEEN 1996 AND f.fold),
all_roles AS (
  SELECT fold, role, label_yoy FROM roles UNION ALL
  SELECT fold, CASE WHEN y < fold - 1 THEN 'inner_train' ELSE 'inner_validate' END, label_yoy
  FROM roles WHERE role = 'train')""", select="""
  SELECT fold, role, count(*) AS n_rows, count(label_yoy) AS n_labelled,
         round(avg(CAST(label_yoy AS DOUBLE)), 6) AS positive_rate
  FROM all_roles GROUP BY fold, role"""))
def expanding_fold_sizes(spark, sf_dir):
    return rounded(evaluate.fold_sizes(_expanding(spark, sf_dir)), "positive_rate")


def _expanding(spark, sf_dir, inner=True):
    """Features by fold and role. They are written first, as each role reads them again."""
    frame = settle(labelled_rows(part_features(spark, sf_dir)).select(*_FRAME))
    folds = evaluate.expanding_folds(spark, 1996, 1998, 2001)
    assigned = evaluate.assign_expanding(frame, folds)
    return evaluate.with_inner_roles(assigned) if inner else assigned


_FRAME = ("ticker", "period_end", "prediction_date", "label_yoy", *MODEL_FEATURES)


BOUNDARIES = (("1999-01-01", "2000-01-01"), ("2000-01-01", "2001-01-01"), ("2001-01-01", None))


@catalog.add(with_ctes(*FEATURE_CHAIN, """folds(fold, opens, closes) AS (VALUES
  (1, DATE '1999-01-01', DATE '2000-01-01'), (2, DATE '2000-01-01', DATE '2001-01-01'),
  (3, DATE '2001-01-01', NULL))""", select="""
  SELECT fold, CASE WHEN prediction_date >= opens THEN 'predict' ELSE 'train' END AS role,
         count(*) AS n_rows, count(label_yoy) AS n_labelled,
         round(avg(CAST(label_yoy AS DOUBLE)), 6) AS positive_rate
  FROM features, folds
  WHERE (prediction_date >= opens AND (closes IS NULL OR prediction_date < closes))
     OR (prediction_date < opens AND label_yoy IS NOT NULL)
  GROUP BY 1, 2"""))
def boundary_fold_sizes(spark, sf_dir):
    assigned = evaluate.assign_boundary(part_features(spark, sf_dir),
                                        evaluate.boundary_folds(spark, BOUNDARIES))
    return rounded(evaluate.fold_sizes(assigned), "positive_rate")


# The expanding folds are sound; validating on the panel's own years is not
# when the holdout begins inside them.
@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT fold, 'reaches the holdout' AS violation FROM (VALUES (1998), (1999), (2000), (2001)) f(fold)
  WHERE (SELECT max(prediction_date) FROM features WHERE label_yoy IS NOT NULL
         AND year(prediction_date) <= fold) >= DATE '2000-01-01'"""))
def fold_discipline(spark, sf_dir):
    return gates.fold_order(_expanding(spark, sf_dir), "2000-01-01").select("fold", "violation")


# Declared counts come from the line items, so the panel disagrees with them.
@catalog.add(with_ctes(*FEATURE_CHAIN, """predicted AS (
  SELECT CASE WHEN year(prediction_date) = 1999 THEN 1 WHEN year(prediction_date) = 2000 THEN 2
              ELSE 3 END AS fold, count(*) AS n, count(label_yoy) AS n_labelled
  FROM features WHERE prediction_date >= DATE '1999-01-01' GROUP BY 1),
declared AS (
  SELECT CASE WHEN y >= 2001 THEN 3 ELSE y - 1998 END AS fold, count(*) AS n
  FROM (SELECT year(l_shipdate) AS y FROM lineitem) WHERE y >= 1999 GROUP BY 1)""", select="""
  SELECT CAST(fold AS VARCHAR) AS fold, v AS violation FROM (
    SELECT p.fold, 'predicted rows differ from declaration' AS v FROM predicted p
    JOIN declared d ON p.fold = d.fold WHERE p.n <> d.n
    UNION ALL
    SELECT p.fold, 'labelled rows differ from declaration' FROM predicted p
    JOIN declared d ON p.fold = d.fold WHERE p.n_labelled <> d.n)"""))
def protocol_breaches(spark, sf_dir):
    features = part_features(spark, sf_dir)
    assigned = evaluate.assign_boundary(features, evaluate.boundary_folds(spark, BOUNDARIES))
    year = F.year(F.col("l_shipdate").cast("date"))
    declared = table(spark, sf_dir, "lineitem").where(year >= 1999).groupBy(
        F.least(year - 1998, F.lit(3)).alias("fold")).agg(
        F.count(F.lit(1)).alias("n_predict_rows"),
        F.count(F.lit(1)).alias("n_predict_rows_labelled"))
    holdout = features.where(F.col("prediction_date") >= F.lit("1999-01-01").cast("date"))
    return gates.protocol_breaches(assigned, declared, holdout, ["ticker", "period_end"])


# --- models ----------------------------------------------------------------


@catalog.add()
def quantile_to_normal(spark, sf_dir):
    """Normal scores of the growth lags under each fold's own training grid."""
    rows = ml.design(_expanding(spark, sf_dir, inner=False), RANKED_FEATURES,
                     keep=["fold", "role", "ticker", "period_end"])
    grids = ml.fit_quantile_grids(rows.where(F.col("role") == "train"), RANKED_FEATURES)
    return rounded(ml.apply_quantile_grids(rows, grids, RANKED_FEATURES), *RANKED_FEATURES)


#: Variants that no trees are grown for.
_TREELESS = ("constant", "logistic_raw", "logistic_rank")


def _walk(spark, sf_dir, variants=walkforward.VARIANTS):
    return walkforward.walk_forward(
        part_features(spark, sf_dir), 1996, 1998, 2000, "2001-01-01", variants=variants)


_TRAINING_SQL = """training AS (
  SELECT f.fold, CAST(x.features AS DOUBLE) AS x, x.feature FROM features,
    (VALUES (1998), (1999), (2000), (2001)) f(fold),
    LATERAL (VALUES """ + ", ".join(f"('{c}', {c})" for c in MODEL_FEATURES) + """) x(feature, features)
  WHERE label_yoy IS NOT NULL AND year(prediction_date) BETWEEN 1996 AND f.fold - 1),
medians AS (SELECT fold, feature, quantile_cont(x, 0.5) AS median FROM training GROUP BY ALL)"""


@catalog.add(with_ctes(*FEATURE_CHAIN, _TRAINING_SQL, select="""
  SELECT fold, feature, round(max(median), 6) AS median, round(avg(coalesce(x, median)), 6) AS mean,
         round(CASE WHEN stddev_pop(coalesce(x, median)) = 0 THEN 1.0
                    ELSE stddev_pop(coalesce(x, median)) END, 6) AS deviation
  FROM training JOIN medians USING (fold, feature) GROUP BY fold, feature"""))
def fold_scaling(spark, sf_dir):
    """Medians, means and deviations that each fold learns from its training rows."""
    rows = ml.design(_expanding(spark, sf_dir, inner=False), MODEL_FEATURES,
                     keep=["fold", "role"])
    fitted = ml.fit_scaling(rows.where(F.col("role") == "train"), MODEL_FEATURES)
    learned = [(fold, f, fitted.medians[fold][f], fitted.means[fold][f],
                fitted.deviations[fold][f]) for fold in fitted.means for f in MODEL_FEATURES]
    return rounded(spark.createDataFrame(
        learned, "fold int, feature string, median double, mean double, deviation double"),
        "median", "mean", "deviation")


_GRID_POINTS = (0, 1, 250, 500, 900, 998, 999)


@catalog.add(with_ctes(*FEATURE_CHAIN, _TRAINING_SQL, select=f"""
  SELECT fold, feature, i AS point, round(q, 6) AS edge FROM (
    SELECT fold, feature, unnest([{", ".join(map(str, _GRID_POINTS))}]) AS i,
           unnest(quantile_cont(x, [{", ".join(f"{i} / 999.0" for i in _GRID_POINTS)}])) AS q
    FROM training WHERE feature IN ({", ".join(f"'{c}'" for c in RANKED_FEATURES)})
    GROUP BY fold, feature)"""))
def quantile_grid_edges(spark, sf_dir):
    """Points of the grids behind the normal scores, of folds with 1,000 rows and more."""
    rows = ml.design(_expanding(spark, sf_dir, inner=False), RANKED_FEATURES,
                     keep=["fold", "role"])
    grids = ml.fit_quantile_grids(rows.where(F.col("role") == "train"), RANKED_FEATURES)
    edges = [(fold, feature, i, float(grid[i])) for (fold, feature), grid in grids.items()
             for i in _GRID_POINTS if len(grid) == ml.N_QUANTILES]
    return rounded(spark.createDataFrame(
        edges, "fold int, feature string, point int, edge double"), "edge")


_CONSTANT_SQL = """sides AS (
  SELECT f.fold, label_yoy AS y, year(prediction_date) AS yr FROM features,
    (VALUES (1998), (1999), (2000)) f(fold)
  WHERE label_yoy IS NOT NULL AND year(prediction_date) BETWEEN 1996 AND f.fold),
learned AS (SELECT fold, count(*) AS n_train, count(*) FILTER (yr < fold - 1) AS n_inner_train,
                   avg(CAST(y AS DOUBLE)) AS rate FROM sides WHERE yr < fold GROUP BY fold)"""


@catalog.add(with_ctes(*FEATURE_CHAIN, _CONSTANT_SQL, select="""
  SELECT fold, model, count(*) AS n, max(n_train) AS n_train, max(n_inner_train) AS n_inner_train,
         max(n_train) AS n_train_used, round(max(rate), 6) AS train_positive_rate,
         round(avg(CAST(y AS DOUBLE)), 6) AS positive_rate,
         model <> 'logistic_raw' AS corrected,
         CASE WHEN model = 'constant' THEN
           round(avg(-(CASE WHEN y = 1 THEN ln(rate) ELSE ln(1 - rate) END)), 6) END AS log_loss,
         CASE WHEN model = 'constant' THEN round(avg(CAST(y AS DOUBLE)), 6) END AS accuracy
  FROM sides JOIN learned USING (fold),
    (VALUES ('constant'), ('logistic_raw'), ('logistic_rank')) m(model)
  WHERE yr = fold GROUP BY fold, model"""))
def walk_forward_counts(spark, sf_dir):
    """All of the walk-forward results that doesn't depend on fitted weights or trees."""
    constant = F.col("model") == "constant"
    results = _walk(spark, sf_dir, _TREELESS).results.select(
        "fold", "model", "n", "n_train", "n_inner_train", "n_train_used", "train_positive_rate",
        "positive_rate", "corrected", F.when(constant, F.col("log_loss")).alias("log_loss"),
        F.when(constant, F.col("accuracy")).alias("accuracy"))
    return rounded(results, "train_positive_rate", "positive_rate", "log_loss", "accuracy")


@catalog.add()
def selection_means(spark, sf_dir):
    """The frozen choice among all variants, with the means it rests on."""
    chosen = walkforward.select_variant(_walk(spark, sf_dir))
    return rounded(chosen.means.join(F.broadcast(chosen.choice.select("best_model"))),
                   "mean_log_loss", "sd_log_loss", "mean_accuracy", "mean_brier")


@catalog.add()
def walk_forward_results(spark, sf_dir):
    run = _walk(spark, sf_dir)
    return rounded(run.results, *METRIC_COLUMNS, "accuracy_minus_constant")


@catalog.add()
def coefficient_stability(spark, sf_dir):
    """Coefficients of the two regressions; trees have none."""
    run = _walk(spark, sf_dir, _TREELESS)
    return rounded(evaluate.coefficient_stability(run.coefficients, "logistic_raw",
                                                  "logistic_rank"), "before", "after", "ratio")


@catalog.add()
def boosted_trees_early_stop(spark, sf_dir):
    """Boosted trees on every fold as declared: at most 2,000 trees, patience 50."""
    run = walkforward.walk_forward(
        part_features(spark, sf_dir), 1996, 1998, 2000, "2001-01-01",
        variants=("constant", "boosted_inner_es"))
    return rounded(run.results, *METRIC_COLUMNS, "accuracy_minus_constant")


@catalog.add()
def holdout_run(spark, sf_dir):
    """The declared holdout protocol, judged by fold."""
    return rounded(_holdout(spark, sf_dir).results, *METRIC_COLUMNS, "log_loss_delta",
                   "accuracy_delta")


def _holdout(spark, sf_dir):
    """Declared counts come from the calendar years of the table, not from the folds."""
    features = settle(part_features(spark, sf_dir).select(*_FRAME))
    years = features.where(F.col("prediction_date") >= F.lit(BOUNDARIES[0][0]).cast("date")) \
        .groupBy(F.least(F.year("prediction_date") - 1998, F.lit(3)).alias("fold")) \
        .agg(F.count(F.lit(1)).alias("n"), F.count("label_yoy").alias("n_labelled"))
    protocol = {
        "features": {"columns": list(MODEL_FEATURES), "excluded_target_identities": {
            "columns": ["eps_growth_yoy", "growth_acceleration"]}},
        "preprocessing": {"step_1_rank_transform": {"applies_to": list(RANKED_FEATURES)}},
        "model": {"decision_threshold": 0.5, "estimator": {"params": {"C": 1.0}}},
        "evaluation_protocol": {"folds": [
            {"fold": r.fold, "n_predict_rows": r.n, "n_predict_rows_labelled": r.n_labelled}
            for r in years.orderBy("fold").collect()]},
    }
    return walkforward.run_holdout(features, protocol, BOUNDARIES, settled=True)


_HOLDOUT_SQL = """folds(fold, opens, closes) AS (VALUES
  (1, DATE '1999-01-01', DATE '2000-01-01'), (2, DATE '2000-01-01', DATE '2001-01-01'),
  (3, DATE '2001-01-01', NULL)),
learned AS (
  SELECT fold, avg(CAST(label_yoy AS DOUBLE)) AS rate FROM features, folds
  WHERE prediction_date < opens AND label_yoy IS NOT NULL GROUP BY fold),
judged AS (
  SELECT label_yoy AS y, rate FROM features, folds JOIN learned USING (fold)
  WHERE prediction_date >= opens AND (closes IS NULL OR prediction_date < closes)
    AND label_yoy IS NOT NULL)"""


# The pooled verdict, but for what the fitted weights say.
@catalog.add(with_ctes(*FEATURE_CHAIN, _HOLDOUT_SQL, select="""
  SELECT count(*) AS n_labelled, round(avg(CAST(y AS DOUBLE)), 6) AS actual_positive_rate,
         round(avg(-(CASE WHEN y = 1 THEN ln(rate) ELSE ln(1 - rate) END)), 6)
           AS constant_log_loss, round(avg(CAST(y AS DOUBLE)), 6) AS constant_accuracy,
         TRUE AS consistent, 4 AS n_verdicts, count(*) AS n_calibrated FROM judged"""))
def holdout_verdict(spark, sf_dir):
    verdict = walkforward.judge_holdout(_holdout(spark, sf_dir))
    consistent = (F.col("log_loss_delta") < 0).eqNullSafe(F.col("passes_log_loss")) \
        & F.col("log_loss").between(0, 2) & F.col("brier").between(0, 1)
    counts = verdict.passed.agg(F.count(F.lit(1)).cast("int").alias("n_verdicts"))
    calibrated = verdict.calibration.agg(F.sum("n").alias("n_calibrated"))
    pooled = verdict.pooled.select(
        "n_labelled", "actual_positive_rate", "constant_log_loss", "constant_accuracy",
        consistent.alias("consistent")).join(F.broadcast(counts)).join(F.broadcast(calibrated))
    return rounded(pooled, "actual_positive_rate", "constant_log_loss", "constant_accuracy")


@catalog.add(with_ctes(*FEATURE_CHAIN, select=f"""
  SELECT count(*) AS n_rows, count(CASE WHEN {" OR ".join(f"{c} IS NULL" for c in MODEL_FEATURES)}
    THEN 1 END) AS n_incomplete FROM features
  WHERE label_yoy IS NOT NULL AND prediction_date < DATE '2001-01-01'"""))
def modelling_frame(spark, sf_dir):
    from pitpanel.operators.knowledge import any_missing

    frame = walkforward.modelling_frame(part_features(spark, sf_dir), "2001-01-01")
    return frame.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.count_if(any_missing(MODEL_FEATURES)).alias("n_incomplete"))


@catalog.add(with_ctes(*FEATURE_CHAIN, select="""
  SELECT label_yoy, count(*) AS n FROM features GROUP BY label_yoy"""))
def label_counts(spark, sf_dir):
    return profile.counts_by(part_panel(spark, sf_dir), "label_yoy")
