"""Forward test: history extension, pending rows, resolution, scoring, provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitpanel.catalog.proxies import (
    ADJUSTED_SQL, EVENTS_SQL, FIRST_SQL, KEPT_SQL, MATCHED_SQL, PART_FACTS_SQL, STUDY_START,
    TIES, part_facts, rounded, table, with_ctes,
)
from pitpanel.catalog.registry import Catalog
from pitpanel.operators import forward, gates, profile
from pitpanel.plans import forward as plan
from pitpanel.plans.panel import Known, build_panel, known_facts
from pitpanel.session import settle, shared_folder
from pitpanel.sources import runs
from pitpanel.sources.tables import parse_provenance

catalog = Catalog()

CUT = "2000-08-15"
SCORED_AT = "2001-05-01"
PANEL_END = "2000-03-31"
TRAINING_RATE = 0.45

BASE_CHAIN = (PART_FACTS_SQL, FIRST_SQL, KEPT_SQL, MATCHED_SQL, EVENTS_SQL, ADJUSTED_SQL)

# The committed panel ends before the cut; later first filings extend it.
HISTORY_SQL = f"""quarters AS (
  SELECT ticker, period_end, filed_date, filed_date + 1 AS prediction_date, eps_diluted,
         n_filings_seen, split_factor_applied, split_ambiguous,
         CASE WHEN eps_year_ago_adjusted IS NOT NULL AND NOT split_ambiguous
              THEN CAST(eps_diluted > eps_year_ago_adjusted AS INTEGER) END AS label_yoy
  FROM adjusted WHERE period_end >= DATE '{STUDY_START}'),
history AS (SELECT *, period_end > DATE '{PANEL_END}' AS is_new FROM quarters
            WHERE period_end <= DATE '{PANEL_END}' OR prediction_date <= DATE '{CUT}'),
withheld AS (SELECT * FROM quarters WHERE period_end > DATE '{PANEL_END}'
             AND prediction_date > DATE '{CUT}')"""
HISTORY_CHAIN = (*[part.replace("filing_lag_days <= 60", "filing_lag_days <= 120")
                   for part in BASE_CHAIN], HISTORY_SQL)


def _panel(spark, sf_dir, known=None):
    return build_panel(part_facts(spark, sf_dir), STUDY_START, PANEL_END, ties=TIES,
                       known=known).panel.drop(*TIES)


def _known(spark, sf_dir):
    """First filings and unit changes, which the panel and what follows it start from."""
    known = known_facts(part_facts(spark, sf_dir), TIES)
    return Known(settle(known.first.drop(*TIES)), settle(known.events))


def _history(spark, sf_dir):
    known = _known(spark, sf_dir)
    panel = settle(_panel(spark, sf_dir, known))
    return plan.extend_history(part_facts(spark, sf_dir), panel, CUT, STUDY_START, ties=TIES,
                               known=known)


@catalog.add(with_ctes(*HISTORY_CHAIN, select="""
  SELECT ticker, period_end, prediction_date, eps_diluted, label_yoy, split_factor_applied
  FROM history"""))
def history_extension(spark, sf_dir):
    return _history(spark, sf_dir).history.select(
        "ticker", "period_end", "prediction_date", "eps_diluted", "label_yoy",
        "split_factor_applied")


@catalog.add(with_ctes(*HISTORY_CHAIN, select=f"""
  SELECT ticker, period_end, prediction_date FROM (
    SELECT ticker, period_end, filed_date + 1 AS prediction_date FROM first_rows)
  WHERE prediction_date > DATE '{CUT}'"""))
def withheld_filings(spark, sf_dir):
    return _history(spark, sf_dir).withheld.select("ticker", "period_end", "prediction_date")


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, select=f"""
  SELECT f.ticker, f.period_end FROM first_rows f WHERE NOT EXISTS (
    SELECT 1 FROM first_rows p WHERE p.ticker = f.ticker AND p.period_end = f.period_end
      AND p.period_end BETWEEN DATE '{STUDY_START}' AND DATE '{PANEL_END}')"""))
def unknown_keys(spark, sf_dir):
    from pitpanel.operators.knowledge import first_known

    first = first_known(part_facts(spark, sf_dir), ties=TIES)
    return first.join(_panel(spark, sf_dir).select("ticker", "period_end"),
                      ["ticker", "period_end"], "left_anti").select("ticker", "period_end")


# Every customer number is asked for; most name a part with history.
PENDING_SQL = f"""members AS (SELECT c_custkey + 600 AS ticker FROM customer),
steps AS (
  SELECT ticker, CAST(coalesce(trunc(quantile_cont(CAST(step AS DOUBLE), 0.5)), 91) AS INTEGER)
           AS gap
  FROM (SELECT ticker, period_end - lead(period_end) OVER (PARTITION BY ticker ORDER BY nth)
                 AS step
        FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prediction_date DESC,
                period_end DESC) AS nth FROM history) WHERE nth <= 8)
  GROUP BY ticker),
known AS (SELECT ticker, count(*) AS n, max(prediction_date) AS last_decision,
                 arg_max(period_end, prediction_date) AS last_period
          FROM history GROUP BY ticker),
judged AS (
  SELECT m.ticker, k.n AS n_history, CAST(DATE '{CUT}' - last_decision AS INTEGER)
           AS silence_days, last_period, last_decision, gap,
         CASE WHEN k.n IS NULL THEN 'no history' WHEN k.n < 8 THEN 'fewer than 8 rows'
              WHEN DATE '{CUT}' - last_decision > 100 THEN 'silent more than 100 days' END
           AS reason
  FROM members m LEFT JOIN known k USING (ticker) LEFT JOIN steps s USING (ticker))"""


def _pending(spark, sf_dir, history):
    members = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 600).alias("ticker"))
    return forward.pending_rows(history, members, CUT, min_history=8, max_silence=100)


@catalog.add(with_ctes(*HISTORY_CHAIN, PENDING_SQL, select=f"""
  SELECT ticker, last_period + gap AS period_end, DATE '{CUT}' + 1 AS prediction_date,
         last_period AS last_known_period_end, last_decision AS last_known_prediction_date,
         gap AS quarter_gap_days_used FROM judged WHERE reason IS NULL"""))
def pending_rows(spark, sf_dir):
    return _pending(spark, sf_dir, _history(spark, sf_dir).history)[0]


@catalog.add(with_ctes(*HISTORY_CHAIN, PENDING_SQL, select="""
  SELECT ticker, n_history, silence_days, reason FROM judged WHERE reason IS NOT NULL"""))
def skipped_members(spark, sf_dir):
    return _pending(spark, sf_dir, _history(spark, sf_dir).history)[1]


@catalog.add(with_ctes(*HISTORY_CHAIN, PENDING_SQL, select="""
  SELECT count(*) FILTER (reason IS NULL) AS n_pending,
         count(*) FILTER (reason IS NOT NULL) AS n_skipped,
         count(*) FILTER (reason = 'no history') AS n_no_history,
         count(*) FILTER (reason IS NULL OR reason <> 'no history') AS n_eligible,
         round(count(*) FILTER (reason IS NULL)
               / count(*) FILTER (reason IS NULL OR reason <> 'no history'), 6) AS share
  FROM judged"""))
def coverage_floor(spark, sf_dir):
    pending, skipped = _pending(spark, sf_dir, _history(spark, sf_dir).history)
    coverage = forward.pending_coverage(pending, skipped)
    return rounded(gates.below_floor(coverage, "n_pending", "n_eligible", 1.1), "share")


@catalog.add(with_ctes(*HISTORY_CHAIN, PENDING_SQL, """framed AS (
  SELECT ticker, prediction_date, label_yoy, FALSE AS is_pending FROM history
  UNION ALL SELECT ticker, CAST(DATE '2000-08-16' AS DATE), NULL, TRUE FROM judged
  WHERE reason IS NULL),
lagged AS (
  SELECT ticker, is_pending, """ + ", ".join(
    f"lag(label_yoy, {k}) OVER w AS label_lag_{k}" for k in (1, 2, 3, 4)) + """,
         CAST(row_number() OVER w - 1 AS INTEGER) AS quarters_available
  FROM framed WINDOW w AS (PARTITION BY ticker ORDER BY prediction_date))""", select="""
  SELECT ticker, label_lag_1, label_lag_2, label_lag_3, label_lag_4, quarters_available
  FROM lagged WHERE is_pending"""))
def pending_features(spark, sf_dir):
    history = _history(spark, sf_dir).history
    built, _ = plan.forward_features(history, _pending(spark, sf_dir, history)[0])
    return built.select("ticker", *[f"label_lag_{k}" for k in (1, 2, 3, 4)],
                        "quarters_available")


@catalog.add(with_ctes(*HISTORY_CHAIN, PENDING_SQL, select=f"""
  SELECT ticker, 'already filed after the cut' AS violation FROM judged
  WHERE reason IS NULL AND ticker IN (SELECT ticker FROM first_rows
    WHERE filed_date + 1 > DATE '{CUT}')
  UNION ALL
  SELECT j.ticker, 'not later than known history' FROM judged j
  JOIN (SELECT ticker, max(period_end) AS p FROM history GROUP BY ticker) h USING (ticker)
  WHERE reason IS NULL AND last_period + gap <= p"""))
def resolvable_outcomes(spark, sf_dir):
    extended = _history(spark, sf_dir)
    pending, _ = _pending(spark, sf_dir, extended.history)
    blank = pending.withColumn("eps_diluted", F.lit(None).cast("double")) \
        .withColumn("label_yoy", F.lit(None).cast("int"))
    return gates.resolvable_rows(blank, extended.history, extended.withheld)


# Recorded predictions: one per part, expecting the quarter before the cut; the
# probability rises with the retail price.
PREDICTIONS_SQL = """predictions AS (
  SELECT p_partkey AS ticker,
         CASE WHEN p_size <= 3 THEN DATE '2000-04-30' WHEN p_size <= 45 THEN DATE '2000-09-30'
              ELSE DATE '2001-03-31' END AS expected_period_end,
         1.0 / (1.0 + exp(-(p_retailprice - 1000.0) / 200.0)) AS predicted_probability
  FROM part)"""

# By then every deadline has passed, so nothing is outstanding.
SETTLED_AT = "2001-12-31"


def resolved_sql(scored_at: str) -> str:
    return f"""outcomes AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker
                   ORDER BY filed_date, period_end) AS rn
                 FROM quarters WHERE prediction_date > DATE '{CUT}'
                   AND filed_date <= DATE '{scored_at}') WHERE rn = 1),
resolved AS (
  SELECT p.ticker, p.expected_period_end, p.predicted_probability,
         CAST(predicted_probability >= 0.5 AS INTEGER) AS predicted_label,
         o.period_end AS actual_period_end, o.filed_date AS actual_filed_date,
         o.prediction_date AS actual_prediction_date, o.label_yoy AS actual_label,
         p.expected_period_end + 120 AS resolution_deadline,
         CASE WHEN o.prediction_date <= p.expected_period_end + 120 AND label_yoy IS NOT NULL
              THEN 'scored'
              WHEN o.prediction_date <= p.expected_period_end + 120 THEN 'excluded_no_label'
              WHEN o.ticker IS NOT NULL THEN 'excluded_late_filing'
              WHEN DATE '{scored_at}' > p.expected_period_end + 120 THEN 'excluded_no_filing'
              ELSE 'outstanding' END AS status
  FROM predictions p LEFT JOIN outcomes o ON o.ticker = p.ticker)"""


RESOLVED_CHAIN = (*HISTORY_CHAIN, PREDICTIONS_SQL, resolved_sql(SCORED_AT))


def _resolved(spark, sf_dir, scored_at=SCORED_AT):
    probability = 1.0 / (1.0 + F.exp(-(F.col("p_retailprice") - 1000.0) / 200.0))
    expected = F.when(F.col("p_size") <= 3, "2000-04-30") \
        .when(F.col("p_size") <= 45, "2000-09-30").otherwise("2001-03-31")
    predictions = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ticker"), expected.cast("date").alias("expected_period_end"),
        probability.alias("predicted_probability"),
        (probability >= 0.5).cast("int").alias("predicted_label"))
    known = _known(spark, sf_dir)
    quarters = plan.rebuild_quarters(part_facts(spark, sf_dir), _panel(spark, sf_dir, known),
                                     STUDY_START, ties=TIES, known=known)
    # What had been filed when the predictions are scored is known.
    known = quarters.where(F.col("filed_date") <= F.lit(scored_at).cast("date"))
    return forward.resolve_outcomes(predictions, known, CUT, scored_at)


@catalog.add(with_ctes(*RESOLVED_CHAIN, select="""
  SELECT ticker, expected_period_end, resolution_deadline, actual_period_end,
         actual_filed_date, actual_prediction_date, actual_label, status FROM resolved"""))
def outcome_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "ticker", "expected_period_end", "resolution_deadline", "actual_period_end",
        "actual_filed_date", "actual_prediction_date", "actual_label", "status")


@catalog.add(with_ctes(*RESOLVED_CHAIN, select="""
  SELECT ticker, status,
         CASE WHEN status = 'scored' THEN predicted_label = actual_label END AS correct,
         CASE status WHEN 'excluded_no_label' THEN
                'filed in time; label null under the panel''s rules'
              WHEN 'excluded_late_filing' THEN 'filed after expected_period_end + 120d'
              WHEN 'excluded_no_filing' THEN
                'no qualifying filing by expected_period_end + 120d'
              ELSE '' END AS excluded_reason FROM resolved"""))
def resolution_reasons(spark, sf_dir):
    return forward.explain_resolution(_resolved(spark, sf_dir)).select(
        "ticker", "status", "correct", "excluded_reason")


_SCORE_COLUMNS = ("actual_positive_rate", "log_loss", "constant_log_loss", "accuracy",
                  "constant_accuracy", "brier", "predicted_positive_rate", "log_loss_delta",
                  "accuracy_delta")


@catalog.add(with_ctes(*HISTORY_CHAIN, PREDICTIONS_SQL, resolved_sql(SETTLED_AT), f"""scores AS (
  SELECT count(*) AS n_predicted, count(*) FILTER (status = 'scored') AS n_scored,
    count(*) FILTER (status = 'excluded_no_label') AS n_excluded_no_label,
    count(*) FILTER (status = 'excluded_late_filing') AS n_excluded_late_filing,
    count(*) FILTER (status = 'excluded_no_filing') AS n_excluded_no_filing,
    count(*) FILTER (status = 'outstanding') AS n_outstanding,
    avg(CAST(actual_label AS DOUBLE)) FILTER (status = 'scored') AS actual_positive_rate,
    avg(-(CASE WHEN actual_label = 1 THEN ln(predicted_probability)
          ELSE ln(1 - predicted_probability) END)) FILTER (status = 'scored') AS log_loss,
    avg(-(CASE WHEN actual_label = 1 THEN ln({TRAINING_RATE}) ELSE ln(1 - {TRAINING_RATE}) END))
      FILTER (status = 'scored') AS constant_log_loss,
    avg(CAST(predicted_label = actual_label AS DOUBLE)) FILTER (status = 'scored') AS accuracy,
    avg(CAST(actual_label = 1 AS DOUBLE)) FILTER (status = 'scored') AS constant_accuracy,
    avg(power(predicted_probability - actual_label, 2)) FILTER (status = 'scored') AS brier,
    avg(CAST(predicted_label AS DOUBLE)) FILTER (status = 'scored') AS predicted_positive_rate
  FROM resolved)""", select=f"""
  SELECT n_predicted, n_scored, n_excluded_no_label, n_excluded_late_filing,
         n_excluded_no_filing, n_outstanding,
         {", ".join(f"round({c}, 6) AS {c}" for c in _SCORE_COLUMNS[:7])},
         round(log_loss - constant_log_loss, 6) AS log_loss_delta,
         round(accuracy - constant_accuracy, 6) AS accuracy_delta,
         log_loss < constant_log_loss AS passes_log_loss,
         accuracy > constant_accuracy AS passes_accuracy,
         log_loss < constant_log_loss AND accuracy > constant_accuracy AS passes_both
  FROM scores WHERE n_outstanding = 0"""))
def forward_score(spark, sf_dir):
    """All or nothing: a run with outstanding rows has no score."""
    resolved = _resolved(spark, sf_dir, SETTLED_AT)
    scored = rounded(forward.score_resolved(resolved, TRAINING_RATE), *_SCORE_COLUMNS)
    return scored.where(F.col("n_outstanding") == 0)


@catalog.add(with_ctes(*RESOLVED_CHAIN, select="""
  SELECT count(*) AS n, count(*) FILTER (e = 0) AS n_exact, count(*) FILTER (e <= 7)
           AS n_within_week, CAST(trunc(quantile_cont(CAST(e AS DOUBLE), 0.5)) AS INTEGER)
           AS median_error, CAST(max(e) AS INTEGER) AS worst_error
  FROM (SELECT abs(actual_period_end - expected_period_end) AS e FROM resolved
        WHERE actual_period_end IS NOT NULL)"""))
def expected_vs_actual(spark, sf_dir):
    return profile.gap_summary(_resolved(spark, sf_dir), "expected_period_end",
                               "actual_period_end")


@catalog.add(with_ctes(*RESOLVED_CHAIN, select="""
  SELECT 'outstanding' AS gate, count(*) FILTER (status = 'outstanding') AS n FROM resolved
  UNION ALL SELECT 'recorded too late',
    count(*) FILTER (actual_filed_date <= DATE '2000-10-20') FROM resolved"""))
def resolution_gates(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    count = F.count(F.lit(1)).alias("n")
    waiting = gates.outstanding_rows(resolved).agg(count)
    late = gates.recorded_too_late(resolved, "2000-10-20 15:30:00").agg(count)
    return waiting.select(F.lit("outstanding").alias("gate"), "n").unionByName(
        late.select(F.lit("recorded too late").alias("gate"), "n"))


@catalog.add(with_ctes(*RESOLVED_CHAIN, """stints AS (
  SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS start,
         CAST(o_orderdate AS DATE) + 200 AS stop FROM orders)""", select="""
  SELECT count(*) AS n_scored, count(*) FILTER (m) AS n_member,
         count(*) FILTER (NOT m) AS n_not_member
  FROM (SELECT EXISTS (SELECT 1 FROM stints s WHERE s.ticker = r.ticker
               AND r.actual_prediction_date BETWEEN s.start AND s.stop) AS m
        FROM resolved r WHERE status = 'scored')"""))
def membership_at_filing(spark, sf_dir):
    placed = F.col("o_orderdate").cast("date")
    stints = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ticker"), placed.alias("start"),
        F.date_add(placed, 200).alias("end"))
    return forward.membership_at_filing(_resolved(spark, sf_dir), stints)


@catalog.add()
def forward_predictions(spark, sf_dir):
    """Refit at the cut and predict every pending row."""
    history = settle(_history(spark, sf_dir).history)
    pending = settle(_pending(spark, sf_dir, history)[0])
    built, past = plan.forward_features(history, pending)
    return rounded(plan.predict_pending(built, past, CUT), "predicted_probability")


def _committed(spark, sf_dir):
    """A run of the cut, committed to the shared folder and read back."""
    history = settle(_history(spark, sf_dir).history)
    pending = settle(_pending(spark, sf_dir, history)[0])
    built, past = plan.forward_features(history, pending)
    predictions = settle(plan.predict_pending(built, past, CUT))
    provenance = {
        "cut_date": CUT, "code_sha": "none", "working_tree_clean": "yes",
        "config": "revision 1", "model": "logistic_rank", "decision_threshold": "0.5",
        "panel_sha256": runs.digest_text(history),
        **plan.training_summary(plan.training_rows(history, CUT))}
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    runs.commit_run(predictions, provenance, root, CUT,
                    inputs={"history": (history, provenance["panel_sha256"])})
    return runs.load_run(spark, root, CUT)


_LAGS = [f"label_lag_{k}" for k in (1, 2, 3, 4)]


# All that a committed prediction says, but for the probability and its label.
@catalog.add(with_ctes(*HISTORY_CHAIN, PENDING_SQL, """framed AS (
  SELECT ticker, prediction_date, label_yoy, FALSE AS is_pending FROM history
  UNION ALL SELECT ticker, CAST(DATE '2000-08-16' AS DATE), NULL, TRUE FROM judged
  WHERE reason IS NULL),
lagged AS (
  SELECT ticker, is_pending, """ + ", ".join(
    f"lag(label_yoy, {k}) OVER w AS label_lag_{k}" for k in (1, 2, 3, 4)) + """,
         CAST(row_number() OVER w - 1 AS INTEGER) AS quarters_available
  FROM framed WINDOW w AS (PARTITION BY ticker ORDER BY prediction_date))""", select=f"""
  SELECT DATE '{CUT}' AS cut_date, ticker, last_period + gap AS expected_period_end,
         last_period AS last_known_period_end, last_decision AS last_known_prediction_date,
         gap AS quarter_gap_days_used, TRUE AS has_probability,
         label_lag_1, label_lag_2, label_lag_3, label_lag_4, quarters_available
  FROM judged JOIN lagged USING (ticker) WHERE reason IS NULL AND is_pending"""))
def forward_output(spark, sf_dir):
    data, _ = _committed(spark, sf_dir)
    inside = F.col("predicted_probability").between(0, 1) & (
        (F.col("predicted_probability") >= 0.5).cast("int") == F.col("predicted_label"))
    return data.select(
        "cut_date", "ticker", "expected_period_end", "last_known_period_end",
        "last_known_prediction_date", "quarter_gap_days_used",
        inside.alias("has_probability"), *_LAGS, "quarters_available")


@catalog.add(with_ctes(*HISTORY_CHAIN, """learned AS (
  SELECT count(*) AS n, avg(CAST(label_yoy AS DOUBLE)) AS rate FROM history
  WHERE label_yoy IS NOT NULL)""", select=f"""
  SELECT 'cut_date' AS key, '{CUT}' AS value
  UNION ALL SELECT 'decision_threshold', '0.5'
  UNION ALL SELECT 'training_rows_labelled', CAST(n AS VARCHAR) FROM learned
  UNION ALL SELECT 'training_positive_rate', printf('%.6f', rate) FROM learned"""))
def forward_provenance(spark, sf_dir):
    _, provenance = _committed(spark, sf_dir)
    return runs.as_rows(spark, provenance).where(F.col("key").isin(
        "cut_date", "decision_threshold", "training_rows_labelled", "training_positive_rate"))


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, select="""
  SELECT ticker, period_end, eps_diluted FROM first_rows WHERE eps_diluted >= 25
  UNION ALL
  SELECT f.ticker, f.period_end, min(f.price) FROM facts f WHERE NOT EXISTS (
    SELECT 1 FROM first_rows r WHERE r.ticker = f.ticker AND r.period_end = f.period_end
      AND r.eps_diluted >= 25) GROUP BY f.ticker, f.period_end"""))
def preferential_union(spark, sf_dir):
    from pitpanel.operators.knowledge import first_known

    facts = part_facts(spark, sf_dir)
    preferred = first_known(facts, ties=TIES).where(F.col("eps_diluted") >= 25).select(
        "ticker", "period_end", "eps_diluted")
    other = facts.groupBy("ticker", "period_end").agg(F.min("price").alias("eps_diluted"))
    return forward.prefer_first(preferred, other, ["ticker", "period_end"])


# Header lines made from the orders: keys in two spellings, prose, data rows.
@catalog.add("""
  SELECT 'order_' || o_orderkey AS key, o_orderstatus || '  (status)' AS value FROM orders""")
def provenance_header(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = F.array(
        F.concat(F.lit("# order_"), "o_orderkey", F.lit("   : "), "o_orderstatus",
                 F.lit("  (status)")),
        F.concat(F.lit("# Order "), "o_orderkey", F.lit(": not a key")),
        F.concat(F.lit("#  prose about order "), "o_orderkey"),
        F.concat(F.lit("order_"), "o_orderkey", F.lit(",data:row")))
    return parse_provenance(orders.select(F.explode(lines).alias("value")))
