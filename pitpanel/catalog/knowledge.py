"""First filings, lags, windows, year-ago matches, unit changes, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.catalog.proxies import (
    ADJUSTED_SQL, EVENTS_SQL, FIRST_SQL, KEPT_SQL, LABEL_CHAIN, LAG_CAP, MATCHED_SQL,
    PART_FACTS_SQL, STUDY_END, STUDY_START, SUPPLIER_FACTS_SQL, TIES, part_facts, part_panel,
    rounded, supplier_facts, table, with_ctes,
)
from pitpanel.catalog.registry import Catalog
from pitpanel.operators import asof, knowledge, profile, restatements
from pitpanel.plans.panel import build_panel

catalog = Catalog()

FIRST_COLUMNS = ("ticker", "period_end", "filed_date", "eps_diluted", "n_filings_seen")


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, select=f"SELECT {', '.join(FIRST_COLUMNS)} "
                                                         "FROM first_rows"))
def first_known_filing(spark, sf_dir):
    return knowledge.first_known(part_facts(spark, sf_dir), ties=TIES).select(*FIRST_COLUMNS)


@catalog.add(with_ctes(SUPPLIER_FACTS_SQL, FIRST_SQL,
                       select=f"SELECT {', '.join(FIRST_COLUMNS)} FROM first_rows"))
def first_known_filing_dense(spark, sf_dir):
    return knowledge.first_known(supplier_facts(spark, sf_dir), ties=TIES).select(*FIRST_COLUMNS)


# Some first filings lack a value, so columns come from different filings.
@catalog.add(with_ctes(SUPPLIER_FACTS_SQL, """holed AS (
  SELECT *, CASE WHEN eps_diluted >= 50000 THEN eps_diluted END AS high_value FROM facts)""",
                       select="""
  SELECT ticker, period_end,
         arg_min(filed_date, row(filed_date, accn, line, other, price)) AS filed_date,
         arg_min(high_value, CASE WHEN high_value IS NOT NULL
           THEN row(filed_date, accn, line, other, price) END) AS high_value,
         count(*) AS n_filings_seen
  FROM holed GROUP BY ticker, period_end"""))
def first_known_per_column(spark, sf_dir):
    facts = supplier_facts(spark, sf_dir).withColumn(
        "high_value", F.when(F.col("eps_diluted") >= 50000, F.col("eps_diluted")))
    return knowledge.first_known(facts, ties=TIES, mode="column").select(
        "ticker", "period_end", "filed_date", "high_value", "n_filings_seen")


@catalog.add(with_ctes(SUPPLIER_FACTS_SQL, select="""
  SELECT ticker, filed_date, period_end, eps_diluted FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker
      ORDER BY filed_date, accn, line, other, price) AS rn FROM facts) WHERE rn = 1"""))
def first_row_per_entity(spark, sf_dir):
    facts = supplier_facts(spark, sf_dir)
    return knowledge.first_row(facts, "ticker", ["filed_date", *TIES]).select(
        "ticker", "filed_date", "period_end", "eps_diluted")


@catalog.add("""
  SELECT o_orderkey, l_linenumber, l_partkey, l_extendedprice,
         CAST(o_orderdate AS DATE) AS start, CAST(l_shipdate AS DATE) AS "end"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) BETWEEN 60 AND 110""")
def duration_filter(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = joined.select(
        "o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.col("o_orderdate").cast("date").alias("start"),
        F.col("l_shipdate").cast("date").alias("end"))
    return knowledge.quarterly_facts(spans)


@catalog.add(with_ctes(PART_FACTS_SQL, select="""
  SELECT filing_lag_days, count(*) AS n FROM facts GROUP BY filing_lag_days"""))
def filing_lag_days(spark, sf_dir):
    facts = part_facts(spark, sf_dir).drop("filing_lag_days")
    return profile.counts_by(knowledge.with_lag_days(facts), "filing_lag_days")


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, select=f"""
  SELECT ticker, period_end, filing_lag_days,
         CASE WHEN filing_lag_days > {LAG_CAP}
              THEN 'filing_lag_days > {LAG_CAP}' ELSE '' END AS reason
  FROM first_rows"""))
def lag_cap_split(spark, sf_dir):
    first = knowledge.first_known(part_facts(spark, sf_dir), ties=TIES)
    kept, rejected = knowledge.split_by_lag(first, LAG_CAP)
    columns = ["ticker", "period_end", "filing_lag_days", "reason"]
    return kept.withColumn("reason", F.lit("")).select(*columns) \
        .unionByName(rejected.select(*columns))


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, select=f"""
  SELECT CASE WHEN period_end < DATE '{STUDY_START}' THEN 'before'
              WHEN period_end > DATE '{STUDY_END}' THEN 'after' ELSE 'inside' END
           AS window_bucket, count(*) AS n
  FROM first_rows GROUP BY 1"""))
def window_trim(spark, sf_dir):
    first = knowledge.first_known(part_facts(spark, sf_dir), ties=TIES)
    return profile.counts_by(
        knowledge.with_window_bucket(first, STUDY_START, STUDY_END), "window_bucket")


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, KEPT_SQL, MATCHED_SQL, select="""
  SELECT ticker, period_end, period_end_year_ago, filed_date_year_ago, eps_year_ago
  FROM matched"""))
def asof_year_ago(spark, sf_dir):
    first = knowledge.first_known(part_facts(spark, sf_dir), ties=TIES)
    kept, _ = knowledge.split_by_lag(first, LAG_CAP)
    return asof.year_ago_match(kept).select(
        "ticker", "period_end", "period_end_year_ago", "filed_date_year_ago", "eps_year_ago")


def _nearest_sql(condition: str, order: str) -> str:
    return f"""
  WITH purchases AS (SELECT event_id, user_id AS ticker, CAST(ts AS DATE) AS day
                     FROM events WHERE event_type = 'purchase'),
  views AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS seen, event_id AS view_id,
                   value AS view_value FROM events WHERE event_type = 'view'),
  last_views AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, seen ORDER BY view_id DESC) AS rn
    FROM views) WHERE rn = 1),
  ranked AS (
    SELECT p.*, v.seen, v.view_id, row_number() OVER (
             PARTITION BY p.event_id ORDER BY {order}) AS rk
    FROM purchases p LEFT JOIN last_views v ON v.ticker = p.ticker AND {condition})
  SELECT event_id, ticker, day, seen, view_id FROM ranked WHERE rk = 1"""


def _nearest(spark, sf_dir, direction, tolerance):
    events = table(spark, sf_dir, "events")
    bought = events.where(F.col("event_type") == "purchase").select(
        "event_id", F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("day"))
    seen = events.where(F.col("event_type") == "view").select(
        F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("seen"),
        F.col("event_id").alias("view_id"))
    return asof.asof_match(bought, seen, by=["ticker"], left_on="day", right_on="seen",
                           payload=["view_id"], right_order=["view_id"],
                           tolerance_days=tolerance, direction=direction)


@catalog.add(_nearest_sql("abs(v.seen - p.day) <= 2", "abs(v.seen - p.day), v.seen"))
def asof_nearest_with_tolerance(spark, sf_dir):
    return _nearest(spark, sf_dir, "nearest", 2)


@catalog.add(_nearest_sql("v.seen <= p.day", "v.seen DESC"))
def asof_backward(spark, sf_dir):
    return _nearest(spark, sf_dir, "backward", None)


@catalog.add(_nearest_sql("v.seen >= p.day AND v.seen - p.day <= 3", "v.seen"))
def asof_forward(spark, sf_dir):
    return _nearest(spark, sf_dir, "forward", 3)


@catalog.add(with_ctes(PART_FACTS_SQL, EVENTS_SQL, select="""
  SELECT ticker, factor, window_start, window_end, established FROM unit_events"""))
def unit_change_events(spark, sf_dir):
    return restatements.detect_unit_changes(part_facts(spark, sf_dir), ties=TIES)


CUSTOMER_FACTS_SQL = """facts AS (
  SELECT o_custkey AS ticker, (CAST(date_trunc('quarter', l_shipdate) AS DATE) - 1) AS period_end,
         CAST(l_shipdate AS DATE) AS filed_date, l_quantity AS eps_diluted,
         l_orderkey AS accn, l_linenumber AS line, l_partkey AS other,
         l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@catalog.add(with_ctes(CUSTOMER_FACTS_SQL, EVENTS_SQL, select="""
  SELECT ticker, factor, window_start, window_end, established FROM unit_events"""))
def unit_change_events_by_customer(spark, sf_dir):
    shipped = F.col("l_shipdate").cast("date")
    facts = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
        F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("ticker"),
        F.date_sub(F.trunc(shipped, "quarter"), 1).alias("period_end"),
        shipped.alias("filed_date"), F.col("l_quantity").alias("eps_diluted"),
        F.col("l_orderkey").alias("accn"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("other"), F.col("l_extendedprice").alias("price"))
    return restatements.detect_unit_changes(facts, ties=TIES)


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, KEPT_SQL, MATCHED_SQL, EVENTS_SQL,
                       ADJUSTED_SQL, select="""
  SELECT ticker, period_end, split_factor_applied, split_ambiguous, split_contaminated,
         round(eps_year_ago_adjusted, 6) AS eps_year_ago_adjusted FROM adjusted"""))
def unit_change_adjustment(spark, sf_dir):
    facts = part_facts(spark, sf_dir)
    kept, _ = knowledge.split_by_lag(knowledge.first_known(facts, ties=TIES), LAG_CAP)
    adjusted = restatements.adjust_year_ago(
        asof.year_ago_match(kept), restatements.detect_unit_changes(facts, ties=TIES))
    return rounded(adjusted.select(
        "ticker", "period_end", "split_factor_applied", "split_ambiguous",
        "split_contaminated", "eps_year_ago_adjusted"), "eps_year_ago_adjusted")


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT ticker, period_end, prediction_date, prediction_date_year_ago, eps_diluted,
         round(eps_year_ago_adjusted, 6) AS eps_year_ago_adjusted, n_filings_seen,
         split_factor_applied, split_ambiguous, label_yoy FROM panel"""))
def labelled_panel(spark, sf_dir):
    return rounded(part_panel(spark, sf_dir).select(
        "ticker", "period_end", "prediction_date", "prediction_date_year_ago", "eps_diluted",
        "eps_year_ago_adjusted", "n_filings_seen", "split_factor_applied", "split_ambiguous",
        "label_yoy"), "eps_year_ago_adjusted")


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT count(CASE WHEN eps_year_ago_adjusted <> 0 THEN 1 END) AS n_computed,
         count(CASE WHEN eps_year_ago_adjusted IS NULL THEN 1 END) AS n_no_base,
         count(CASE WHEN eps_year_ago_adjusted = 0 THEN 1 END) AS n_zero_base
  FROM panel"""))
def growth_census(spark, sf_dir):
    panel = part_panel(spark, sf_dir).withColumn(
        "eps_growth_yoy", knowledge.growth("eps_diluted", "eps_year_ago_adjusted"))
    return knowledge.growth_census(panel)


@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, KEPT_SQL, MATCHED_SQL, select=f"""
  SELECT reason, count(*) AS n FROM (
    SELECT 'filing_lag_days > {LAG_CAP}' AS reason FROM first_rows
    WHERE filing_lag_days > {LAG_CAP}
    UNION ALL
    SELECT 'period_end < window start ({STUDY_START})' FROM matched
    WHERE period_end < DATE '{STUDY_START}'
    UNION ALL
    SELECT 'after_study_window' FROM matched WHERE period_end > DATE '{STUDY_END}')
  GROUP BY reason"""))
def reject_log_by_reason(spark, sf_dir):
    built = build_panel(part_facts(spark, sf_dir), STUDY_START, STUDY_END, ties=TIES,
                        max_lag_days=LAG_CAP)
    return profile.counts_by(built.rejected, "reason")


@catalog.add(with_ctes(*LABEL_CHAIN, select="""
  SELECT count(*) AS n_rows, max(prediction_date) AS latest, count(label_yoy) AS n_labelled
  FROM panel WHERE prediction_date < DATE '2001-01-01'"""))
def holdout_lock(spark, sf_dir):
    locked = knowledge.lock_holdout(part_panel(spark, sf_dir), "2001-01-01")
    return locked.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.max("prediction_date").alias("latest"),
                      F.count("label_yoy").alias("n_labelled"))


# The window cut before the match loses year-ago bases of its first year.
@catalog.add(with_ctes(PART_FACTS_SQL, FIRST_SQL, KEPT_SQL, MATCHED_SQL, select=f"""
  SELECT CAST(year(period_end) AS INTEGER) AS year, count(*) AS n,
         count(period_end_year_ago) AS n_matched
  FROM matched WHERE period_end BETWEEN DATE '{STUDY_START}' AND DATE '{STUDY_END}'
  GROUP BY 1"""))
def window_after_match(spark, sf_dir):
    kept, _ = knowledge.split_by_lag(
        knowledge.first_known(part_facts(spark, sf_dir), ties=TIES), LAG_CAP)
    inside, _, _ = knowledge.split_by_window(asof.year_ago_match(kept), STUDY_START, STUDY_END)
    return inside.groupBy(F.year("period_end").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count("period_end_year_ago").alias("n_matched"))
