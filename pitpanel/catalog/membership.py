"""Membership intervals, gates, change-log summaries, filing patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.catalog.proxies import (
    HORIZON, INTERVALS_SQL, MEMBER_END, MEMBER_EVENTS_SQL, MEMBER_START, PART_FACTS_SQL,
    SUPPLIER_FACTS_SQL, TIES, member_events, member_intervals, part_facts, purchases,
    supplier_facts, table, rounded, with_ctes,
)
from pitpanel.catalog.registry import Catalog
from pitpanel.functions.names import fiscal_label
from pitpanel.operators import asof, membership, profile
from pitpanel.sources.changelog import normalise_changes

catalog = Catalog()

MEMBER_CHAIN = (MEMBER_EVENTS_SQL, INTERVALS_SQL)
PURCHASES_SQL = """purchases AS (
  SELECT user_id AS ticker, CAST(ts AS DATE) AS prediction_date, event_id
  FROM events WHERE event_type = 'purchase')"""


@catalog.add(with_ctes(*MEMBER_CHAIN, select="""
  SELECT ticker, start, "end", left_censored FROM intervals"""))
def membership_intervals(spark, sf_dir):
    return member_intervals(spark, sf_dir)


# Customers stand in for a current list: most of them never appear in the log.
CURRENT_SQL = """current_members AS (
  SELECT c_custkey AS ticker,
         DATE '2023-12-20' + CAST(c_nationkey AS INTEGER) AS date_added FROM customer)"""


def _current(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ticker"),
        F.date_add(F.lit("2023-12-20").cast("date"), F.col("c_nationkey")).alias("date_added"))


WITH_CURRENT_SQL = f"""with_current AS (
  SELECT ticker, start, "end", left_censored FROM intervals
  UNION ALL
  SELECT ticker, greatest(date_added, DATE '{MEMBER_START}'), DATE '{HORIZON}',
         date_added < DATE '{MEMBER_START}'
  FROM current_members WHERE ticker NOT IN (SELECT ticker FROM member_events))"""


@catalog.add(with_ctes(*MEMBER_CHAIN, CURRENT_SQL, WITH_CURRENT_SQL, select="""
  SELECT i.ticker, min(i.start) AS first_seen,
         CASE WHEN max(c.ticker) IS NULL THEN max(i."end") END AS last_seen,
         max(c.ticker) IS NOT NULL AS still_in_index,
         coalesce(bool_or(i.ticker IN (SELECT ticker FROM member_events WHERE kind = 'remove')),
                  FALSE) AS is_removed_name,
         count(*) AS n_stints, bool_or(i.left_censored) AS left_censored
  FROM with_current i LEFT JOIN current_members c ON i.ticker = c.ticker GROUP BY i.ticker"""))
def membership_metadata(spark, sf_dir):
    events, current = member_events(spark, sf_dir), _current(spark, sf_dir)
    intervals = membership.membership_intervals(events, MEMBER_START, HORIZON, current=current)
    return membership.membership_metadata(intervals, events, current=current)


@catalog.add(with_ctes(*MEMBER_CHAIN, PURCHASES_SQL, select="""
  SELECT ticker, prediction_date, event_id, EXISTS (
    SELECT 1 FROM intervals i WHERE i.ticker = p.ticker
      AND p.prediction_date BETWEEN i.start AND i."end") AS in_index_at_prediction
  FROM purchases p"""))
def membership_gate_flag(spark, sf_dir):
    return asof.covered_at(purchases(spark, sf_dir), member_intervals(spark, sf_dir))


@catalog.add(with_ctes(*MEMBER_CHAIN, PURCHASES_SQL, select="""
  SELECT ticker, prediction_date, event_id,
         'not_in_index_at_prediction_date' AS reason FROM purchases p
  WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE i.ticker = p.ticker
      AND p.prediction_date BETWEEN i.start AND i."end")"""))
def membership_gate_rejects(spark, sf_dir):
    _, outside = asof.gate_on_intervals(purchases(spark, sf_dir), member_intervals(spark, sf_dir))
    return outside.select("ticker", "prediction_date", "event_id", "reason")


# Intervals that overlap within an entity: any order to shipment of a customer.
@catalog.add("""
  WITH spans AS (
    SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS start,
           CAST(o_orderdate AS DATE) + 30 AS "end" FROM orders),
  moments AS (
    SELECT o_custkey AS ticker, CAST(l_shipdate AS DATE) AS day, l_linenumber, l_partkey
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT count(*) AS n, count(CASE WHEN covered THEN 1 END) AS n_covered FROM (
    SELECT EXISTS (SELECT 1 FROM spans s WHERE s.ticker = m.ticker
                   AND m.day BETWEEN s.start AND s."end") AS covered FROM moments m)""")
def overlapping_interval_gate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    placed = F.col("o_orderdate").cast("date")
    spans = orders.select(F.col("o_custkey").alias("ticker"), placed.alias("start"),
                          F.date_add(placed, 30).alias("end"))
    moments = table(spark, sf_dir, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("day"))
    flagged = asof.covered_at(moments, spans, moment="day", out="covered")
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("n_covered"))


@catalog.add(with_ctes(*MEMBER_CHAIN, select="""
  SELECT DISTINCT ticker FROM intervals
  WHERE DATE '2024-01-15' BETWEEN start AND "end" """))
def members_at_date(spark, sf_dir):
    return membership.members_at(member_intervals(spark, sf_dir), "2024-01-15")


@catalog.add(with_ctes(MEMBER_EVENTS_SQL, CURRENT_SQL, f"""seen AS (
  SELECT ticker, min(CASE WHEN kind = 'add' THEN date END) AS added,
         max(CASE WHEN kind = 'remove' THEN date END) AS removed
  FROM member_events WHERE date BETWEEN DATE '{MEMBER_START}' AND DATE '{MEMBER_END}'
  GROUP BY ticker),
joined AS (
  SELECT coalesce(s.ticker, c.ticker) AS ticker, coalesce(c.date_added, s.added) AS known,
         s.removed, c.ticker IS NOT NULL AS still
  FROM seen s FULL OUTER JOIN current_members c ON s.ticker = c.ticker)""", select=f"""
  SELECT ticker, CASE WHEN known IS NULL OR known < DATE '{MEMBER_START}'
                      THEN DATE '{MEMBER_START}' ELSE known END AS first_seen_in_index,
         CASE WHEN NOT still THEN removed END AS last_seen_in_index, still AS still_in_index,
         known IS NULL OR known < DATE '{MEMBER_START}' AS first_seen_left_censored
  FROM joined"""))
def first_last_seen(spark, sf_dir):
    return membership.first_last_seen(member_events(spark, sf_dir), MEMBER_START, MEMBER_END,
                                      current=_current(spark, sf_dir))


# A raw change log as a web table gives it: text dates in two spellings, blanks
# and the text "nan" for missing symbols.
def _raw_log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    shown = F.when(F.col("event_type") == "signup", F.date_format(day, "MMMM d, yyyy")) \
        .when(F.col("event_type") == "error", F.date_format(day, "yyyy-MM-dd")) \
        .otherwise(F.lit("unknown"))
    user = F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit(" "))
    return events.select(
        shown.alias("Date_Date"),
        F.when(F.col("event_type") == "signup", user).otherwise("nan").alias("Added_Ticker"),
        F.col("event_type").alias("Added_Security"),
        F.when(F.col("event_type") == "error", user).otherwise(" ").alias("Removed_Ticker"))


RAW_LOG_SQL = """raw_log AS (
  SELECT CASE WHEN event_type IN ('signup', 'error') THEN CAST(ts AS DATE) END AS date,
         CASE WHEN event_type = 'signup' THEN 'U' || user_id END AS added,
         CASE WHEN event_type = 'error' THEN 'U' || user_id END AS removed FROM events)"""


@catalog.add(with_ctes(RAW_LOG_SQL, select="""
  SELECT date, added, removed, count(*) AS n FROM raw_log WHERE date IS NOT NULL
  GROUP BY date, added, removed"""))
def change_log_normaliser(spark, sf_dir):
    return profile.counts_by(normalise_changes(_raw_log(spark, sf_dir)),
                             "date", "added", "removed")


@catalog.add(with_ctes(RAW_LOG_SQL, select=f"""
  SELECT count(*) AS n_rows, count(date) AS n_dated, min(date) AS first_date,
         max(date) AS last_date, count(CASE WHEN date BETWEEN DATE '{MEMBER_START}'
           AND DATE '{MEMBER_END}' THEN 1 END) AS n_in_window FROM raw_log"""))
def change_log_coverage(spark, sf_dir):
    return membership.log_coverage(normalise_changes(_raw_log(spark, sf_dir), keep_undated=True),
                                   MEMBER_START, MEMBER_END)


@catalog.add("""
  SELECT CAST(y AS INTEGER) AS year, count(o_orderdate) AS n_changes,
         count(o_orderdate) = 0 AS missing
  FROM (SELECT unnest(range(1993, 2004)) AS y) LEFT JOIN orders ON year(o_orderdate) = y
  GROUP BY y""")
def change_log_years(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return membership.log_years(placed, "1993-01-01", "2003-12-31")


@catalog.add(with_ctes(RAW_LOG_SQL, select="""
  SELECT ticker, date, kind, count(*) AS n FROM (
    SELECT added AS ticker, date, 'add' AS kind FROM raw_log WHERE added IS NOT NULL
    UNION ALL SELECT removed, date, 'remove' FROM raw_log WHERE removed IS NOT NULL)
  GROUP BY ticker, date, kind"""))
def change_events(spark, sf_dir):
    events = membership.change_events(normalise_changes(_raw_log(spark, sf_dir)))
    return profile.counts_by(events, "ticker", "date", "kind")


@catalog.add(with_ctes(MEMBER_EVENTS_SQL, CURRENT_SQL, select="""
  SELECT ticker FROM member_events UNION SELECT ticker FROM current_members"""))
def universe_union(spark, sf_dir):
    return member_events(spark, sf_dir).select("ticker").union(
        _current(spark, sf_dir).select("ticker")).distinct()


# --- filing patterns -------------------------------------------------------


@catalog.add(with_ctes(SUPPLIER_FACTS_SQL, """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, period_end
              ORDER BY filed_date, accn, line, other, price) AS rn FROM facts),
firsts AS (SELECT ticker, period_end, eps_diluted AS v, filing_lag_days AS lag
           FROM ordered WHERE rn = 1)""", select="""
  SELECT f.ticker, f.period_end, count(*) AS n_filings, max(o.v) AS original_value,
         max(o.lag) AS first_lag_days, count(*) = 1 AS single_filing,
         count(*) >= 3 AS three_plus, max(o.lag) > 10 AS late_first_filing,
         max(abs(f.eps_diluted - o.v)) > 1e-9 AS value_changed
  FROM facts f JOIN firsts o USING (ticker, period_end) GROUP BY f.ticker, f.period_end"""))
def restatement_anomalies(spark, sf_dir):
    return profile.restatement_anomalies(supplier_facts(spark, sf_dir), value="eps_diluted",
                                         ties=TIES, late_after=10)


@catalog.add("""
  WITH lags AS (SELECT l_suppkey AS ticker, CAST(l_quantity * 100 + l_linenumber AS INTEGER)
                  AS lag FROM lineitem),
  steps AS (SELECT *, CASE WHEN lag - lag(lag) OVER (PARTITION BY ticker ORDER BY lag) > 97
                      THEN 1 ELSE 0 END AS jump FROM lags),
  numbered AS (SELECT *, sum(jump) OVER (PARTITION BY ticker ORDER BY lag
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM steps)
  SELECT ticker, CAST(cluster AS BIGINT) AS cluster, min(lag) AS low, max(lag) AS high,
         count(*) AS n,
         CASE WHEN min(lag) <= 90 THEN 'original' ELSE 'restated/comparative' END AS kind
  FROM numbered GROUP BY ticker, cluster""")
def lag_clusters(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"),
        F.rint(F.col("l_quantity") * 100 + F.col("l_linenumber")).cast("int").alias("lag"))
    return profile.cluster_values(line, "lag", 97, ["ticker"], count_nulls=True)


# Prices of all line items on one axis: no key deals them out.
@catalog.add("""
  WITH prices AS (SELECT CAST(round(l_extendedprice) AS INTEGER) AS price, count(*) AS n
                  FROM lineitem GROUP BY 1),
  steps AS (SELECT *, CASE WHEN price - lag(price) OVER (ORDER BY price) > 3
                      THEN 1 ELSE 0 END AS jump FROM prices),
  numbered AS (SELECT *, sum(jump) OVER (ORDER BY price
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM steps)
  SELECT CAST(cluster AS BIGINT) AS cluster, min(price) AS low, max(price) AS high,
         CAST(sum(n) AS BIGINT) AS n,
         CASE WHEN min(price) <= 90 THEN 'original' ELSE 'restated/comparative' END AS kind
  FROM numbered GROUP BY cluster""")
def price_clusters(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.round("l_extendedprice").cast("int").alias("price"))
    return profile.cluster_values(line, "price", 3)


@catalog.add("""
  WITH days AS (SELECT DISTINCT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS gap_end
                FROM orders),
  steps AS (SELECT *, lag(gap_end) OVER (PARTITION BY ticker ORDER BY gap_end) AS gap_start
            FROM days),
  counted AS (
    SELECT ticker, gap_start, gap_end, CAST((
      SELECT count(*) FROM range(0, CAST(gap_end - gap_start AS BIGINT)) t(i)
      WHERE isodow(gap_start + CAST(i AS INTEGER)) <= 5) AS INTEGER) AS business_days
    FROM steps WHERE gap_start IS NOT NULL)
  SELECT * FROM counted WHERE business_days > 5""")
def session_gaps(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("day"))
    return profile.session_gaps(orders, "day", ["ticker"])


@catalog.add("""
  WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
  newest AS (SELECT day FROM d ORDER BY day DESC LIMIT 5)
  SELECT count(*) AS n_rows, min(CAST(o_orderdate AS DATE)) AS first_date,
         max(CAST(o_orderdate AS DATE)) AS last_date,
         count(CASE WHEN CAST(o_orderdate AS DATE) > DATE '2001-01-01' THEN 1 END) AS n_future,
         (SELECT string_agg(CAST(day AS VARCHAR), ',' ORDER BY day DESC) FROM newest)
           AS latest_days
  FROM orders""")
def schedule_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return profile.schedule_summary(orders, "day", "2001-01-01")


@catalog.add(with_ctes(PART_FACTS_SQL, select="""
  SELECT ticker, count(*) AS raw_records, count(q) AS quarterly_records,
         count(DISTINCT CASE WHEN q THEN period_end END) AS unique_periods,
         round(count(q) / nullif(count(DISTINCT CASE WHEN q THEN period_end END), 0), 6)
           AS records_per_period,
         CAST(0 AS BIGINT) AS missing_period, CAST(0 AS BIGINT) AS missing_filed,
         min(CASE WHEN q THEN period_end END) AS earliest_period_end,
         max(CASE WHEN q THEN period_end END) AS latest_period_end
  FROM (SELECT *, CASE WHEN eps_diluted >= 10 THEN TRUE END AS q FROM facts)
  GROUP BY ticker"""))
def entity_audit(spark, sf_dir):
    facts = part_facts(spark, sf_dir).withColumn("quarterly", F.col("eps_diluted") >= 10)
    return rounded(profile.entity_audit(facts, is_quarterly="quarterly"), "records_per_period")


PERIODS_SQL = """counts AS (
  SELECT ticker, count(DISTINCT period_end) AS n_periods FROM facts GROUP BY ticker),
ordered AS (SELECT n_periods, row_number() OVER (ORDER BY n_periods) - 1 AS i FROM counts),
upper AS (SELECT n_periods AS median_count FROM ordered
          WHERE i = (SELECT count(*) // 2 FROM counts)),
thin AS (SELECT ticker, n_periods, median_count FROM counts, upper
         WHERE n_periods < median_count * 0.75)"""


def _thin(spark, sf_dir):
    facts = part_facts(spark, sf_dir)
    periods = profile.entity_audit(facts).select("ticker",
                                                 F.col("unique_periods").alias("n_periods"))
    return facts, profile.thin_entities(periods, fraction=0.75)


@catalog.add(with_ctes(PART_FACTS_SQL, PERIODS_SQL, select="SELECT * FROM thin"))
def thin_coverage(spark, sf_dir):
    return _thin(spark, sf_dir)[1]


@catalog.add(with_ctes(PART_FACTS_SQL, PERIODS_SQL, """starts AS (
  SELECT ticker, min(period_end) AS p, ticker IN (SELECT ticker FROM thin) AS is_thin
  FROM facts GROUP BY ticker)""", select="""
  SELECT count(*) AS n_entities, max(p) AS common_start,
         (SELECT max(ticker) FROM starts WHERE p = (SELECT max(p) FROM starts))
           AS binding_entity,
         max(CASE WHEN NOT is_thin THEN p END) AS healthy_start,
         (SELECT max(ticker) FROM starts WHERE NOT is_thin
            AND p = (SELECT max(p) FROM starts WHERE NOT is_thin)) AS healthy_binding_entity
  FROM starts"""))
def common_coverage_start(spark, sf_dir):
    facts, thin = _thin(spark, sf_dir)
    return profile.common_start(facts, thin)


@catalog.add(with_ctes(SUPPLIER_FACTS_SQL, """labelled AS (
  SELECT *, year(period_end) || '-Q' || quarter(period_end) AS label FROM facts)""", select="""
  SELECT ticker, arg_min(label, period_end) AS earliest_label,
         min(period_end) AS earliest_period_end, arg_max(label, period_end) AS latest_label,
         max(period_end) AS latest_period_end FROM labelled GROUP BY ticker"""))
def fiscal_label_extremes(spark, sf_dir):
    facts = supplier_facts(spark, sf_dir).withColumn("fiscal_period", fiscal_label(
        F.year("period_end"), F.concat(F.lit("Q"), F.quarter("period_end"))))
    return profile.fiscal_extremes(facts, ["ticker"])


@catalog.add(with_ctes(PART_FACTS_SQL, select="""
  SELECT ticker, period_end, filed_date, accn, line, other, price FROM facts
  ORDER BY period_end DESC, filed_date DESC, accn DESC, line DESC, other DESC, price DESC
  LIMIT 12"""))
def most_recent_facts(spark, sf_dir):
    facts = part_facts(spark, sf_dir).select("ticker", "period_end", "filed_date", *TIES)
    return profile.most_recent(facts, 12, ["period_end", "filed_date", *TIES])
