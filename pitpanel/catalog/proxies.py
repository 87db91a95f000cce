"""Views of the shared test tables in the library's data model.

Each Spark view has a SQL twin (``*_SQL``) written as a common table
expression, so a query and its SQL equivalent start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIES = ("accn", "line", "other", "price")
LAG_CAP = 60
STUDY_START, STUDY_END = "1996-03-31", "2001-06-30"
MEMBER_START, MEMBER_END, HORIZON = "2024-01-05", "2024-01-31", "2024-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- facts: one filing per line item ---------------------------------------


def _facts(spark: SparkSession, sf_dir: str, entity: str, value: str) -> DataFrame:
    shipped = F.col("l_shipdate").cast("date")
    period_end = F.date_sub(F.trunc(shipped, "quarter"), 1)
    other = "l_suppkey" if entity == "l_partkey" else "l_partkey"
    return table(spark, sf_dir, "lineitem").select(
        F.col(entity).alias("ticker"), period_end.alias("period_end"),
        shipped.alias("filed_date"), F.col(value).alias("eps_diluted"),
        F.col("l_orderkey").alias("accn"), F.col("l_linenumber").alias("line"),
        F.col(other).alias("other"), F.col("l_extendedprice").alias("price"),
        F.datediff(shipped, period_end).alias("filing_lag_days"))


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities, quantity as value: sparse quarters, integer values."""
    return _facts(spark, sf_dir, "l_partkey", "l_quantity")


def supplier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities, price as value: many filings per quarter."""
    return _facts(spark, sf_dir, "l_suppkey", "l_extendedprice")


def _facts_sql(entity: str, value: str) -> str:
    other = "l_suppkey" if entity == "l_partkey" else "l_partkey"
    period = "(CAST(date_trunc('quarter', l_shipdate) AS DATE) - 1)"
    return f"""facts AS (
  SELECT {entity} AS ticker, {period} AS period_end,
         CAST(l_shipdate AS DATE) AS filed_date, {value} AS eps_diluted,
         l_orderkey AS accn, l_linenumber AS line, {other} AS other,
         l_extendedprice AS price,
         CAST(CAST(l_shipdate AS DATE) - {period} AS INTEGER) AS filing_lag_days
  FROM lineitem)"""


PART_FACTS_SQL = _facts_sql("l_partkey", "l_quantity")
SUPPLIER_FACTS_SQL = _facts_sql("l_suppkey", "l_extendedprice")

FIRST_SQL = """first_rows AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT ticker, period_end, filed_date, eps_diluted, filing_lag_days,
           count(*) OVER (PARTITION BY ticker, period_end) AS n_filings_seen,
           row_number() OVER (PARTITION BY ticker, period_end
                              ORDER BY filed_date, accn, line, other, price) AS rn
    FROM facts) WHERE rn = 1)"""

KEPT_SQL = f"""kept AS (SELECT * FROM first_rows WHERE filing_lag_days <= {LAG_CAP})"""

MATCHED_SQL = """matched AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT k.*, c.period_end AS period_end_year_ago, c.filed_date AS filed_date_year_ago,
           c.eps_diluted AS eps_year_ago,
           row_number() OVER (PARTITION BY k.ticker, k.period_end
             ORDER BY abs(c.period_end - (k.period_end - 365)), c.period_end) AS rk
    FROM kept k LEFT JOIN kept c
      ON c.ticker = k.ticker AND abs(c.period_end - (k.period_end - 365)) <= 45)
  WHERE rk = 1)"""

EVENTS_SQL = """evidence AS (
  SELECT f.ticker, f.filed_date AS later_filed, o.filed_date AS original_filed,
         f.eps_diluted AS later, o.eps_diluted AS original,
         round_even(o.eps_diluted / f.eps_diluted, 0) AS factor
  FROM facts f JOIN (
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker, period_end
                  ORDER BY filed_date, accn, line, other, price) AS rn
      FROM facts WHERE abs(eps_diluted) > 0.01) WHERE rn = 1) o
    ON f.ticker = o.ticker AND f.period_end = o.period_end
  WHERE abs(f.eps_diluted) > 0.01),
unit_events AS (
  SELECT ticker, CAST(factor AS BIGINT) AS factor, max(original_filed) AS window_start,
         min(later_filed) AS window_end, max(original_filed) < min(later_filed) AS established
  FROM evidence
  WHERE abs(later - original) > 1e-9 AND factor >= 2
    AND abs(original / later - factor) / factor <= 0.02
  GROUP BY ticker, factor)"""

ADJUSTED_SQL = """effects AS (
  SELECT m.ticker, m.period_end,
         product(CASE WHEN e.established AND m.filed_date_year_ago <= e.window_start
                       AND m.filed_date >= e.window_end THEN e.factor END) AS factor,
         bool_or(NOT (e.established AND (
           (m.filed_date_year_ago <= e.window_start AND m.filed_date >= e.window_end)
           OR (m.filed_date_year_ago <= e.window_start AND m.filed_date <= e.window_start)
           OR (m.filed_date_year_ago >= e.window_end AND m.filed_date >= e.window_end))))
           AS ambiguous
  FROM matched m JOIN unit_events e ON m.ticker = e.ticker
  WHERE m.period_end_year_ago IS NOT NULL
  GROUP BY m.ticker, m.period_end),
adjusted AS (
  SELECT m.*, CAST(coalesce(x.factor, 1) AS BIGINT) AS split_factor_applied,
         coalesce(x.ambiguous, FALSE) AS split_ambiguous,
         m.eps_year_ago / coalesce(x.factor, 1) AS eps_year_ago_adjusted,
         coalesce(x.factor, 1) > 1 OR coalesce(x.ambiguous, FALSE) AS split_contaminated
  FROM matched m LEFT JOIN effects x ON m.ticker = x.ticker AND m.period_end = x.period_end)"""

PANEL_SQL = f"""panel AS (
  SELECT * EXCLUDE (filed_date_year_ago), filed_date + 1 AS prediction_date,
         filed_date_year_ago + 1 AS prediction_date_year_ago,
         CASE WHEN eps_year_ago_adjusted IS NOT NULL AND NOT split_ambiguous
              THEN CAST(eps_diluted > eps_year_ago_adjusted AS INTEGER) END AS label_yoy,
         split_factor_applied > 1 AS is_removed_name
  FROM adjusted
  WHERE period_end BETWEEN DATE '{STUDY_START}' AND DATE '{STUDY_END}')"""

FEATURES_SQL = """ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY prediction_date) - 1 AS INTEGER)
              AS quarters_available,
         CASE WHEN eps_year_ago_adjusted <> 0
              THEN (eps_diluted - eps_year_ago_adjusted) / abs(eps_year_ago_adjusted) END
              AS eps_growth_yoy
  FROM panel),
features AS (
  SELECT *,
    """ + ",\n    ".join(
    f"lag(label_yoy, {k}) OVER w AS label_lag_{k}, "
    f"lag(eps_growth_yoy, {k}) OVER w AS eps_growth_yoy_lag_{k}, "
    f"lag(prediction_date, {k}) OVER w AS prediction_date_lag_{k}" for k in (1, 2, 3, 4)) + """,
    eps_growth_yoy - lag(eps_growth_yoy, 1) OVER w AS growth_acceleration,
    """ + " + ".join(
    "CAST(" + " AND ".join(
        f"coalesce(lag(label_yoy, {j}) OVER w = 1, FALSE)" for j in range(1, k + 1))
    + " AS INTEGER)" for k in range(1, 9)) + """ AS growth_streak
  FROM ranked WINDOW w AS (PARTITION BY ticker ORDER BY prediction_date))"""

LABEL_CHAIN = (PART_FACTS_SQL, FIRST_SQL, KEPT_SQL, MATCHED_SQL, EVENTS_SQL, ADJUSTED_SQL,
               PANEL_SQL)
FEATURE_CHAIN = (*LABEL_CHAIN, FEATURES_SQL)


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled panel over part facts, by the library's own plan."""
    from pitpanel.plans.panel import build_panel

    built = build_panel(part_facts(spark, sf_dir), STUDY_START, STUDY_END, ties=TIES,
                        max_lag_days=LAG_CAP).panel
    return built.drop("accn", "line", "other", "price") \
        .withColumn("is_removed_name", F.col("split_factor_applied") > 1)


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitpanel.operators.features import build_features

    return build_features(part_panel(spark, sf_dir))


# --- membership: signups add, errors remove --------------------------------


def member_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "add") \
        .when(F.col("event_type") == "error", "remove")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("date"),
        kind.alias("kind")).where(F.col("kind").isNotNull())


MEMBER_EVENTS_SQL = """member_events AS (
  SELECT user_id AS ticker, CAST(ts AS DATE) AS date,
         CASE event_type WHEN 'signup' THEN 'add' ELSE 'remove' END AS kind
  FROM events WHERE event_type IN ('signup', 'error'))"""

# The state machine as an island problem: a removal closes the stint opened by
# the first add after the previous removal.
INTERVALS_SQL = f"""member_log AS (SELECT DISTINCT ticker, date, kind FROM member_events),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date, kind) AS rn,
         coalesce(sum(CASE WHEN kind = 'remove' THEN 1 ELSE 0 END) OVER (
           PARTITION BY ticker ORDER BY date, kind
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block
  FROM member_log),
blocks AS (
  SELECT ticker, block, min(CASE WHEN kind = 'add' THEN date END) AS opened,
         max(CASE WHEN kind = 'remove' THEN date END) AS closed,
         min(rn) AS first_rn, max(CASE WHEN rn = 1 THEN kind END) AS first_kind
  FROM numbered GROUP BY ticker, block),
intervals AS (
  SELECT ticker,
         CASE WHEN opened IS NOT NULL THEN opened
              ELSE least(DATE '{MEMBER_START}', closed) END AS start,
         coalesce(closed, DATE '{HORIZON}') AS "end",
         opened IS NULL AS left_censored
  FROM blocks
  WHERE opened IS NOT NULL OR (first_rn = 1 AND first_kind = 'remove'))"""


def member_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitpanel.operators.membership import membership_intervals

    return membership_intervals(member_events(spark, sf_dir), MEMBER_START, HORIZON)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("prediction_date"),
        "event_id")


# --- scores: two probability models over line items ------------------------


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")

    def logistic(column: str, centre: float, width: float):
        return 1.0 / (1.0 + F.exp(-(F.col(column) - centre) / width))

    models = F.array(
        F.struct(F.lit("price").alias("model"),
                 logistic("l_extendedprice", 30000.0, 40000.0).alias("probability")),
        F.struct(F.lit("quantity").alias("model"),
                 logistic("l_quantity", 10.0, 25.0).alias("probability")))
    return line.select(
        F.col("l_suppkey").alias("ticker"), F.year(F.col("l_shipdate").cast("date")).alias("fold"),
        (F.col("l_returnflag") != "N").cast("int").alias("y_true"),
        F.explode(models).alias("m")).select(
        "ticker", "fold", "y_true", "m.model", "m.probability",
        (F.col("m.probability") >= 0.5).cast("int").alias("prediction"))


SCORED_SQL = """scored AS (
  SELECT ticker, fold, y_true, model, probability,
         CAST(probability >= 0.5 AS INTEGER) AS prediction
  FROM (
    SELECT l_suppkey AS ticker, CAST(year(l_shipdate) AS INTEGER) AS fold,
           CAST(l_returnflag <> 'N' AS INTEGER) AS y_true, 'price' AS model,
           1.0 / (1.0 + exp(-(l_extendedprice - 30000.0) / 40000.0)) AS probability
    FROM lineitem
    UNION ALL
    SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER), CAST(l_returnflag <> 'N' AS INTEGER),
           'quantity', 1.0 / (1.0 + exp(-(l_quantity - 10.0) / 25.0))
    FROM lineitem))"""

CONSTANT_SQL = """line_roles AS (
  SELECT l_suppkey AS ticker, CAST(year(l_shipdate) AS INTEGER) AS y,
         CAST(l_returnflag <> 'N' AS INTEGER) AS label FROM lineitem),
train_rates AS (
  SELECT f.fold, avg(CAST(r.label AS DOUBLE)) AS rate
  FROM (SELECT unnest(range(1998, 2002)) AS fold) f JOIN line_roles r ON r.y < f.fold
  GROUP BY f.fold),
all_scored AS (
  SELECT ticker, fold, y_true, model, probability, prediction FROM scored WHERE fold >= 1998
  UNION ALL
  SELECT r.ticker, CAST(t.fold AS INTEGER), r.label, 'constant', t.rate, 1
  FROM line_roles r JOIN train_rates t ON r.y = t.fold)"""


def scored_with_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models and the constant baseline on validation years 1998-2001."""
    from pitpanel.operators import evaluate

    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_returnflag") != "N").cast("int").alias("label"))
    folds = evaluate.expanding_folds(spark, 1995, 1998, 2001)
    assigned = evaluate.assign_expanding(line, folds, "day")
    constant = evaluate.constant_scores(assigned, label="label", keep=["ticker"])
    models = scored_lines(spark, sf_dir).where(F.col("fold") >= 1998)
    return models.unionByName(constant)


METRICS_SQL = """metrics AS (
  SELECT fold, model, count(*) AS n, avg(CAST(y_true AS DOUBLE)) AS positive_rate,
         avg(-(CASE WHEN y_true = 1 THEN ln(probability) ELSE ln(1 - probability) END))
           AS log_loss,
         avg(CAST(prediction = y_true AS DOUBLE)) AS accuracy,
         avg(power(probability - y_true, 2)) AS brier,
         avg(CAST(prediction AS DOUBLE)) AS predicted_positive_rate
  FROM all_scored GROUP BY fold, model)"""

METRICS_CHAIN = (SCORED_SQL, CONSTANT_SQL, METRICS_SQL)


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitpanel.operators import evaluate

    return evaluate.binary_metrics(scored_with_constant(spark, sf_dir), ["fold", "model"])


# --- names and identifiers -------------------------------------------------


def names_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry: every part name as a company name, the part key as its id."""
    from pitpanel.functions.names import normalise_name, pad_id

    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), pad_id("p_partkey").alias("cik"),
        F.col("p_partkey").alias("position"), normalise_name("p_name").alias("norm"))


NOISE_SQL = ("'THE','INC','INCORPORATED','CORP','CORPORATION','CO','COMPANY','COMPANIES','PLC',"
             "'LTD','LIMITED','LLC','LP','HOLDING','HOLDINGS','GROUP','SA','NV','AG','CLASS',"
             "'COM','CMN','NEW','DEL'")


def norm_sql(column: str) -> str:
    cleaned = (f"regexp_replace(regexp_replace(replace(replace(upper({column}), '&', ' AND '), "
               "'/', ' '), '\\([^)]*\\)', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g')")
    return (f"array_to_string(list_filter(string_split_regex({cleaned}, ' +'), "
            f"lambda w: w <> '' AND w NOT IN ({NOISE_SQL})), ' ')")


REGISTRY_SQL = f"""registry AS (
  SELECT p_name AS name, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik,
         p_partkey AS position, {norm_sql('p_name')} AS norm FROM part)"""


def id_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part facts keyed by the padded identifier."""
    from pitpanel.functions.names import pad_id

    return part_facts(spark, sf_dir).withColumn("cik", pad_id("ticker"))


ID_RANGES_SQL = """id_ranges AS (
  SELECT lpad(CAST(ticker AS VARCHAR), 10, '0') AS cik, count(*) AS n_records,
         min(period_end) AS first_period, max(period_end) AS last_period
  FROM facts GROUP BY 1)"""


