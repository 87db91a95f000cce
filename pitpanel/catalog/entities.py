"""Identifier spans, precedence, names, probing, coverage census."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.catalog.proxies import (
    ID_RANGES_SQL, PART_FACTS_SQL, REGISTRY_SQL, id_facts, names_view, norm_sql, rounded, table,
    with_ctes,
)
from pitpanel.catalog.registry import Catalog
from pitpanel.functions.names import normalise_name, pad_id
from pitpanel.operators import entities, profile, spans
from pitpanel.sources.payloads import ingest_facts, parse_registry, shape_facts

catalog = Catalog()


# --- spans -----------------------------------------------------------------

# Each customer's orders as dated identifiers, open where the price is extreme.
SPANS_SQL = """id_spans AS (
  SELECT o_custkey AS ticker, CAST(o_orderkey AS VARCHAR) AS cik,
         CASE WHEN o_totalprice > 20000 THEN CAST(o_orderdate AS DATE) END AS valid_from,
         CASE WHEN o_totalprice < 480000
              THEN CAST(o_orderdate AS DATE) + CAST(10 + o_orderkey AS INTEGER) % 90 END
           AS valid_to
  FROM orders)"""


def _id_spans(spark, sf_dir):
    placed = F.col("o_orderdate").cast("date")
    length = ((F.col("o_orderkey") + 10) % 90).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderkey").cast("string").alias("cik"),
        F.when(F.col("o_totalprice") > 20000, placed).alias("valid_from"),
        F.when(F.col("o_totalprice") < 480000, F.date_add(placed, length)).alias("valid_to"))


BOUNDED_SQL = """bounded AS (
  SELECT *, coalesce(valid_from, DATE '0001-01-01') AS low,
         coalesce(valid_to, DATE '9999-12-31') AS high FROM id_spans)"""


@catalog.add(with_ctes(SPANS_SQL, BOUNDED_SQL, select="""
  SELECT ticker, problem, count(*) AS n FROM (
    SELECT ticker, CASE WHEN low > high THEN 'inverted'
           WHEN low <= max(high) OVER (PARTITION BY ticker ORDER BY low, high
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'overlap' END AS problem
    FROM bounded) WHERE problem IS NOT NULL GROUP BY ticker, problem"""))
def span_conflicts(spark, sf_dir):
    return profile.counts_by(spans.span_conflicts(_id_spans(spark, sf_dir)), "ticker", "problem")


@catalog.add(with_ctes(SPANS_SQL, BOUNDED_SQL, select="""
  SELECT b.ticker, b.cik, CAST(l_shipdate AS DATE) AS period_end, count(*) AS n
  FROM bounded b JOIN lineitem ON b.cik = CAST(l_orderkey AS VARCHAR)
  WHERE CAST(l_shipdate AS DATE) BETWEEN low AND high
  GROUP BY ALL"""))
def facts_in_spans(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("cik"),
        F.col("l_shipdate").cast("date").alias("period_end"))
    return profile.counts_by(spans.facts_in_spans(facts, _id_spans(spark, sf_dir)),
                             "ticker", "cik", "period_end")


@catalog.add(with_ctes(SPANS_SQL, BOUNDED_SQL, select="""
  SELECT ticker, string_agg(
    CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN cik
         ELSE cik || '[' || coalesce(CAST(valid_from AS VARCHAR), '') || ':'
              || coalesce(CAST(valid_to AS VARCHAR), '') || ']' END, '|'
    ORDER BY low, CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN cik
         ELSE cik || '[' || coalesce(CAST(valid_from AS VARCHAR), '') || ':'
              || coalesce(CAST(valid_to AS VARCHAR), '') || ']' END) AS cik_span_used
  FROM bounded GROUP BY ticker"""))
def span_provenance_text(spark, sf_dir):
    return spans.describe_spans(_id_spans(spark, sf_dir))


# --- precedence ------------------------------------------------------------

# Wanted symbols are the customers; suppliers carry spans, nations overrides,
# small parts the recovered ids, and the map lists parts under a hyphen.
WANTED_SQL = """wanted AS (
  SELECT 'C.' || c_custkey AS ticker FROM customer),
span_table AS (
  SELECT 'c.' || s_suppkey AS ticker, 'S' || s_suppkey AS cik FROM supplier
  WHERE s_acctbal > 5000),
overrides AS (SELECT 'C.' || n_nationkey * 7 AS ticker, 'N' || n_nationkey AS cik FROM nation),
recovered AS (SELECT 'C.' || p_partkey AS ticker, 'R' || p_partkey AS cik FROM part
              WHERE p_size <= 10),
current_map AS (SELECT 'C-' || p_partkey AS ticker, 'M' || p_partkey AS cik,
                       p_name AS title FROM part WHERE p_size <= 40)"""


def _tag(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _id_sources(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    never = F.lit(None).cast("date")
    return {
        "wanted": table(spark, sf_dir, "customer").select(_tag("C.", "c_custkey").alias("ticker")),
        "spans": table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 5000).select(
            _tag("c.", "s_suppkey").alias("ticker"), _tag("S", "s_suppkey").alias("cik"),
            never.alias("valid_from"), never.alias("valid_to")),
        "overrides": nation.select(
            F.concat(F.lit("C."), (F.col("n_nationkey") * 7).cast("string")).alias("ticker"),
            _tag("N", "n_nationkey").alias("cik")),
        "recovered": part.where(F.col("p_size") <= 10).select(
            _tag("C.", "p_partkey").alias("ticker"), _tag("R", "p_partkey").alias("cik")),
        "current_map": part.where(F.col("p_size") <= 40).select(
            _tag("C-", "p_partkey").alias("ticker"), _tag("M", "p_partkey").alias("cik"),
            F.col("p_name").alias("title")),
    }


ROUTES_SQL = """resolved AS (
  SELECT w.ticker, coalesce(s.cik, o.cik, r.cik, m.cik) AS cik,
         CASE WHEN s.cik IS NOT NULL THEN 'CIK_SPANS' WHEN o.cik IS NOT NULL THEN 'CIK_OVERRIDES'
              WHEN r.cik IS NOT NULL THEN 'recovered_ciks' WHEN m.cik IS NOT NULL
              THEN 'ticker_map' ELSE 'unresolved' END AS route
  FROM wanted w LEFT JOIN span_table s ON upper(s.ticker) = w.ticker
  LEFT JOIN overrides o ON o.ticker = w.ticker LEFT JOIN recovered r ON r.ticker = w.ticker
  LEFT JOIN current_map m ON m.ticker = replace(w.ticker, '.', '-'))"""


@catalog.add(with_ctes(WANTED_SQL, ROUTES_SQL, select="SELECT ticker, cik, route FROM resolved"))
def id_precedence(spark, sf_dir):
    sources = _id_sources(spark, sf_dir)
    return entities.resolve_ids(sources.pop("wanted"), **sources).select("ticker", "cik", "route")


@catalog.add(with_ctes(WANTED_SQL, ROUTES_SQL, select="""
  SELECT route, count(*) AS n FROM resolved GROUP BY route"""))
def id_route_counts(spark, sf_dir):
    sources = _id_sources(spark, sf_dir)
    return profile.counts_by(entities.resolve_ids(sources.pop("wanted"), **sources), "route")


@catalog.add(with_ctes(WANTED_SQL, select="""
  SELECT w.ticker, coalesce(o.cik, m.cik) AS cik,
         CASE WHEN o.cik IS NULL THEN m.title END AS title, o.cik IS NOT NULL AS overridden
  FROM wanted w LEFT JOIN overrides o ON o.ticker = w.ticker
  LEFT JOIN current_map m ON m.ticker = replace(w.ticker, '.', '-')"""))
def id_census_resolution(spark, sf_dir):
    sources = _id_sources(spark, sf_dir)
    return entities.resolve_for_census(sources["wanted"], overrides=sources["overrides"],
                                       current_map=sources["current_map"])


@catalog.add("""
  SELECT ticker, arg_min(name, src) AS company_name FROM (
    SELECT s_suppkey AS ticker, s_name AS name, 0 AS src FROM supplier
    UNION ALL SELECT c_custkey, c_name, 1 FROM customer) GROUP BY ticker""")
def name_map_two_lists(spark, sf_dir):
    current = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("company_name"),
        F.col("s_suppkey").alias("position"))
    log = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ticker"), F.col("c_name").alias("company_name"),
        F.col("c_custkey").alias("position"))
    return entities.name_map(current, log)


# --- names -----------------------------------------------------------------


@catalog.add(f"""
  SELECT c_custkey, {norm_sql("'The ' || c_mktsegment || ' & ' || c_name || '/Sub (Class A), Inc.'")}
           AS norm FROM customer""")
def normalised_names(spark, sf_dir):
    text = F.concat(F.lit("The "), "c_mktsegment", F.lit(" & "), "c_name",
                    F.lit("/Sub (Class A), Inc."))
    return table(spark, sf_dir, "customer").select("c_custkey", normalise_name(text).alias("norm"))


@catalog.add(f"""
  SELECT name, cik, {norm_sql('name')} AS norm FROM (
    SELECT p_name || ' co' AS name, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik FROM part)""")
def registry_lines(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    good = part.select(F.concat(F.lit(" "), "p_name", F.lit(" co:"), pad_id("p_partkey"),
                                F.lit(": ")).alias("value"))
    bad = part.select(F.explode(F.array(F.lit("   "), F.lit("NO ID:"), F.lit("THE INC:0000000001:")))
                      .alias("value"))
    return parse_registry(good.unionByName(bad))


TARGETS_SQL = f"""targets AS (
  SELECT p_partkey AS ticker, CASE WHEN p_size < 25 THEN 'The ' || p_name || ' Corp.'
                                   ELSE p_name || ' x' END AS company_name FROM part),
normed AS (SELECT ticker, company_name, {norm_sql('company_name')} AS norm FROM targets)"""


def _targets(spark, sf_dir):
    name = F.when(F.col("p_size") < 25, F.concat(F.lit("The "), "p_name", F.lit(" Corp."))) \
        .otherwise(F.concat("p_name", F.lit(" x")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ticker"), name.alias("company_name"),
        normalise_name(name).alias("norm"))


@catalog.add(with_ctes(REGISTRY_SQL, TARGETS_SQL, select="""
  SELECT t.ticker, t.company_name, t.norm, coalesce(n, 0) AS n_candidates,
         CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'exact'
              ELSE 'exact_ambiguous' END AS match_kind
  FROM normed t LEFT JOIN (SELECT norm, count(DISTINCT cik) AS n FROM registry GROUP BY norm) r
    ON t.norm = r.norm"""))
def exact_name_match(spark, sf_dir):
    candidates = entities.name_candidates(names_view(spark, sf_dir), position="position")
    return entities.match_exact(_targets(spark, sf_dir), candidates)


@catalog.add()
def fuzzy_name_match(spark, sf_dir):
    return entities.match_fuzzy(_targets(spark, sf_dir), names_view(spark, sf_dir))


@catalog.add()
def full_name_match(spark, sf_dir):
    return entities.match_names(_targets(spark, sf_dir), names_view(spark, sf_dir),
                                position="position")


PROBED_SQL = """probed AS (
  SELECT norm, arg_min(r.cik, row(-n_records, position)) AS recovered_cik,
         arg_min(n_records, row(-n_records, position)) AS n_records,
         arg_min(first_period, row(-n_records, position)) AS first_period,
         arg_min(last_period, row(-n_records, position)) AS last_period
  FROM registry r JOIN id_ranges i ON r.cik = i.cik GROUP BY norm)"""


@catalog.add(with_ctes(PART_FACTS_SQL, ID_RANGES_SQL, REGISTRY_SQL, PROBED_SQL,
                       select="SELECT * FROM probed"))
def candidate_probe(spark, sf_dir):
    candidates = entities.name_candidates(names_view(spark, sf_dir), position="position")
    return entities.probe_candidates(candidates, spans.fact_ranges(id_facts(spark, sf_dir)))


OVERLAP_SQL = """tenures AS (
  SELECT o_orderkey AS ticker, p.norm,
         CAST(o_orderdate AS DATE) AS tenure_start,
         CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 400 END AS tenure_end
  FROM orders JOIN registry p ON p.position = o_custkey),
closed AS (SELECT ticker, norm, tenure_start,
                  coalesce(tenure_end, DATE '2001-12-31') AS tenure_end FROM tenures),
measured AS (
  SELECT c.ticker, r.cik, r.position, i.n_records, i.first_period, i.last_period,
         least(i.last_period, c.tenure_end) - greatest(i.first_period, c.tenure_start) AS days
  FROM closed c JOIN registry r ON r.norm = c.norm LEFT JOIN id_ranges i ON i.cik = r.cik)"""


@catalog.add(with_ctes(PART_FACTS_SQL, ID_RANGES_SQL, REGISTRY_SQL, OVERLAP_SQL, select="""
  SELECT c.ticker, c.norm, c.tenure_start, c.tenure_end,
         count(m.cik) AS n_candidates, count(m.n_records) AS n_with_records,
         count(CASE WHEN m.days > 0 THEN 1 END) AS n_overlapping,
         arg_min(m.cik, row(-m.days, m.position)) FILTER (m.days > 0) AS chosen_cik,
         coalesce(max(m.days) FILTER (m.days > 0), 0) AS overlap_days,
         CASE count(CASE WHEN m.days > 0 THEN 1 END) WHEN 0 THEN 'd_unresolved_ambiguous'
           WHEN 1 THEN 'b_single_overlap' ELSE 'c_longest_overlap' END AS rule
  FROM closed c LEFT JOIN measured m ON m.ticker = c.ticker
  GROUP BY c.ticker, c.norm, c.tenure_start, c.tenure_end"""))
def candidate_by_overlap(spark, sf_dir):
    registry = names_view(spark, sf_dir)
    placed = F.col("o_orderdate").cast("date")
    tenures = table(spark, sf_dir, "orders").join(
        registry.select("norm", F.col("position").alias("o_custkey")), "o_custkey").select(
        F.col("o_orderkey").alias("ticker"), "norm", placed.alias("tenure_start"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(placed, 400)).alias("tenure_end"))
    chosen = spans.choose_by_overlap(
        tenures, entities.name_candidates(registry, position="position"),
        spans.fact_ranges(id_facts(spark, sf_dir)), open_end="2001-12-31")
    return chosen.select(
        "ticker", "norm", "tenure_start", "tenure_end", "n_candidates", "n_with_records",
        "n_overlapping", "chosen_cik", F.col("overlap_days").cast("long").alias("overlap_days"),
        "rule")


# --- coverage census -------------------------------------------------------

# Customers are the entities; a part of the same number stands for their id.
CENSUS_SQL = """seen AS (
  SELECT c_custkey AS ticker, 'Part ' || c_name AS company_name, c_acctbal,
         CASE WHEN c_acctbal > 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik,
         DATE '1995-01-01' + CAST(c_nationkey AS INTEGER) AS first_seen_in_index,
         c_acctbal > 4000 AS still_in_index FROM customer),
census AS (
  SELECT s.ticker, s.cik, first_seen_in_index, still_in_index,
         CASE WHEN s.cik IS NOT NULL THEN coalesce(n_records, 0) END AS n_eps_records,
         first_period AS earliest_period_end, last_period AS latest_period_end,
         CASE WHEN s.cik IS NULL THEN 'NO_CIK' WHEN coalesce(n_records, 0) = 0
              THEN 'NO_EPS_RECORDS'
              WHEN first_period - first_seen_in_index > 90 THEN 'SUSPECTED_REMAP'
              WHEN n_records < 28 THEN 'THIN' ELSE 'OK' END AS flag
  FROM seen s LEFT JOIN id_ranges i ON s.cik = i.cik)"""


def _census(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    seen = customer.select(
        F.col("c_custkey").alias("ticker"),
        F.when(F.col("c_acctbal") > 0, pad_id("c_custkey")).alias("cik"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.col("c_nationkey"))
        .alias("first_seen_in_index"),
        (F.col("c_acctbal") > 4000).alias("still_in_index"))
    census = profile.coverage_census(seen, id_facts(spark, sf_dir).drop("ticker"))
    return profile.with_coverage_flag(census, remap_days=90, thin_below=28)


CENSUS_CHAIN = (PART_FACTS_SQL, ID_RANGES_SQL, CENSUS_SQL)


@catalog.add(with_ctes(*CENSUS_CHAIN, select="""
  SELECT ticker, cik, n_eps_records, earliest_period_end, latest_period_end, flag
  FROM census"""))
def coverage_census(spark, sf_dir):
    return _census(spark, sf_dir).select("ticker", "cik", "n_eps_records", "earliest_period_end",
                                         "latest_period_end", "flag")


@catalog.add(with_ctes(*CENSUS_CHAIN, select="""
  SELECT flag, count(*) AS n FROM census GROUP BY flag"""))
def coverage_flag_counts(spark, sf_dir):
    return profile.counts_by(_census(spark, sf_dir), "flag")


@catalog.add(with_ctes(*CENSUS_CHAIN, select="""
  SELECT still_in_index, count(*) AS n, count(CASE WHEN flag = 'OK' THEN 1 END) AS n_usable,
         round(count(CASE WHEN flag = 'OK' THEN 1 END) / count(*), 6) AS share_usable,
         count(earliest_period_end) AS n_with_history,
         count(CASE WHEN earliest_period_end <= DATE '1995-01-01' THEN 1 END)
           AS n_reaching_start
  FROM census GROUP BY still_in_index"""))
def usable_by_status(spark, sf_dir):
    return rounded(profile.usable_by_status(_census(spark, sf_dir), "1995-01-01"),
                   "share_usable")


@catalog.add(with_ctes(*CENSUS_CHAIN, select="""
  SELECT ticker, CAST(earliest_period_end - first_seen_in_index AS INTEGER) AS gap_days
  FROM census WHERE flag = 'SUSPECTED_REMAP' ORDER BY gap_days DESC, ticker LIMIT 40"""))
def largest_remap_gaps(spark, sf_dir):
    suspects = _census(spark, sf_dir).where(F.col("flag") == "SUSPECTED_REMAP").select(
        "ticker", F.datediff("earliest_period_end", "first_seen_in_index").alias("gap_days"))
    return profile.largest(suspects, "gap_days", 40, ["ticker"])


RECOVERY_SQL = """named AS (
  SELECT c.ticker, c.cik, c.flag, c.first_seen_in_index, c.n_eps_records,
         c.earliest_period_end, r.norm
  FROM census c JOIN registry r ON r.position = c.ticker)"""


def _recovery_inputs(spark, sf_dir):
    registry = names_view(spark, sf_dir)
    census = _census(spark, sf_dir).withColumn(
        "last_seen_in_index", F.date_add("first_seen_in_index", 1000))
    names = registry.select(F.col("position").alias("ticker"), F.col("name").alias("company_name"),
                            "norm")
    return census, names, registry, spans.fact_ranges(id_facts(spark, sf_dir))


@catalog.add(with_ctes(*CENSUS_CHAIN, REGISTRY_SQL, PROBED_SQL, RECOVERY_SQL, select="""
  SELECT n.ticker, n.norm, CASE WHEN k.n = 1 THEN 'exact' ELSE 'exact_ambiguous' END
           AS match_kind, p.recovered_cik, p.n_records, p.first_period AS earliest_period_end,
         CAST(1000 AS INTEGER) AS tenure_days
  FROM named n JOIN (SELECT norm, count(*) AS n FROM registry GROUP BY norm) k USING (norm)
  LEFT JOIN probed p USING (norm) WHERE n.flag = 'NO_CIK'"""))
def missing_id_recovery(spark, sf_dir):
    census, names, registry, ranges = _recovery_inputs(spark, sf_dir)
    return entities.recover_missing(census, names, registry, ranges, position="position").select(
        "ticker", "norm", "match_kind", "recovered_cik", "n_records", "earliest_period_end",
        "tenure_days")


@catalog.add(with_ctes(*CENSUS_CHAIN, REGISTRY_SQL, RECOVERY_SQL, """tries AS (
  SELECT s.ticker, r.cik, r.position, row_number() OVER (
           PARTITION BY s.ticker ORDER BY r.position) AS nth
  FROM named s JOIN registry r ON r.norm = s.norm AND r.cik <> s.cik
  WHERE s.flag = 'SUSPECTED_REMAP'),
best AS (
  SELECT ticker, arg_min(t.cik, row(-n_records, nth)) AS new_cik,
         arg_min(n_records, row(-n_records, nth)) AS new_n_records,
         arg_min(first_period, row(-n_records, nth)) AS new_earliest
  FROM tries t JOIN id_ranges i ON i.cik = t.cik GROUP BY ticker)""", select="""
  SELECT s.ticker, s.cik AS old_cik,
         (SELECT count(*) FROM tries t WHERE t.ticker = s.ticker) AS n_candidates,
         b.new_cik, b.new_n_records, b.new_earliest,
         coalesce(b.new_earliest < s.earliest_period_end, FALSE) AS adopt
  FROM named s LEFT JOIN best b ON b.ticker = s.ticker WHERE s.flag = 'SUSPECTED_REMAP'"""))
def remap_proposals(spark, sf_dir):
    census, names, registry, ranges = _recovery_inputs(spark, sf_dir)
    return entities.propose_remaps(census, names, registry, ranges, position="position").select(
        "ticker", "old_cik", "n_candidates", "new_cik", "new_n_records", "new_earliest", "adopt")


# --- nested payloads -------------------------------------------------------


def _record(value):
    day = F.date_format(F.col("l_shipdate"), "yyyy-MM-dd")
    return F.struct(
        F.date_format(F.date_sub(F.col("l_shipdate").cast("date"),
                                 F.col("l_quantity").cast("int") + 60), "yyyy-MM-dd")
        .alias("start"), day.alias("end"),
        F.when(F.col("l_tax") > 0.07, "not a date").otherwise(
            F.date_format(F.date_add(F.col("l_shipdate").cast("date"), 30), "yyyy-MM-dd"))
        .alias("filed"), value.cast("double").alias("val"))


@catalog.add("""
  WITH lines AS (
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-'
             || CAST(round(l_extendedprice * 100) AS BIGINT) AS cik, l_returnflag AS flag,
           CAST(l_shipdate AS DATE) AS day, l_quantity AS q, l_discount AS d, l_tax AS t,
           l_extendedprice AS price FROM lineitem)
  SELECT cik, CASE WHEN flag = 'R' THEN 'USD/shares' WHEN flag = 'A' THEN 'AUD/shares'
                   ELSE 'USD' END AS unit,
         CASE WHEN flag = 'N' THEN 'companyfacts' ELSE 'companyconcept' END AS source,
         day AS period_end, CASE WHEN t <= 0.07 THEN day + 30 END AS filed_date,
         CASE WHEN flag = 'A' THEN d ELSE price END AS eps_diluted,
         CASE WHEN t <= 0.07 THEN 30 END AS filing_lag_days
  FROM lines WHERE 60 + CAST(q AS INTEGER) BETWEEN 60 AND 110""")
def nested_fact_ingest(spark, sf_dir):
    from pitpanel.contracts import BULK_PAYLOAD, NESTED_PAYLOAD

    line = table(spark, sf_dir, "lineitem")
    cik = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey",
                      F.round(F.col("l_extendedprice") * 100).cast("long"))
    flag = F.col("l_returnflag")
    price, discount = F.array(_record(F.col("l_extendedprice"))), \
        F.array(_record(F.col("l_discount")))
    # R has the preferred unit, A only other units, N an empty primary payload.
    units = (F.when(flag == "R", F.create_map(F.lit("AUD/shares"), discount,
                                              F.lit("USD/shares"), price))
             .when(flag == "A", F.create_map(F.lit("EUR/shares"), price,
                                             F.lit("AUD/shares"), discount)))
    nested = F.to_json(F.struct(cik.alias("cik"), units.alias("units")))
    concept = F.create_map(F.lit("us-gaap"), F.create_map(
        F.lit("EarningsPerShareDiluted"), F.struct(F.create_map(F.lit("USD"), price)
                                                   .alias("units"))))
    bulk = F.to_json(F.struct(cik.alias("cik"), concept.alias("facts")))
    primary = line.select(F.from_json(nested, NESTED_PAYLOAD).alias("p")).select("p.*")
    fallback = line.where(flag == "N").select(
        F.from_json(bulk, BULK_PAYLOAD).alias("p")).select("p.*")
    return shape_facts(ingest_facts(primary, fallback)).select(
        "cik", "unit", "source", "period_end", "filed_date", "eps_diluted", "filing_lag_days")
