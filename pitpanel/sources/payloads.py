"""Nested fact payloads and the text registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.contracts import BULK_PAYLOAD, NESTED_PAYLOAD, nan_to_null
from pitpanel.functions.names import normalise_name
from pitpanel.operators.knowledge import quarterly_facts, with_lag_days
from pitpanel.session import settle

PREFERRED_UNIT = "USD/shares"


def unit_key(units: Column, preferred: str = PREFERRED_UNIT) -> Column:
    """The preferred unit when present, else the alphabetically first."""
    return F.when(F.map_contains_key(units, preferred), F.lit(preferred)) \
        .otherwise(F.array_min(F.map_keys(units)))


def explode_units(payload: DataFrame, identifier: str = "cik", units: str = "units",
                  preferred: str = PREFERRED_UNIT) -> DataFrame:
    """One row per record of the chosen unit."""
    return _chosen(payload, identifier, units, preferred) \
        .select(identifier, "unit", F.explode("records").alias("fact")) \
        .select(identifier, "unit", "fact.*")


def _chosen(payload: DataFrame, identifier: str, units: str, preferred: str) -> DataFrame:
    keyed = payload.withColumn("unit", unit_key(F.col(units), preferred))
    return keyed.select(identifier, "unit",
                        F.try_element_at(F.col(units), F.col("unit")).alias("records"))


def ingest_facts(primary: DataFrame, fallback: DataFrame | None = None, *,
                 concept: str = "EarningsPerShareDiluted", taxonomy: str = "us-gaap",
                 identifier: str = "cik") -> DataFrame:
    """Facts of the primary payload; of the bulk one where the primary is empty."""
    if fallback is None:
        return explode_units(primary, identifier).withColumn("source", F.lit("companyconcept"))
    bulk = fallback.select(identifier, F.try_element_at(
        F.try_element_at("facts", F.lit(taxonomy)), F.lit(concept)).getField("units")
        .alias("units"))
    # The primary payload is parsed once; only its identifiers meet the fallback, and
    # its records are never dealt. Filters follow the writing: pushed below it they
    # would parse every payload once more.
    own = settle(_chosen(primary, identifier, "units", PREFERRED_UNIT)) \
        .where(F.coalesce(F.size("records"), F.lit(0)) > 0)
    rest = settle(_chosen(bulk, identifier, "units", PREFERRED_UNIT)).join(
        own.select(F.col(identifier).alias("_answered")).distinct(),
        F.col(identifier).eqNullSafe(F.col("_answered")), "left_anti")
    kept = own.withColumn("source", F.lit("companyconcept")).unionByName(
        rest.withColumn("source", F.lit("companyfacts")))
    return kept.select(identifier, "unit", "source", F.explode("records").alias("fact")) \
        .select(identifier, "unit", "fact.*", "source")


def shape_facts(facts: DataFrame, value: str = "eps_diluted") -> DataFrame:
    """Typed quarterly facts: dates parsed, other durations dropped, lag added.

    NaN becomes null here, so no later comparison meets one.
    """
    dated = facts.select(
        *[F.col(c).try_cast("date").alias(c) if c in ("start", "end", "filed")
          else F.col(c) for c in facts.columns])
    quarterly = quarterly_facts(dated)
    return with_lag_days(
        quarterly.withColumn("period_end", F.col("end")).withColumn("filed_date", F.col("filed"))
        .withColumn(value, nan_to_null("val")))


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NESTED_PAYLOAD).json(path)


def read_bulk_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BULK_PAYLOAD).json(path)


def parse_registry(lines: DataFrame, value: str = "value") -> DataFrame:
    """``NAME:0000123456:`` lines -> (name, cik, norm); unusable lines are dropped."""
    parts = F.split(F.trim(F.col(value)), ":")
    rows = lines.select(*[c for c in lines.columns if c != value],
                        F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("cik"))
    named = rows.where(F.col("cik").isNotNull() & (F.col("cik") != "")) \
        .withColumn("norm", normalise_name("name"))
    return named.where(F.col("norm") != "")


def read_registry(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """The registry file, in its own encoding, split by lines across tasks."""
    lines = spark.read.option("header", False).option("encoding", encoding) \
        .option("sep", "\u0001").option("quote", "").schema("value string").csv(path)
    return parse_registry(lines)
