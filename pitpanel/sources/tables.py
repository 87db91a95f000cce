"""Parquet and CSV tables, provenance, and refusal to overwrite."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.contracts import require_columns
from pitpanel.operators.gates import enforce

# What the header of a prediction file must carry.
PROVENANCE_KEYS = (
    "cut_date", "code_sha", "working_tree_clean", "config", "model", "decision_threshold",
    "panel_sha256", "training_rows_labelled", "training_positive_rate",
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               required: Sequence[str] = ()) -> DataFrame:
    """A parquet table; a missing path or column fails here."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return require_columns(reader.parquet(path), required, path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                replace: bool = False) -> None:
    """Write parquet. Without ``replace`` an existing output is refused."""
    writer = df.write.mode("overwrite" if replace else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_verified(df: DataFrame, path: str, gate: Callable[[DataFrame], DataFrame],
                   name: str = "gate", replace: bool = False) -> DataFrame:
    """Write, read back, and run the gate on what was written."""
    write_table(df, path, replace=replace)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    enforce(gate(written), f"{name} on {path}")
    return written


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *,
             comment: str | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV with a header and declared types; ids stay strings, zeros kept."""
    reader = spark.read.schema(schema).option("header", True) \
        .option("dateFormat", date_format).option("mode", "FAILFAST")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, replace: bool = False) -> None:
    df.write.mode("overwrite" if replace else "errorifexists").option("header", True).csv(path)


def parse_provenance(lines: DataFrame, value: str = "value",
                     position: str | None = None) -> DataFrame:
    """(key, value) rows of the ``# key : value`` lines of the header block.

    Only lower-case keys without blanks count, so prose in the block is passed
    over. ``position`` is the column that orders the file's lines: the block
    ends at the first line that does not start with ``#``, and comments after
    it are not provenance. Without it all lines are the block.
    """
    if position is not None:
        data = lines.where(~F.coalesce(F.col(value).startswith("#"), F.lit(False)))
        # One row: no data line, no end.
        end = data.agg(F.min(position).alias("_end"))
        lines = lines.join(F.broadcast(end)).where(
            F.col("_end").isNull() | (F.col(position) < F.col("_end"))).drop("_end")
    pattern = r"^#\s*([^\s:]+)\s*:(.*)$"
    keyed = lines.where(F.col(value).startswith("#")).select(
        F.regexp_extract(value, pattern, 1).alias("key"),
        F.trim(F.regexp_extract(value, pattern, 2)).alias("value"))
    return keyed.where((F.col("key") != "") & (F.col("key") == F.lower("key")))


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """The header block of one text file; a repeated key is refused.

    A file's lines keep their order in its splits, and ids that increase along
    splits and rows order them.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    found = parse_provenance(lines, position="_at")
    twice = [r["key"] for r in found.groupBy("key").count().where("count > 1").take(5)]
    if twice:
        raise ValueError(f"provenance keys given more than once: {sorted(twice)}")
    return found


def missing_provenance(provenance: DataFrame,
                       required: Sequence[str] = PROVENANCE_KEYS) -> DataFrame:
    """Required keys the header does not carry."""
    wanted = provenance.sparkSession.createDataFrame([(k,) for k in required], "key string")
    return wanted.join(provenance, "key", "left_anti")


def first_token(provenance: DataFrame, key: str) -> DataFrame:
    """The value of a key up to its first blank; a gloss may follow it."""
    return provenance.where(F.col("key") == key).select(
        F.split("value", r"\s+").getItem(0).alias(key))


def write_with_provenance(df: DataFrame, provenance: dict[str, str], path: str) -> None:
    """A table with its one-row provenance beside it; one output per path."""
    write_table(df, f"{path}/data")
    row = df.sparkSession.createDataFrame(
        [tuple(str(v) for v in provenance.values())],
        T.StructType([T.StructField(k, T.StringType()) for k in provenance]))
    write_table(row.coalesce(1), f"{path}/provenance")


def read_with_provenance(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    rows = spark.read.parquet(f"{path}/provenance").take(1)
    return spark.read.parquet(f"{path}/data"), rows[0].asDict()
