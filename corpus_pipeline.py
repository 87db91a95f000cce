"""The corpus pipeline: every stage writes Parquet and the next one rereads it.

``run`` applies the stages to ``documents``: quality rules, near-duplicate removal,
personal data, mixing to target weights, and BPE encoding. All stages but the last give
the columns of documents; the last has the token ids in the place of the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.registry import Catalog
from pitpanel.llm import bpe, mixing, pii, quality_rules, simhash
from pitpanel.llm.queries import vocabulary_path
from pitpanel.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines."""
    return quality_rules.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles."""
    return simhash.drop_near(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with entities generalised and revealing terms withheld."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, in shards; a document comes as often as it is drawn."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) instead of texts."""
    tokens = bpe.encode(docs, bpe.share(spark, vocabulary_path()))
    return tokens.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("simhash_dedup", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode_tokens),
]

#: XXH64, near-duplicate components and BPE are beyond SQL; tests hold the stages against
#: brute force.
ORACLE_SQL: str | None = None

catalog = Catalog()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


@catalog.add(ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
