"""A corpus pipeline over ``documents``: drop what is toxic, keep one of near-duplicates,
mask secrets, mix sources to target weights, and encode what is left.

Every stage takes (spark, docs, sf_dir) and all rows its predecessor kept. All but the last
return the columns of ``docs``. Stages hand over through Parquet in the shared folder, so a
lost executor or a failed stage does not repeat earlier ones. Empty tables pass through all
stages; null texts pass as empty ones do: not toxic, no duplicates, nothing to mask, no ids.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receiptlake.llm import bpe, minhash, mixing, secret_scan, toxicity
from receiptlake.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, trained on ``labels``, does not reject."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.filter("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return minhash.deduplicated(docs).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them masked, ``n_chars`` as the text then has."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, to the target weights of their sources, shuffled."""
    return mixing.mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy as a digest, and that of the text they decode to."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Learned scores, signatures and merges are beyond SQL; tests hold the rows against models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
