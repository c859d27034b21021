"""The corpus pipeline: quality rules, near-duplicate removal, pseudonyms, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; what it returns is written as Parquet and read
back as the next stage's ``docs``. All but the last return the columns of ``documents``, whatever other columns there are. An
empty table passes through all stages; a very long text is one row in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe_codec, jaccard_join, mixing, pii, quality
from tidewater.llm.common import scratch
from tidewater.llm.queries import pseudonym_key, small_batches, table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules: null and empty texts do not, repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest ``doc_id``; repeated rows become one, rows without
    a ``doc_id`` all stay."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows the text. Null texts stay null; rows are kept one to one."""
    out = pii.pseudonymise(docs, key=pseudonym_key(spark)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget takes it; a null source is one, rows of equal ``doc_id`` go together."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's encoding and its decoding; a null text is empty."""
    small_batches(spark)
    out = bpe_codec.round_trip(docs.select("doc_id", "source", "text"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("pii", pseudonyms), ("mix", mix), ("encode", encode)]

#: The last stage is a tokenizer, which SQL cannot express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
