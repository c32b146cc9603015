"""Documents from raw to packed: five stages, each one operator, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import fresh, shared_dir
from tidewright.llm.mixing import mix
from tidewright.llm.near_dedup import deduplicated
from tidewright.llm.packing import pack_documents
from tidewright.llm.pii import replace_pii
from tidewright.llm.quality_rules import quality_rules

#: SQL can't express the stages' hashes, suffix arrays, surrogates and packing; tests hold run() against brute force.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, repeated rows alike; null and empty texts go. An empty table stays empty, here and in
    all stages; extra columns pass through, whatever their names, to the last."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of least doc_id, of rows repeated under it with one shingle set one; documents
    with null doc_id come after the others. Repeated empty texts count as copies under one doc_id only."""
    return deduplicated(docs, percent=80).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for private data; n_chars follows. Null and empty texts stay; repeated rows get the same surrogates."""
    new = replace_pii(docs).select(*docs.columns)
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, repeated rows alike. A null source is one of its own; a null text has no words."""
    copy = fresh("__copy", docs)
    copies = mix(docs).where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of tokens; a null text is empty, a null doc_id stays null."""
    return pack_documents(docs)


STAGES = [("quality_rules", rules_stage), ("near_dedup", dedup_stage), ("pii_surrogates", pii_stage), ("source_mix", mix_stage), ("packing", pack_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
