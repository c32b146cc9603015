"""Thin queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import collocations, context_mixing, html_extraction, licenses, merkle, mixing, near_dedup, packing, permutation_index, pii, quality_classifier, quality_rules, url_filter
from tidewright.llm.common import table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, net).select("doc_id", "held_out", "score", "predicted")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_permutation_index, op2_quality_classifier, op3_context_mixing, op4_mixing, op5_pii_surrogates, op6_url_filter, op7_quality_rules, op8_packing, op9_licenses, op10_near_dedup, op11_html_extraction, op12_merkle_manifest, op13_collocations]
    return {f.__name__: f for f in own}


def _op6_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.DEFAULT_RULES)
    return f"""
WITH rules(verdict, rh, rp) AS (VALUES {rules}),
parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fit AS (SELECT c.page_id, arg_max(r.rh || r.rp, length(r.rh) * 1000 + length(r.rp)) AS rule, arg_max(r.verdict, length(r.rh) * 1000 + length(r.rp)) AS verdict
  FROM cut c JOIN rules r ON (c.host = r.rh OR ends_with(c.host, '.' || r.rh)) AND starts_with(c.path, r.rp) GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM cut c LEFT JOIN fit f ON c.page_id = f.page_id"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": _op6_sql(), "op9_licenses": licenses.oracle_sql(), "op12_merkle_manifest": merkle.oracle_sql(), "op13_collocations": collocations.oracle_sql()}
