"""The queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..plans.shipping import ship
from . import ann, crosstok, decontam, langid, lines, mixing, pii, quality, simhash, substrings, urls, warc
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hex_fingerprints(simhash.cluster(table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(table(spark, sf_dir, "documents"))


def op12_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.aligned(table(spark, sf_dir, "documents"))


def _shipped(query):
    """The query, after the package has been sent to the workers."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_language_id": op2_language_id,
        "op3_decontamination": op3_decontamination,
        "op4_ann": op4_ann,
        "op5_warc": op5_warc,
        "op6_simhash": op6_simhash,
        "op7_url_filter": op7_url_filter,
        "op8_mixing": op8_mixing,
        "op9_quality": op9_quality,
        "op10_line_dedup": op10_line_dedup,
        "op11_pii": op11_pii,
        "op12_crosstok": op12_crosstok,
    }
    return {name: _shipped(f) for name, f in found.items()}


def oracle_sql() -> dict:
    return {"op8_mixing": mixing.ORACLE, "op10_line_dedup": lines.ORACLE}
