"""The corpus pipeline: five stages from raw documents to a mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. All but the last return
the columns of documents, whatever they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserapy.llm import decontam, langid, lines, mixing, simhash
from tesserapy.llm.common import discard, fresh, shared_dir, table
from tesserapy.plans.shipping import ship

#: Near duplicates: words of a shingle, and their similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: A document stays if one language holds this share of its letters.
LANGUAGE_SHARE = 0.5


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of the documents, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those of which no language holds half."""
    ship(spark)
    label = langid.labeller(docs, langid.train(docs)).asNondeterministic()
    [name] = fresh(docs, "label")
    found = docs.withColumn(name, label(F.col("text")))
    good = (F.col(name)["lang_pred"] != langid.UNKNOWN) & (F.col(name)["score"] >= LANGUAGE_SHARE)
    return found.where(good).select(*own_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of repeated three-line windows; n_chars follows the text."""
    out = lines.dedup_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    ship(spark)
    return simhash.near_dedup(docs, shingle=SHINGLE, similarity=SIMILARITY).select(*own_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources come near their targets."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
]

#: Language ID, fingerprints and latent retrieval have no SQL; tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    A stage's table is deleted once the next one is written; the last is the result.
    """
    docs, root, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
