"""Stratum weights of every chain of an ensemble, side by side.

Samplers that target one distribution should give every stratum of plans the same
weight. This job reads the tables that an ensemble follows from, spells its plans
by an alphabet of representative districts, and writes for each chain (tag) the
weight and rank of every word, how many of its plans touch it, how far the weight
lies from the mean of all chains, and the word's districts.

    python -m jobs.strata_report --tables DIR --out DIR [--config FILE]

The output is one Parquet table, partitioned by chain and replaced as a whole, so
a rerun over the same tables leaves the same rows.
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command
from tesserapy.functions.codecs import vec_to_str
from tesserapy.operators import catalog, cluster, strata, words
from tesserapy.sources import ensemble
from tesserapy.sources.shared import checkpoint

LOG = logging.getLogger("strata_report")
CONFIG = str(Path(__file__).with_suffix(".json"))
#: unit: period of a plan; letters, epochs: size of the alphabet and its refinement; degree: words a plan; temperature: decay of a word's share with distance; digits: of the weights.
DEFAULTS = {"unit": "week", "letters": 12, "epochs": 1, "degree": 5, "temperature": 1.0, "digits": 9}


def report(spark: SparkSession, tables: str, config: dict) -> DataFrame:
    """sample_tag, word_uid, word_str, districts, plans, weight, rank, gap."""
    k = config["letters"]
    weights = checkpoint(ensemble.weights(spark, tables))
    expanded = checkpoint(catalog.expand_samples(ensemble.samples(spark, tables, config["unit"]), ensemble.DISTRICTS))
    districts = checkpoint(catalog.district_catalog(expanded, weights))
    LOG.info("read %s: %d districts of samples, %d different", tables, expanded.count(), districts.count())
    dist = checkpoint(catalog.distributions(catalog.summarize_plans(catalog.attach_district_ids(expanded, districts))))
    _, letters = cluster.kcentroids(districts, cluster.seed_assignment(districts, k), weights, k, threshold=0.0, max_iter=config["epochs"])
    lists = words.letters_by_centroid(districts, letters, weights, words.letter_subset(spark, k))
    weighted = strata.pou_weights(checkpoint(words.enumerate_words(dist, lists, config["degree"])), dist, config["temperature"])

    each = weighted.join(dist.select("plan_uid", "sample_tag"), "plan_uid")
    found = each.groupBy("sample_tag", "word_uid", "word_str").agg(F.count("*").alias("plans"), F.sum("phi_freq").alias("z"))
    found = found.withColumn("weight", F.round("z", config["digits"]))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("sample_tag").orderBy(F.desc("weight"), "word_uid")))
    tags = dist.select("sample_tag").distinct().agg(F.count("*").alias("tags"))
    mean = found.groupBy("word_uid").agg(F.sum("z").alias("sum")).crossJoin(F.broadcast(tags)).select("word_uid", (F.col("sum") / F.col("tags")).alias("mean"))
    out = ranked.join(mean, "word_uid").withColumn("gap", F.round(F.col("z") - F.col("mean"), config["digits"]))
    return out.join(_spelt(weighted, letters), "word_uid").select("sample_tag", "word_uid", "word_str", "districts", "plans", "weight", "rank", "gap")


def _spelt(weighted: DataFrame, letters: DataFrame) -> DataFrame:
    """word_uid, districts: the members of a word's letters in the word's order."""
    each = strata.word_metadata(weighted).select("word_uid", F.posexplode("word").alias("place", "cluster_id"))
    named = each.join(letters.select("cluster_id", vec_to_str(F.col("members")).alias("m")), "cluster_id")
    order = F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda x: x["m"])
    return named.groupBy("word_uid").agg(F.array_join(order, "|").alias("districts"))


def run(spark: SparkSession, tables: str, out: str, config: dict = DEFAULTS) -> None:
    """Write the report over the tables of a folder to another folder."""
    report(spark, tables, DEFAULTS | config).write.mode("overwrite").partitionBy("sample_tag").parquet(out)
    for r in spark.read.parquet(out).groupBy("sample_tag").agg(F.count("*").alias("words"), F.sum("weight").alias("weight")).collect():
        LOG.info("wrote %s: chain %s, %d words, total weight %.6f", out, r["sample_tag"], r["words"], r["weight"])


if __name__ == "__main__":
    command(__doc__.split("\n", 1)[0], run, CONFIG, DEFAULTS, "tables", "out")
