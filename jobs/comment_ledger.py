"""A ledger of comments by the representative set of terms that each is nearest to.

Public comments on plans arrive as files of texts. What districts are to a plan,
terms are to a text: each new text becomes the set of the configured terms that it
holds, and is filed under the representative set (letter) of smallest weighted
distance. The texts are read as a file stream that takes only files it has not
seen; a checkpoint keeps the mark. After that the distribution of letters by source
follows from the ledger.

    python -m jobs.comment_ledger --texts DIR_OR_PATTERN --out DIR --checkpoint DIR [--config FILE]

``OUT/ledger`` holds a row for each text, partitioned by letter, written exactly
once by Spark's file sink. ``OUT/distribution`` is replaced as a whole. A rerun
without new files changes neither's rows. A null text holds no term.
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command
from tesserapy.functions.codecs import set_distance, vec_to_str, weight_of

LOG = logging.getLogger("comment_ledger")
CONFIG = str(Path(__file__).with_suffix(".json"))
#: terms: the vocabulary, in lower case; weights: one for each, 1 unless given; letters: names of the representative sets with their terms; cap: of a distance; files_a_batch: files that the stream takes at once, all if 0.
DEFAULTS = {"terms": [], "weights": [], "letters": {}, "cap": 1000, "files_a_batch": 0}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
BETWEEN = r"[\x20\x09-\x0D.,;:!?]+"


def held_terms(text: Column, terms: list[str]) -> Column:
    """Indices of the terms that a text holds as words, ascending; letters A-Z count as lower case."""
    vocabulary = F.array(*[F.lit(t) for t in terms])
    found = F.array_intersect(vocabulary, F.split(F.translate(text, UPPER, LOWER), BETWEEN))
    return F.coalesce(F.transform(found, lambda t: (F.array_position(vocabulary, t) - 1).cast("int")), F.array().cast("array<int>"))


def nearest(members: Column, config: dict) -> tuple[Column, Column]:
    """The name of the nearest letter (of equally near ones the first) and its distance.

    The letters are few and come from the config, so their distances are columns
    of the row itself: no join and no shuffle.
    """
    terms = config["terms"]
    weights = F.array(*[F.lit(w).cast("long") for w in _weights(config)])
    own = weight_of(members, weights)
    choices = []
    for k, (name, of) in enumerate(config["letters"].items()):
        letter = F.array(*[F.lit(i) for i in sorted({terms.index(t) for t in of})]).cast("array<int>")
        d = set_distance(members, letter, own, weight_of(letter, weights), weights, F.lit(config["cap"]).cast("long"))
        choices.append(F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")))
    best = F.array_min(F.array(*choices))
    return best["name"], best["d"]


def _weights(config: dict) -> list[int]:
    terms, weights = config["terms"], config["weights"] or [1] * len(config["terms"])
    if not terms or len(set(terms)) < len(terms) or not config["letters"]:
        raise ValueError("the config needs terms, all different, and letters")
    if len(weights) != len(terms):
        raise ValueError("the config needs as many weights as terms")
    return weights


def filed(texts: DataFrame, config: dict) -> DataFrame:
    """doc_id, source, terms, n_terms, letter, distance of each text."""
    rows = texts.select("doc_id", "source", held_terms(F.col("text"), config["terms"]).alias("members"))
    name, d = nearest(F.col("members"), config)
    return rows.select("doc_id", "source", vec_to_str(F.col("members")).alias("terms"), F.size("members").alias("n_terms"), d.alias("distance"), name.alias("letter"))


def distribution(ledger: DataFrame) -> DataFrame:
    """source, letter, cnt, freq: texts by letter, and their share of the source's texts."""
    counts = ledger.groupBy("source", "letter").agg(F.count("*").alias("cnt"))
    totals = counts.groupBy(F.col("source").alias("of")).agg(F.sum("cnt").alias("total"))
    joined = counts.join(totals, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("source", "letter", "cnt", (F.col("cnt") / F.col("total")).alias("freq"))


def take(spark: SparkSession, texts: str, ledger: str, checkpoint: str, config: dict) -> int:
    """File the texts of files that came since the last run; how many there were."""
    stream = spark.readStream.schema(spark.read.parquet(texts).schema)
    if config["files_a_batch"]:
        stream = stream.option("maxFilesPerTrigger", config["files_a_batch"])
    rows = filed(stream.parquet(texts), config)
    query = rows.writeStream.format("parquet").option("path", ledger).option("checkpointLocation", checkpoint).partitionBy("letter").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def run(spark: SparkSession, texts: str, out: str, checkpoint: str, config: dict) -> None:
    """File what is new under a folder of texts, then rebuild the distribution."""
    config = DEFAULTS | config
    _weights(config)
    LOG.info("read %s: %d new texts", texts, take(spark, texts, f"{out}/ledger", checkpoint, config))
    ledger = spark.read.parquet(f"{out}/ledger")
    distribution(ledger).write.mode("overwrite").partitionBy("letter").parquet(f"{out}/distribution")
    for r in spark.read.parquet(f"{out}/distribution").groupBy("letter").agg(F.sum("cnt").alias("cnt")).orderBy("letter").collect():
        LOG.info("wrote %s: letter %s holds %d texts", out, r["letter"], r["cnt"])


if __name__ == "__main__":
    command(__doc__.split("\n", 1)[0], run, CONFIG, DEFAULTS, "texts", "out", "checkpoint")
