"""Samples as a stream: what of each chain counts, and plan counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.codecs import members_of, vec_to_str
from ..functions.keys import numbered

ACCEPTED = "sample_tag string, step bigint, place bigint, plan_vector array<int>"


def plan_counts(samples: DataFrame, num_districts: int) -> DataFrame:
    """sample_tag, plan_key, count of a stream of (sample_tag, plan_vector).

    The key spells a plan by its sorted districts' members, so it needs no
    catalog and is stable between batches.
    """
    return keyed(samples, num_districts).groupBy("sample_tag", "plan_key").agg(F.count("*").alias("count"))


def keyed(samples: DataFrame, num_districts: int) -> DataFrame:
    """sample_tag, plan_key: each sample's plan, spelt by its sorted districts' members."""
    sets = F.transform(F.sequence(F.lit(0), F.lit(num_districts - 1)), lambda d: vec_to_str(members_of(F.col("plan_vector"), d)))
    return samples.select("sample_tag", F.array_join(F.array_sort(sets), "|").alias("plan_key"))


def accept(samples: DataFrame, burn_in: int = 0, most: int | None = None) -> DataFrame:
    """sample_tag, step, place, plan_vector: the samples of a stream that count, numbered from 0 in each chain.

    A chain's state is two numbers: the last step that counted and how many did.
    A sample counts if its step is after the burn-in and after the last one, and
    if fewer than ``most`` counted before. So files that come again add nothing,
    and after a restart the stream goes on where its checkpoint stands. A chain's
    steps have to come in order from one micro-batch to the next, as a sampler
    writes them; within a micro-batch they are sorted. Of samples of one step in
    a micro-batch that with the smallest plan vector counts.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (burn_in, 0)
        rows = pd.concat([*frames], ignore_index=True)
        rows = rows[rows["step"] > last]
        rows = rows.assign(order=rows["plan_vector"].map(tuple)).sort_values(["step", "order"], kind="stable").drop_duplicates("step")
        if most is not None:
            rows = rows.head(max(0, most - count))
        if len(rows):
            state.update((int(rows["step"].iloc[-1]), count + len(rows)))
            yield rows.assign(place=range(count, count + len(rows)))[["sample_tag", "step", "place", "plan_vector"]]

    rows = samples.select("sample_tag", F.col("step").cast("bigint").alias("step"), "plan_vector")
    return rows.groupBy("sample_tag").applyInPandasWithState(work, ACCEPTED, "last bigint, count bigint", "append", GroupStateTimeout.NoTimeout)


def accepted_batch(samples: DataFrame, burn_in: int = 0, most: int | None = None) -> DataFrame:
    """What accept gives when all samples are there, without a stream."""
    once = samples.where(F.col("step") > burn_in).groupBy("sample_tag", F.col("step").cast("bigint").alias("step")).agg(F.min("plan_vector").alias("plan_vector"))
    rows = numbered(once, [F.col("sample_tag"), F.col("step")], "n")
    first = rows.groupBy(F.col("sample_tag").alias("tag")).agg(F.min("n").alias("first"))
    out = rows.join(first, F.col("sample_tag").eqNullSafe(F.col("tag"))).withColumn("place", F.col("n") - F.col("first"))
    if most is not None:
        out = out.where(F.col("place") < most)
    return out.select("sample_tag", "step", "place", "plan_vector")


def take_new(spark: SparkSession, samples: str, out: str, checkpoint: str, burn_in: int = 0, most: int | None = None) -> None:
    """Accept what came under a folder of Parquet samples since the last call, and append it to a folder, exactly once."""
    stream = spark.readStream.schema(spark.read.parquet(samples).schema).parquet(samples)
    query = accept(stream, burn_in, most).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
