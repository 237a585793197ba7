"""Stratified draws: which plans, how often, and what they estimate."""

import numpy as np
from pyspark.sql import functions as F

from tesserapy.operators import draws

SCHEMA = "word_uid int, plan_uid long, phi_freq double"


def test_draw_takes_the_smallest_keys_whatever_the_parts(spark):
    rng = np.random.default_rng(0)
    rows = [(int(w), int(p), float(x)) for p in range(300) for w, x in zip(rng.choice([0, 0, 0, 1, 2, 3], 1), rng.random(1), strict=True)]
    rows += [(9, 1, 0.5), (9, 2, 0.25), (8, 1, 0.0), (8, 2, float("nan")), (8, 3, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    keyed = {(r[0], r[1]): r[2] for r in df.where("phi_freq > 0").select("word_uid", "plan_uid", (-F.log(draws.unit(7, F.col("word_uid"), F.col("plan_uid"))) / F.col("phi_freq")).alias("k")).collect()}
    for parts in (1, 64):
        got = draws.stratified_draw(df, 5, seed=7, parts=parts).collect()
        for word in (0, 1, 2, 3, 9):
            ranked = sorted((k, p) for (w, p), k in keyed.items() if w == word and not np.isnan(k))
            assert sorted(r["plan_uid"] for r in got if r["word_uid"] == word) == sorted(p for _, p in ranked[:5])
            for r in (r for r in got if r["word_uid"] == word):
                want = 1 - np.exp(-r["w"] * ranked[5][0]) if len(ranked) > 5 else 1.0
                assert abs(r["inclusion"] - want) < 1e-12
        assert not [r for r in got if r["word_uid"] == 8]


def test_estimates_are_right_on_average_and_reruns_agree(spark):
    rng = np.random.default_rng(1)
    weights = rng.random(120) ** 3
    df = spark.createDataFrame([(0, k, float(x)) for k, x in enumerate(weights)], SCHEMA)
    # Many seeds at once: a stratum each, with ids of its own.
    many = df.crossJoin(spark.range(400).select(F.col("id").alias("seed"))).select(F.col("seed").cast("int").alias("word_uid"), "plan_uid", "phi_freq")
    told = [r["estimate"] for r in draws.estimated_weights(draws.stratified_draw(many, 12)).collect()]
    # The standard error of the mean of 400 estimates; four of them are the stated error.
    assert len(told) == 400 and abs(np.mean(told) - weights.sum()) < 4 * np.std(told) / 20
    assert np.std(told) < 0.5 * weights.sum()
    again = [r["estimate"] for r in draws.estimated_weights(draws.stratified_draw(many.repartition(7), 12)).collect()]
    assert np.allclose(sorted(told), sorted(again))
    assert draws.estimated_weights(draws.stratified_draw(df.limit(0), 3)).collect() == []
