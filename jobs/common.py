"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str, known: dict) -> dict:
    """The defaults with what the config file changes; an unknown name is an error. The file is read through Spark, so it may be remote."""
    given = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return known | given


def command(about: str, job: Callable, config: str, known: dict, *places: str) -> None:
    """Parse the paths, make a session, run the job and stop the session."""
    parser = argparse.ArgumentParser(description=about)
    for place in places:
        parser.add_argument(f"--{place}", required=True)
    parser.add_argument("--config", default=config)
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(parser.prog).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, *(args[p.replace("-", "_")] for p in places), settings(spark, args["config"], known))
    finally:
        spark.stop()
