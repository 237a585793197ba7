"""Send the package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give the workers the package as a zip file, once for each Spark context.

    Workers that have it on their path already are not harmed by a second copy.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tesserapy_shipped", False):
        return
    made = Path(tempfile.mkdtemp(prefix="tesserapy-")) / "tesserapy_package.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, f"{ROOT.name}/{p.relative_to(ROOT).as_posix()}")
    sc.addPyFile(str(made))
    sc._tesserapy_shipped = True
